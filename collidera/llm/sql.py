"""DuckDB statements for operators whose methods SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
lines AS (
  SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged_lines AS (
  SELECT r, line, len(lw) AS n,
    len(list_filter(lw, lambda w: w IN ('|', '»', '›', '>', '/', '·', '•', '::'))) AS seps,
    regexp_matches(lower(line), 'all rights reserved|cookie policy|privacy policy|terms of service|terms of use|click here|read more|subscribe to|sign up|log in|lorem ipsum|enable javascript') AS boiler,
    len(list_filter(lw, lambda w: regexp_matches(w, '##|\*\*|\$\$|%%|&&|\|\||<<|>>|!!'))) AS noisy,
    regexp_matches(coalesce(lw[-1], ''), '[.!?:;"''…»”)]$') AS ended
  FROM lines WHERE len(lw) > 0),
removed AS (
  SELECT r, count(*) AS n_removed_lines, sum(n) AS lost FROM judged_lines
  WHERE (seps >= 2 AND seps >= 0.2 * n) OR boiler OR (noisy > 0 AND noisy >= 0.1 * n) OR (n <= 20 AND NOT ended)
  GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM judged_lines GROUP BY r),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT r, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM again) GROUP BY r),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
    (len(words) - coalesce(lost, 0))::BIGINT AS n_kept_words
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= 0.7 * n_words AS kept
FROM counted
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
usable AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b
  WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept
FROM v JOIN roots USING (vec_id)
"""

CHAT_FORMATTING = """
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations),
conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM turns GROUP BY conv_id),
parted AS (
  SELECT *, t[1] AS opening, conv_id % greatest(1, CAST(ceil(count(*) OVER () / 1000.0) AS BIGINT)) AS part FROM conv),
ranked AS (
  SELECT *, row_number() OVER w AS rn, lead(conv_id) OVER w AS nxt FROM parted
  WINDOW w AS (PARTITION BY opening, part ORDER BY conv_id)),
odd AS (
  SELECT conv_id, row_number() OVER w AS rn, lead(conv_id) OVER w AS nxt
  FROM ranked WHERE rn % 2 = 1 AND nxt IS NULL WINDOW w AS (PARTITION BY opening ORDER BY conv_id)),
pairs AS (
  SELECT conv_id AS c, nxt AS r FROM ranked WHERE rn % 2 = 1 AND nxt IS NOT NULL
  UNION ALL SELECT conv_id, nxt FROM odd WHERE rn % 2 = 1),
found AS (
  SELECT c, r, x.t AS a, y.t AS b FROM pairs JOIN conv x ON x.conv_id = c LEFT JOIN conv y ON y.conv_id = r),
cut AS (
  SELECT *, CASE WHEN b IS NULL
    THEN coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) - 1, len(a))
    ELSE coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a))
    END AS n FROM found),
parts AS (
  SELECT c, r, n,
    list_transform(a[1:n], lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS p,
    list_transform(a[n + 1:], lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS ca,
    list_transform(b[n + 1:], lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS cb,
    a[n + 1:] AS ta, b[n + 1:] AS tb FROM cut)
SELECT c AS chosen_id, r AS rejected_id, n::INTEGER AS prompt_turns,
  array_to_string(p, '') AS prompt, array_to_string(ca, '') AS chosen, array_to_string(cb, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: ta[i].role = 'assistant'),
    lambda i: (length(array_to_string(ca[1:i], '')) - length(coalesce(ta[i].text, '')) - 8) || '-' || length(array_to_string(ca[1:i], ''))), ',') AS chosen_learned,
  CASE WHEN tb IS NOT NULL THEN array_to_string(list_transform(list_filter(range(1, len(cb) + 1), lambda i: tb[i].role = 'assistant'),
    lambda i: (length(array_to_string(cb[1:i], '')) - length(coalesce(tb[i].text, '')) - 8) || '-' || length(array_to_string(cb[1:i], ''))), ',') END AS rejected_learned
FROM parts
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM (
    SELECT item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS j FROM i)),
windows AS (
  SELECT r, m, j, array_to_string(w[j:j + m - 1], ' ') AS x FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS j
    FROM d, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)),
hits AS (SELECT r, j, m, item_id FROM windows JOIN item_windows USING (m, x)),
words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(j, j + m)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def centroid_clustering(clusters: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """Every round written out as two steps: assignment and means."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c
  FROM kept ORDER BY k LIMIT {clusters})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT kept.*, k, list_sum(list_transform(list_zip(v, c),
      lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i})
  GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""
c{i + 1} AS MATERIALIZED (
  SELECT k, list(m ORDER BY pos) AS c FROM (
    SELECT k, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT k, unnest(v) AS x, unnest(range({dim})) AS pos FROM a{i}) GROUP BY k, pos)
  GROUP BY k
  UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))"""
            )
    return f"""WITH {",".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance,
  (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""
