"""DuckDB statements that give the same rows as the registered Spark queries."""

from __future__ import annotations

EXACT_DIGITS = 6

# The collision-shaped view over events, its decoded and cleaned forms, and the
# two report tables (q1: hours and weekdays, q6: urban and rural areas).
BASE = """
WITH fx AS (
  SELECT
    2024 AS collision_year,
    CAST(event_id AS VARCHAR) AS collision_index,
    CAST(event_id AS VARCHAR) AS collision_ref_no,
    concat('E', CAST(user_id AS VARCHAR)) AS local_authority_highway_current,
    CAST(user_id % 300 AS VARCHAR) AS local_authority_district,
    CASE WHEN event_id % 97 = 0 THEN '31/02/2024' ELSE strftime(ts, '%d/%m/%Y') END AS date,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE strftime(ts, '%H:%M') END AS time,
    CASE WHEN event_id % 71 <> 0 THEN CAST(dayofweek(ts) + 1 AS VARCHAR) END AS day_of_week,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_type = 'error' THEN '1'
      WHEN event_type = 'purchase' THEN '2' ELSE '3' END
      AS collision_severity,
    CASE event_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3' END
      AS enhanced_severity_collision,
    CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '19' WHEN 2 THEN '13' ELSE '99' END
      AS junction_detail,
    CAST(1 + user_id % 3 AS VARCHAR) AS urban_or_rural_area,
    CASE event_id % 9 WHEN 0 THEN '-1' WHEN 1 THEN '20' WHEN 5 THEN '40' WHEN 6 THEN '50'
      WHEN 7 THEN '60' WHEN 8 THEN '70' ELSE '30' END AS speed_limit,
    CAST(1 + event_id % 4 AS INTEGER) AS number_of_vehicles,
    CAST(1 + floor(value / 60) AS INTEGER) AS number_of_casualties
  FROM events
),
decoded AS (
  SELECT * REPLACE (
    CASE collision_severity WHEN '1' THEN 'Fatal' WHEN '2' THEN 'Serious' WHEN '3' THEN 'Slight'
      ELSE collision_severity END AS collision_severity,
    CASE urban_or_rural_area WHEN '1' THEN 'Urban' WHEN '2' THEN 'Rural'
      WHEN '3' THEN 'Unallocated' ELSE urban_or_rural_area END AS urban_or_rural_area,
    CASE day_of_week WHEN '1' THEN 'Sunday' WHEN '2' THEN 'Monday' WHEN '3' THEN 'Tuesday'
      WHEN '4' THEN 'Wednesday' WHEN '5' THEN 'Thursday' WHEN '6' THEN 'Friday'
      WHEN '7' THEN 'Saturday' ELSE day_of_week END AS day_of_week,
    CASE junction_detail WHEN '0' THEN 'Not at junction or within 20 metres'
      WHEN '13' THEN 'T or staggered junction' WHEN '99' THEN 'unknown (self reported)'
      ELSE junction_detail END AS junction_detail,
    CASE speed_limit WHEN '-1' THEN 'Data missing or out of range' ELSE speed_limit END
      AS speed_limit,
    concat('District ', local_authority_district) AS local_authority_district
  ) FROM fx
),
cleaned AS (
  SELECT
    CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS date,
    time,
    day_of_week,
    collision_severity,
    nullif(enhanced_severity_collision, '-1') AS enhanced_severity_collision,
    CASE WHEN junction_detail IN ('19', 'unknown (self reported)') THEN NULL
      ELSE junction_detail END AS junction_detail,
    nullif(urban_or_rural_area, 'Unallocated') AS urban_or_rural_area,
    TRY_CAST(nullif(speed_limit, 'Data missing or out of range') AS INTEGER) AS speed_limit,
    number_of_vehicles,
    number_of_casualties
  FROM decoded
),
q1 AS (
  SELECT *,
    CAST(substr(time, 1, 2) AS INTEGER) AS hour,
    CASE day_of_week WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3
      WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6
      WHEN 'Sunday' THEN 7 END AS day_ord,
    CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 'weekend' ELSE 'weekday' END AS day_type,
    collision_severity AS severity,
    CASE collision_severity WHEN 'Fatal' THEN 1 WHEN 'Serious' THEN 2 WHEN 'Slight' THEN 3 END
      AS severity_ord
  FROM cleaned
),
q6 AS (
  SELECT *,
    urban_or_rural_area AS area_type,
    collision_severity AS severity,
    CASE collision_severity WHEN 'Fatal' THEN 1 WHEN 'Serious' THEN 2 WHEN 'Slight' THEN 3 END
      AS severity_ord
  FROM cleaned
  WHERE urban_or_rural_area IN ('Urban', 'Rural')
)
"""


def r(expression: str, digits: int = EXACT_DIGITS) -> str:
    """Rounded double, with no negative zero."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def null_summary() -> str:
    columns = [
        "date",
        "time",
        "day_of_week",
        "collision_severity",
        "enhanced_severity_collision",
        "junction_detail",
        "urban_or_rural_area",
        "speed_limit",
        "number_of_vehicles",
        "number_of_casualties",
    ]
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM cleaned" for c in columns
    ]
    return f"{BASE} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_null > 0"


def profile_structure() -> str:
    types = {
        "date": "date",
        "time": "string",
        "day_of_week": "string",
        "collision_severity": "string",
        "enhanced_severity_collision": "string",
        "junction_detail": "string",
        "urban_or_rural_area": "string",
        "speed_limit": "int",
        "number_of_vehicles": "int",
        "number_of_casualties": "int",
    }
    order = ", ".join(f"{c} NULLS FIRST" for c in types)
    parts = [
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type,
          (SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'NA'), ', ' ORDER BY k) FROM head)
            AS first_values,
          (SELECT count(*) FROM cleaned) AS n_rows"""
        for i, (c, t) in enumerate(types.items(), start=1)
    ]
    return f"""{BASE}, head AS (
      SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM cleaned ORDER BY {order} LIMIT 5
    ) {' UNION ALL '.join(parts)}"""


def describe_long() -> str:
    stats = {
        "mean": "avg({c})",
        "median": "median({c})",
        "sd": "stddev_samp({c})",
        "min": "min({c})",
        "max": "max({c})",
    }
    parts = [
        f"SELECT '{c}_{s}' AS metric, {r(f.format(c=c))} AS value FROM q1"
        for c in ("hour", "number_of_casualties")
        for s, f in stats.items()
    ]
    return f"{BASE} {' UNION ALL '.join(parts)}"


def pair_correlation(table: str, a: str, b: str) -> str:
    """One row (n, correlation): Spearman over the rows where both are present."""
    return f"""
      SELECT count(*) AS n, corr(ra, rb) AS correlation FROM (
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
        FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL
      )"""


def spearman_pair() -> str:
    """A pair with missing cells, whose value is null, and one without."""

    def pair(a: str, b: str) -> str:
        return f"""
          SELECT '{a}' AS var1, '{b}' AS var2, n,
            CASE WHEN (SELECT count(*) FROM q1 WHERE {a} IS NULL OR {b} IS NULL) = 0
              THEN {r('correlation')} END AS correlation
          FROM ({pair_correlation('q1', a, b)})"""

    incomplete = pair("hour", "number_of_casualties")
    return f"{BASE} {incomplete} UNION ALL {pair('number_of_vehicles', 'number_of_casualties')}"


def spearman_pairwise() -> str:
    names = ["hour", "number_of_casualties", "speed_limit"]
    parts = [
        f"""SELECT '{a}' AS var1, '{b}' AS var2, n, {r('correlation')} AS correlation,
          round_even(correlation, 1) + 0.0 AS label FROM ({pair_correlation('q1', a, b)})"""
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return f"{BASE} {' UNION ALL '.join(parts)}"


def spearman_matrix() -> str:
    a, b = "number_of_vehicles", "number_of_casualties"
    one = f"SELECT correlation FROM ({pair_correlation('q6', a, b)})"
    cells = [(a, a, "1.0"), (b, b, "1.0"), (a, b, f"({one})"), (b, a, f"({one})")]
    parts = [f"SELECT '{x}' AS var1, '{y}' AS var2, {c} AS c" for x, y, c in cells]
    return f"""{BASE} SELECT var1, var2, {r('c')} AS correlation,
      round_even(CAST(c AS DOUBLE), 2) + 0.0 AS label FROM ({' UNION ALL '.join(parts)})"""


def hist_hour() -> str:
    return f"""{BASE},
    ends AS (
      SELECT 0.5 + floor(min(hour) - 0.5) AS origin, max(hour) AS hi FROM q1
    ),
    grid AS (
      SELECT unnest(generate_series(0, CAST(floor(hi + 1 - 1e-8 - origin) AS BIGINT) - 1)) AS bin,
        origin FROM ends
    ),
    binned AS (
      SELECT greatest(CAST(ceil(hour - origin - 1e-8) AS BIGINT) - 1, 0) AS bin, count(*) AS n
      FROM q1, ends WHERE hour IS NOT NULL GROUP BY 1
    )
    SELECT bin, {r('origin + bin')} AS xmin, {r('origin + bin + 1')} AS xmax,
      {r('origin + bin + 0.5')} AS x, coalesce(n, 0) AS n, {r('log10(nullif(n, 0))')} AS log_n
    FROM grid LEFT JOIN binned USING (bin)"""


def hist_speed_log() -> str:
    return f"""{BASE},
    ends AS (
      SELECT CAST(min(speed_limit) AS DOUBLE) AS lo, (max(speed_limit) - min(speed_limit)) / 14.0 AS w
      FROM q6
    ),
    binned AS (
      SELECT area_type,
        greatest(CAST(ceil((speed_limit - lo) / w + 0.5 - 1e-8) AS BIGINT) - 1, 0) AS bin,
        count(*) AS n
      FROM q6, ends WHERE speed_limit IS NOT NULL GROUP BY 1, 2
    ),
    grid AS (
      SELECT area_type, bin, lo, w FROM (SELECT DISTINCT area_type FROM q6), ends,
        (SELECT unnest(generate_series(0, 14)) AS bin)
    )
    SELECT area_type, bin, {r('lo + (bin - 0.5) * w')} AS xmin, {r('lo + (bin + 0.5) * w')} AS xmax,
      {r('lo + bin * w')} AS x, coalesce(n, 0) AS n, {r('log10(nullif(n, 0))')} AS log_n
    FROM grid LEFT JOIN binned USING (area_type, bin)"""


def kernel_tables(table: str, value: str, by: str) -> str:
    """Value counts ``vc`` and per-group bandwidth ``bw`` for groups of two rows or more."""
    return f"""
    vc AS (
      SELECT {by}, {value} AS v, count(*) AS m FROM {table} WHERE {value} IS NOT NULL GROUP BY ALL
    ),
    spread AS (
      SELECT {by}, count(*) AS n, min({value}) AS mn, max({value}) AS mx, stddev_samp({value}) AS sd,
        (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) / 1.34 AS iq
      FROM {table} WHERE {value} IS NOT NULL GROUP BY {by} HAVING count(*) >= 2
    ),
    bw AS (
      SELECT {by}, n, mn, mx, 0.9 * power(n, -0.2) * CASE WHEN least(sd, iq) > 0 THEN least(sd, iq)
        WHEN sd > 0 THEN sd WHEN mn <> 0 THEN abs(mn) ELSE 1 END AS h FROM spread
    ),
    steps AS (SELECT unnest(generate_series(0, 511)) AS i)"""


def curve_tables(by: str) -> str:
    """``curves``: points and densities of ``bounds``, which has ``n, h, lo, hi`` per group.

    Weights are binned linearly onto 512 points from four bandwidths before the curve
    to four behind it, the kernel is summed there, and the curve interpolates the sums.
    """
    same = " AND ".join(f"b.{c} IS NOT DISTINCT FROM vc.{c}" for c in by.split(", "))
    return f"""
    numbered AS (
      SELECT *, row_number() OVER () AS g, lo - 4 * h AS left_end, (hi - lo + 8 * h) / 511.0 AS step
      FROM bounds
    ),
    placed AS (
      SELECT g, m, (vc.v - left_end) / step AS pos FROM numbered b JOIN vc ON {same}
    ),
    halves AS (
      SELECT g, floor(pos) AS j, m * (1 - (pos - floor(pos))) AS w FROM placed
      UNION ALL SELECT g, floor(pos) + 1, m * (pos - floor(pos)) FROM placed
    ),
    weights AS (SELECT g, j, sum(w) AS w FROM halves GROUP BY g, j),
    sums AS (
      SELECT g, k.i AS k, sum(w * exp(-pow((j - k.i) * step / h, 2) / 2)) AS y
      FROM weights JOIN numbered USING (g), steps k GROUP BY g, k.i
    ),
    spots AS (
      SELECT *, lo + i * (hi - lo) / 511.0 AS x, (lo + i * (hi - lo) / 511.0 - left_end) / step AS pos
      FROM numbered, steps
    ),
    curves AS (
      SELECT {by}, i, x, ((1 - (pos - floor(pos))) * a.y + (pos - floor(pos)) * b.y)
        / (n * h * sqrt(2 * pi())) AS density
      FROM spots s JOIN sums a ON a.g = s.g AND a.k = floor(pos)
        JOIN sums b ON b.g = s.g AND b.k = floor(pos) + 1
    )"""


def kde_hour() -> str:
    return f"""{BASE}, {kernel_tables('q1', 'hour', 'day_type')},
    bounds AS (
      SELECT day_type, n, h, lo, hi FROM bw, (SELECT min(v) AS lo, max(v) AS hi FROM vc)
    ), {curve_tables('day_type')}
    SELECT day_type, CAST(i AS INTEGER) AS i, {r('x')} AS x, {r('density')} AS density FROM curves"""


def ridge_hour() -> str:
    return f"""{BASE}, {kernel_tables('q1', 'hour', 'day_of_week, day_type')},
    joint AS (
      SELECT h, (SELECT min(v) FROM vc) - 3 * h AS lo, (SELECT max(v) FROM vc) + 3 * h AS hi
      FROM (SELECT avg(h) AS h FROM bw)
    ),
    bounds AS (
      SELECT day_of_week, day_type, n, joint.h AS h, lo, hi FROM bw, joint WHERE n >= 3
    ), {curve_tables('day_of_week, day_type')}
    SELECT day_of_week, day_type, CAST(i AS INTEGER) AS i, {r('x')} AS x, {r('density')} AS density,
      {r('density / max(density) OVER ()')} AS height FROM curves"""


def violin_speed() -> str:
    return f"""{BASE}, {kernel_tables('q6', 'speed_limit', 'area_type')},
    bounds AS (SELECT area_type, n, h, mn AS lo, mx AS hi FROM bw), {curve_tables('area_type')}
    SELECT area_type, CAST(i AS INTEGER) AS i, {r('x')} AS x, {r('density')} AS density,
      {r('density / max(density) OVER ()')} AS width FROM curves"""


BOXES = """
    boxes AS (
      SELECT area_type, count(*) AS n, quantile_cont(number_of_casualties, 0.25) AS lower,
        quantile_cont(number_of_casualties, 0.5) AS middle,
        quantile_cont(number_of_casualties, 0.75) AS upper
      FROM q6 WHERE number_of_casualties IS NOT NULL GROUP BY area_type
    ),
    fenced AS (
      SELECT area_type, number_of_casualties AS v, n, lower, middle, upper,
        number_of_casualties NOT BETWEEN lower - 1.5 * (upper - lower)
          AND upper + 1.5 * (upper - lower) AS outside
      FROM q6 JOIN boxes USING (area_type) WHERE number_of_casualties IS NOT NULL
    )"""


RAW_COLUMNS = [
    "collision_year", "collision_index", "collision_ref_no", "local_authority_highway_current",
    "local_authority_district", "date", "time", "day_of_week", "collision_severity",
    "enhanced_severity_collision", "junction_detail", "urban_or_rural_area", "speed_limit",
    "number_of_vehicles", "number_of_casualties",
]


def guessed_types() -> str:
    """The narrowest type that every cell of a column can be read as."""
    more = {
        "half_limit": "speed_limit || '.5'",
        "month": "concat_ws('-', substr(date, 7, 4), substr(date, 4, 2), '05')",
        "padded": "'0' || collision_ref_no",
        "large": "collision_ref_no || '00000000'",
        "empty": "CAST(NULL AS VARCHAR)",
    }
    whole = "regexp_full_match(c, '[+-]?(0|[1-9][0-9]*)')"
    able = {
        "int": f"{whole} AND TRY_CAST(c AS INTEGER) IS NOT NULL",
        "bigint": f"{whole} AND TRY_CAST(c AS BIGINT) IS NOT NULL",
        "double": r"""regexp_full_match(c, '[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
          AND TRY_CAST(c AS DOUBLE) IS NOT NULL""",
        "time": "regexp_full_match(c, '([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?')",
        "date": "regexp_full_match(c, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(c AS DATE) IS NOT NULL",
    }
    cases = " ".join(f"WHEN bool_and({test}) FILTER (c IS NOT NULL) THEN '{name}'" for name, test in able.items())
    parts = [
        f"""SELECT {i} AS position, '{name}' AS "column",
          CASE WHEN count(c) = 0 THEN 'string' {cases} ELSE 'string' END AS type, count(c) AS n
          FROM (SELECT CAST({more.get(name, name)} AS VARCHAR) AS c FROM fx)"""
        for i, name in enumerate([*RAW_COLUMNS, *more], start=1)
    ]
    return f"{BASE} {' UNION ALL '.join(parts)}"


#: Sets of columns that the two reports count.
REPORT_SETS = [
    "hour", "number_of_casualties", "hour, number_of_casualties",
    "number_of_vehicles, number_of_casualties", "hour, speed_limit",
    "number_of_casualties, speed_limit", "day_type, hour", "day_of_week, day_type, hour",
    "day_of_week, hour", "hour, collision_severity", "area_type",
    "area_type, area_ord, speed_limit, number_of_casualties",
    "area_type, number_of_vehicles, number_of_casualties", "area_type, number_of_casualties",
    "area_type, speed_limit", "area_type, severity, severity_ord",
]


def report_counts() -> str:
    """Each set grouped by itself."""
    columns = list(dict.fromkeys(c for s in REPORT_SETS for c in s.split(", ")))
    kinds = {c: "VARCHAR" for c in ("day_type", "day_of_week", "collision_severity", "area_type", "severity")}
    parts = [
        "SELECT "
        + ", ".join(c if c in s.split(", ") else f"NULL::{kinds.get(c, 'INTEGER')} AS {c}" for c in columns)
        + f", {i} AS set, count(*) AS n FROM every GROUP BY {s}"
        for i, s in enumerate(REPORT_SETS)
    ]
    return f"""{BASE}, every AS (
        SELECT *, CASE WHEN urban_or_rural_area IN ('Urban', 'Rural') THEN urban_or_rural_area
            ELSE 'Unknown' END AS area_type,
          CASE urban_or_rural_area WHEN 'Urban' THEN 1 WHEN 'Rural' THEN 2 END AS area_ord
        FROM q1)
      {' UNION ALL '.join(parts)}"""


def statements() -> dict[str, str]:
    severity_counts = """
      SELECT area_type, severity, severity_ord, count(*) AS n FROM q6
      WHERE severity IS NOT NULL GROUP BY ALL"""
    return {
        "decode_codes": f"{BASE} SELECT * FROM decoded",
        "decode_all_shuffled": f"{BASE} SELECT * FROM decoded",
        "decode_join": f"""{BASE}, codes AS (
            SELECT CAST(k AS VARCHAR) AS code, concat('District ', k) AS label
            FROM (SELECT unnest(generate_series(0, 299)) AS k))
          SELECT collision_index, coalesce(label, local_authority_district)
            AS local_authority_district
          FROM fx LEFT JOIN codes ON code = local_authority_district""",
        "decode_join_shuffled": f"""{BASE}, codes AS (
            SELECT CAST(k AS VARCHAR) AS code, concat('District ', k) AS label
            FROM (SELECT unnest(generate_series(0, 299)) AS k))
          SELECT collision_index, coalesce(label, local_authority_district)
            AS local_authority_district
          FROM fx LEFT JOIN codes ON code = local_authority_district""",
        "decode_large_dictionaries": f"""{BASE} SELECT decoded.* REPLACE (
            coalesce('Order of ' || o_orderdate::DATE || ', customer ' || o_custkey, collision_ref_no)
              AS collision_ref_no,
            coalesce(c_name || ' in ' || c_mktsegment, local_authority_highway_current)
              AS local_authority_highway_current)
          FROM decoded LEFT JOIN orders ON o_orderkey::VARCHAR = collision_ref_no
            LEFT JOIN customer ON 'E' || c_custkey = local_authority_highway_current""",
        "clean_collisions": f"{BASE} SELECT * FROM cleaned",
        "null_summary": null_summary(),
        "null_summary_wide": f"""{BASE} SELECT count(*) - count(time) AS time,
          count(*) - count(day_of_week) AS day_of_week,
          count(*) - count(collision_severity) AS collision_severity,
          count(*) - count(number_of_casualties) AS number_of_casualties FROM cleaned""",
        "profile_structure": profile_structure(),
        "derive_time_features": f"""{BASE}
          SELECT date, time, day_of_week, hour, day_ord, day_type FROM q1""",
        "severity_positional": f"""{BASE}, ranked AS (
            SELECT code, dense_rank() OVER (ORDER BY code) AS severity_ord, n
            FROM (SELECT collision_severity AS code, count(*) AS n FROM fx
                  WHERE collision_severity IS NOT NULL GROUP BY 1))
          SELECT code AS collision_severity, ['Fatal', 'Serious', 'Slight'][severity_ord] AS severity,
            CAST(severity_ord AS INTEGER) AS severity_ord, n FROM ranked
          UNION ALL SELECT collision_severity, NULL, NULL, count(*) FROM fx
            WHERE collision_severity IS NULL GROUP BY 1""",
        "area_filtered_count": f"""{BASE}
          SELECT count(*) AS n, concat('Rows to analyse: ', count(*)) AS message FROM q6""",
        "describe_long": describe_long(),
        "area_summary": f"""{BASE} SELECT area_type, count(*) AS n,
          {r('avg(speed_limit)')} AS mean_speed,
          {r('median(number_of_casualties)')} AS median_casualties,
          {r('max(speed_limit)')} AS max_speed FROM q6 GROUP BY area_type""",
        "heatmap_day_hour": f"""{BASE}
          SELECT day_of_week, hour, count(*) AS n FROM q1 GROUP BY ALL""",
        "count_area": f"{BASE} SELECT area_type, count(*) AS n FROM q6 GROUP BY ALL",
        "count_speed_area": f"""{BASE}
          SELECT speed_limit, area_type, count(*) AS n FROM q6 GROUP BY ALL""",
        "facet_area_severity": f"""{BASE} SELECT *, max(n) OVER (PARTITION BY area_type) AS panel_max
          FROM (SELECT area_type, severity, count(*) AS n FROM q6 GROUP BY ALL)""",
        "stacked_log_severity": f"""{BASE}, counts AS (
            SELECT hour, severity, severity_ord, count(*) AS n, log10(count(*)) AS log_n
            FROM q1 WHERE hour IS NOT NULL GROUP BY ALL),
          stacked AS (
            SELECT *, sum(log_n) OVER (PARTITION BY hour ORDER BY severity_ord DESC NULLS FIRST
              ROWS UNBOUNDED PRECEDING) AS top FROM counts)
          SELECT hour, severity, severity_ord, n, {r('log_n')} AS log_n, {r('top')} AS ymax,
            {r('top - log_n')} AS ymin FROM stacked""",
        "severity_share": f"""{BASE}, counts AS ({severity_counts})
          SELECT area_type, severity, severity_ord, n,
            {r('100.0 * n / sum(n) OVER (PARTITION BY area_type)')} AS pct FROM counts""",
        "severity_fill": f"""{BASE}, counts AS ({severity_counts}),
          shares AS (
            SELECT *, 1.0 * n / sum(n) OVER (PARTITION BY area_type) AS share FROM counts),
          stacked AS (
            SELECT *, sum(share) OVER (PARTITION BY area_type ORDER BY severity_ord DESC
              ROWS UNBOUNDED PRECEDING) AS top FROM shares)
          SELECT area_type, severity, severity_ord, n, {r('100 * share')} AS pct,
            {r('share')} AS share, {r('top')} AS ymax, {r('top - share')} AS ymin FROM stacked""",
        "spearman_pair": spearman_pair(),
        "spearman_pairwise": spearman_pairwise(),
        "spearman_matrix": spearman_matrix(),
        "hist_hour": hist_hour(),
        "hist_speed_log": hist_speed_log(),
        "kde_hour": kde_hour(),
        "ridge_hour": ridge_hour(),
        "violin_speed": violin_speed(),
        "box_casualties": f"""{BASE}, {BOXES}
          SELECT area_type, n,
            {r('least(lower, min(v) FILTER (NOT outside))')} AS ymin, {r('lower')} AS lower,
            {r('middle')} AS middle, {r('upper')} AS upper,
            {r('greatest(upper, max(v) FILTER (NOT outside))')} AS ymax,
            count(*) FILTER (outside) AS n_outliers
          FROM fenced GROUP BY area_type, n, lower, middle, upper""",
        "box_outliers": f"""{BASE}, {BOXES}
          SELECT area_type, CAST(v AS DOUBLE) AS x, count(*) AS n FROM fenced WHERE outside
          GROUP BY ALL""",
        "csv_roundtrip": f"""{BASE} SELECT *,
            'line one, "quoted"' || chr(10) || 'line two; ' || number_of_vehicles AS note
            FROM cleaned""",
        "guessed_types": guessed_types(),
        "report_counts": report_counts(),
        "excel_guide": f"""{BASE}
          SELECT collision_severity, urban_or_rural_area, day_of_week, junction_detail,
            count(*) AS n FROM decoded GROUP BY ALL""",
    }
