"""Shapes of plans, and the command line from raw CSV to report tables."""

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as registry
import fixtures
from collidera.__main__ import main
from collidera.operators.clean import clean
from collidera.operators.counts import value_counts
from collidera.operators.decode import code_book, decode
from collidera.plans import areas, hours
from collidera.plans.prepare import prepared
from collidera.sources import shared_folder, tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def collisions(spark):
    return fixtures.collisions(spark, SF_DIR)


@pytest.fixture(scope="module")
def book(spark, collisions):
    return code_book(fixtures.guide_table(spark), collisions.columns)


@pytest.fixture(scope="module")
def cleaned(collisions, book):
    return prepared(collisions, book)


def test_decoding_is_one_pass_with_broadcasts(collisions, book):
    plan = plan_of(decode(collisions, book))
    assert plan.count("BroadcastNestedLoopJoin") == 1
    assert plan.count("BroadcastHashJoin") == 1
    assert plan.count("sf0.001/events.parquet") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


def test_only_needed_columns_are_read_and_decoded(cleaned):
    plan = plan_of(value_counts(hours.features(cleaned), ["hour"]))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    assert "HashJoin" not in plan


def test_areas_are_read_from_three_columns(cleaned):
    plan = plan_of(areas.severity_shares(areas.features(cleaned)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    assert "HashJoin" not in plan and plan.count("sf0.001/events.parquet") == 1


#: Queries that need Python workers: records over line breaks, and workbooks.
WITH_PYTHON = {"csv_roundtrip", "excel_guide"}


@pytest.fixture
def written_plans(monkeypatch):
    """Plans of all tables that are written on the way, which hide below the ones read back."""
    plans = []
    for name in ("parquet", "csv"):
        write = getattr(DataFrameWriter, name)

        def keeping(self, *args, write=write, **named):
            plans.append(plan_of(self._df))
            return write(self, *args, **named)

        monkeypatch.setattr(DataFrameWriter, name, keeping)
    return plans


@pytest.mark.parametrize("name", sorted(registry._own_queries()))
def test_no_python_in_any_query(spark, name, written_plans):
    registry.forget()
    plans = [plan_of(registry.queries()[name](spark, SF_DIR)), *written_plans]
    python = [p for p in plans if "Python" in p or "InPandas" in p or "InArrow" in p or "ArrowEval" in p]
    assert bool(python) == (name in WITH_PYTHON)


def test_preparation_also_runs_on_a_stream(spark, collisions, book, cleaned, tmp_path):
    path = str(tmp_path / "raw")
    collisions.write.parquet(path)
    stream = clean(decode(spark.readStream.schema(collisions.schema).parquet(path), book))
    query = (
        stream.writeStream.format("memory")
        .queryName("prepared_stream")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.table("prepared_stream")
    assert got.schema == cleaned.schema
    assert sorted(got.collect(), key=str) == sorted(cleaned.collect(), key=str)


def rounded(rows):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str
    )


def test_command_line(spark, cleaned, tmp_path):
    raw, guide = str(tmp_path / "raw.csv"), str(tmp_path / "guide.xlsx")
    decoded, out = str(tmp_path / "decoded.csv"), str(tmp_path / "cleaned.csv")
    tables.write_csv(fixtures.collisions(spark, SF_DIR), raw, null="")
    with open(guide, "wb") as file:
        file.write(fixtures.guide_workbook())
    main(["decode", raw, guide, decoded])
    main(["clean", decoded, out])
    back = tables.read_table(spark, out, tables.CLEANED_TYPES)
    assert back.schema == cleaned.schema
    assert sorted(back.collect(), key=str) == sorted(cleaned.collect(), key=str)

    laid_down = list(shared_folder._written[spark.sparkContext.applicationId])
    main(["report", "all", out, str(tmp_path / "reports")])
    assert shared_folder._written[spark.sparkContext.applicationId] == laid_down
    for name, plan in {"hours": hours, "areas": areas}.items():
        features = plan.features(cleaned)
        for table, operator in plan.TABLES.items():
            written = spark.read.parquet(str(tmp_path / "reports" / name / table))
            direct = operator(features)
            assert written.columns == direct.columns
            assert rounded(written.collect()) == rounded(direct.collect()), table
    missing = spark.read.parquet(str(tmp_path / "reports" / "hours" / "missing_values"))
    assert missing.collect() == hours.missing_values(cleaned).collect()
