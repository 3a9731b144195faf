"""Command line: ``spark-submit`` or ``python -m collidera <step> ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession

from collidera.functions.levels import in_level_order
from collidera.plans import hours
from collidera.plans.prepare import REPORTS, clean_step, decode_step, null_metrics, report_cube
from collidera.sources.shared_folder import released
from collidera.sources.tables import CLEANED_TYPES, read_table, write_table


def report_step(spark: SparkSession, names: Sequence[str], cleaned: str, out: str) -> None:
    """Write every table of the named reports, each below ``out/<report>``.

    The cleaned table is scanned once for all of them.
    """
    with released(spark):
        seen = Observation()
        df, counted = null_metrics(read_table(spark, cleaned, CLEANED_TYPES), seen)
        cubes = report_cube(df, names)
        for report, cube in cubes.items():
            if report == "hours":
                found = dict(counted()[0].collect())
                rows = [tuple(found.get(c, 0) for c in hours.CHECKED)]
                schema = ", ".join(f"{c} bigint" for c in hours.CHECKED)
                missing = spark.createDataFrame(rows, schema)
                write_table(missing, f"{out}/{report}/missing_values")
            for name, table in REPORTS[report].TABLES.items():
                write_table(in_level_order(table(cube)), f"{out}/{report}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="collidera", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    step = steps.add_parser("decode", help="codes to labels")
    for name in ("raw", "guide", "out"):
        step.add_argument(name)
    step = steps.add_parser("clean", help="sentinels to nulls, dates, types")
    for name in ("decoded", "out"):
        step.add_argument(name)
    step = steps.add_parser("report", help="all tables of a report, or of all reports")
    step.add_argument("name", choices=[*sorted(REPORTS), "all"])
    for name in ("cleaned", "out"):
        step.add_argument(name)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"collidera {args.step}").getOrCreate()
    if args.step == "decode":
        decode_step(spark, args.raw, args.guide, args.out)
    elif args.step == "clean":
        for table in clean_step(spark, args.decoded, args.out):
            table.show(truncate=False)
    else:
        names = sorted(REPORTS) if args.name == "all" else [args.name]
        report_step(spark, names, args.cleaned, args.out)


if __name__ == "__main__":
    main()
