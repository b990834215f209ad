"""From a raw file to a clean table and a report, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators import charts, clean as cleaning, profile as profiles
from tablewright.sources.files import export_csv, read_table_file
from tablewright.sources.tables import replace_files

STEP_SCHEMA = "step int, name string, target string, row_count long"


@dataclass
class FlowResult:
    clean: DataFrame
    report: DataFrame
    cleaning_log: DataFrame
    steps: DataFrame


def run_flow(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    order_by: list[str] | None = None,
    plan: cleaning.Plan | None = None,
) -> FlowResult:
    """Ingest, clean and report; every stage is written below ``target`` and read back.

    Writing the stages keeps a lost executor from recomputing earlier ones.
    """
    raw = read_table_file(spark, source) if isinstance(source, str) else source
    raw = replace_files(raw, f"{target}/raw")
    cleaned = cleaning.clean(raw, plan, order_by)
    data = replace_files(cleaned.data, f"{target}/clean")
    profile = profiles.with_role(profiles.with_semantic(profiles.column_profile(data, samples=0)))
    group, value = charts.report_columns(data, profiles.roles(profile))
    report = replace_files(charts.group_report(data, group, value), f"{target}/report")
    export_csv(data, f"{target}/clean_csv")
    export_csv(report, f"{target}/report_csv")
    stages = {"ingest": ("raw", raw), "clean": ("clean", data), "report": ("report", report)}
    counted = None
    for i, (name, (folder, df)) in enumerate(stages.items()):
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(i).alias("step"), F.lit(name).alias("name"), F.lit(folder).alias("target"), "row_count"
        )
        counted = row if counted is None else counted.unionByName(row)
    return FlowResult(data, report, cleaned.log, counted.orderBy("step"))
