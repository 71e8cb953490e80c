"""Run folders, findings, risk rows, the append-only verdict log and the run index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def run_name(run_id: str, when: datetime, taken: set[str] = frozenset()) -> str:
    """`YYYY-mm-dd_HHMM_<id>`, with a number behind it if that is taken."""
    name = f"{when:%Y-%m-%d_%H%M}_{run_id}"
    k = 2
    while name in taken or (k > 2 and f"{name}-{k - 1}" in taken):
        if f"{name}-{k}" not in taken:
            return f"{name}-{k}"
        k += 1
    return name


def run_names(runs: DataFrame) -> DataFrame:
    """(project, run_id, name) of runs (project, run_id, at): run_name() for a whole table, later ids of one name with a number behind."""
    name = F.concat_ws("_", F.date_format("at", "yyyy-MM-dd"), F.date_format("at", "HHmm"), "project")
    k = F.row_number().over(Window.partitionBy("name").orderBy("run_id"))
    return runs.withColumn("name", name).withColumn("k", k).select("project", "run_id", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "k")).alias("name"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls written as such."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def append_verdicts(df: DataFrame, path: str) -> None:
    """The log grows and is never rewritten; key names the question."""
    df.write.mode("append").parquet(path)


def append_index(spark: SparkSession, path: str, entry: dict) -> None:
    spark.createDataFrame([(entry["project"], entry["run_id"], entry["at"], entry.get("items", 0), entry.get("calls", 0))], "project string, run_id string, at timestamp, items long, calls long").write.mode("append").partitionBy("project").parquet(path)


def latest_run(index: DataFrame, project: str) -> DataFrame:
    return index.filter(F.col("project") == project).agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
