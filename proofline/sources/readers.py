"""Reading items, outputs and labels from files or objects, with the checks that a run relies on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FORMATS = {".jsonl": "json", ".ndjson": "json", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".orc": "orc"}


class BadInput(ValueError):
    """An input that does not hold what it must."""


def read_source(spark: SparkSession, source, schema: T.StructType | None = None) -> DataFrame:
    """A path (by its ending), a Spark, pandas or Arrow table, or a list of mappings, as a DataFrame.

    Lines of JSON that are blank are skipped; one that is no object raises with its file. CSV cells that are blank are null
    and numbers are typed. Without a schema one pass over the file finds the types.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        kind = next((v for k, v in FORMATS.items() if source.rstrip("/").lower().endswith(k)), None)
        if kind is None:
            raise BadInput(f"{source}: expected one of {', '.join(FORMATS)}")
        reader = spark.read.schema(schema) if schema else spark.read
        if kind == "json":
            return _json_lines(spark, reader, source, schema)
        if kind == "csv":
            return reader.option("header", True).option("nullValue", "").option("inferSchema", schema is None).csv(source)
        return reader.format(kind).load(source)
    if hasattr(source, "to_dicts"):
        source = source.to_dicts()
    if isinstance(source, Iterable) and not hasattr(source, "columns") and not hasattr(source, "schema"):
        rows = list(source)
        if any(not isinstance(r, Mapping) for r in rows):
            raise BadInput("rows must be mappings")
        names = list(dict.fromkeys(k for r in rows for k in r))
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema or names)
    return spark.createDataFrame(source, schema)


def _json_lines(spark: SparkSession, reader, path: str, schema: T.StructType | None) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = lines.select("value", F.col("_metadata.file_path").alias("file")).filter(F.try_parse_json("value").isNull() | ~F.startswith(F.trim("value"), F.lit("{"))).limit(1).collect()
    if bad:
        raise BadInput(f"{bad[0].file}: not a JSON object: {bad[0].value[:80]!r}")
    return reader.option("mode", "FAILFAST").json(path)


def spread(df: DataFrame, key: str, least: int = 4 << 20, most: int = 1 << 30) -> DataFrame:
    """df dealt by key over all cores, if it is of `least` to `most` bytes and comes in fewer files than there are cores.

    A small file is one task, however much work its texts are. Larger tables come in many files and stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if least <= size <= most and len(df.inputFiles()) < cores else df


def _named(df: DataFrame, wanted: str, other: str) -> DataFrame:
    if wanted in df.columns:
        return df
    if other in df.columns:
        return df.withColumnRenamed(other, wanted)
    raise BadInput(f"no column {wanted} or {other}")


def _refuse(df: DataFrame, bad, what: str) -> DataFrame:
    if not df.filter(bad).limit(1).isEmpty():
        raise BadInput(what)
    return df


def read_items(spark: SparkSession, source) -> DataFrame:
    """(item_id, text, metadata): every other column goes into the map."""
    df = _named(read_source(spark, source), "item_id", "id")
    if "text" not in df.columns:
        raise BadInput("no column text")
    _refuse(df, F.col("item_id").isNull() | (F.trim(F.col("item_id").cast("string")) == "") | F.col("text").isNull(), "an item has no id or no text")
    rest = [c for c in df.columns if c not in ("item_id", "text")]
    meta = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"), meta.alias("metadata"))


def read_outputs(spark: SparkSession, source) -> DataFrame:
    df = _named(read_source(spark, source), "item_id", "id")
    return _refuse(df, F.col("item_id").isNull(), "an output has no item_id").withColumn("item_id", F.col("item_id").cast("string"))


def outputs_long(outputs: DataFrame) -> DataFrame:
    """(item_id, field, value) of every field."""
    fields = [c for c in outputs.columns if c != "item_id"]
    return outputs.select("item_id", *(F.col(c).cast("string").alias(c) for c in fields)).unpivot("item_id", fields, "field", "value")


def read_labels(spark: SparkSession, source) -> DataFrame:
    df = read_source(spark, source)
    names = ("item_id", "field", "label", "annotator")
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise BadInput(f"labels have no column {', '.join(missing)}")
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return _refuse(df, bad, "a label has an empty cell").select(*(F.col(c).cast("string").alias(c) for c in names))
