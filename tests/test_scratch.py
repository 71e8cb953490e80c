"""Where tables go that are written only to be read again."""

from unittest.mock import MagicMock

import pytest

from proofline.sources.scratch import scratch, stored


def test_a_cluster_needs_a_shared_folder():
    spark = MagicMock()
    spark.sparkContext.master, spark.conf.get.return_value = "spark://host:7077", None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(spark, "x")
    spark.conf.get.return_value = "hdfs://shared/folder"
    assert scratch(spark, "x").startswith("hdfs://shared/folder/x-") and scratch(spark, "x") != scratch(spark, "x")


def test_a_stored_table_is_that_table(spark):
    df = spark.createDataFrame([("1", [1, 2]), ("2", []), ("3", None)], "item_id string, shingles array<long>")
    assert sorted(map(str, stored(df, "t").collect())) == sorted(map(str, df.collect()))
    assert stored(df.limit(0), "t").isEmpty()


def test_a_small_file_is_dealt_over_the_cores(spark, tmp_path):
    from proofline.sources.readers import spread

    spark.range(100).selectExpr("id AS doc_id", "repeat('x', 10) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(spread(df, "doc_id", least=1)) and spread(df, "doc_id", least=1).count() == 100
    assert "Repartition" not in plan(spread(df, "doc_id")) and "Repartition" not in plan(spread(df, "doc_id", least=1, most=2))
    many = df.repartition(cores)
    many.write.parquet(str(tmp_path / "m"))
    assert "Repartition" not in plan(spread(spark.read.parquet(str(tmp_path / "m")), "doc_id", least=1))
