"""Tables that cut lineage: written once to the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is made only in local mode, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docfields-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/docfields-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, exchange: bool = True) -> DataFrame:
    """A table of `buckets` buckets by a key, sorted by it within each. Joins and groups that have the key among their columns need no
    exchange of such tables. Without `exchange`, rows must come from a plan that is dealt by the same key and number already;
    then each task writes one bucket."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    dealt = df.repartition(buckets, key) if exchange else df
    table = f"docfields_{tag}_{name}"
    dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/docfields-{tag}/{name}").format("parquet").saveAsTable(table)
    return spark.table(table)
