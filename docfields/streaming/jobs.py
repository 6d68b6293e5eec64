"""Incremental jobs over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docfields.operators.edits import apply_edits
from docfields.operators.mergetable import FieldTable


def daily_step_status(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Step and status counts for each day, of a stream or a table; a stream drops rows later than the watermark."""
    rows = logs.withWatermark("created_at", late) if logs.isStreaming else logs
    counted = rows.groupBy(F.window("created_at", "1 day").alias("w"), "step", "status").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "step", "status", "n")


def current_values(edits: DataFrame, fields: DataFrame, path: str) -> DataStreamWriter:
    """Writes a snapshot of the fields for each micro-batch under path/batch=N: the newest earlier snapshot (`fields`, if there is
    none) with the batch's edits applied. All state is in the folder, so a restart goes on where the last batch ended; a batch
    that is tried again overwrites its own snapshot. Ids of edits that were taken are kept under path/taken/batch=N, and an edit
    whose id was taken by this or an earlier batch is left out."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "batch=*/_SUCCESS"))
        earlier = [n for n in (int(f.getPath().getParent().getName().split("=")[1]) for f in found or []) if n < number]
        once = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("created_at"))).where("_n = 1").drop("_n")
        if earlier:
            once = once.join(spark.read.parquet(*[f"{path}/taken/batch={n}" for n in earlier]), "id", "left_anti")
        last = spark.read.parquet(f"{path}/batch={max(earlier)}") if earlier else fields
        once.select("id").write.mode("overwrite").parquet(f"{path}/taken/batch={number}")
        new, _ = apply_edits(last, once)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edits.writeStream.foreachBatch(apply)


def merged_values(edits: DataFrame, path: str, share: float = 0.25) -> DataStreamWriter:
    """Appends each micro-batch to the FieldTable at `path`: a batch costs what its own edits cost, and now and then the compaction of
    the buckets that have filled up. A batch that is tried again is known by its number; a stream with a new checkpoint begins at
    number 0, so it needs a new table. The current values are `FieldTable(spark, path).current()`, at any time."""

    def apply(batch: DataFrame, number: int) -> None:
        table = FieldTable(batch.sparkSession, path)
        table.append(batch, number)
        table.compact(share)

    return edits.writeStream.foreachBatch(apply)
