"""Tables stored in an order: exports whose parts can be put end to end, and listings by pages.

Rows are dealt to parts by ranges of the sort keys, each part is sorted and holds a bounded number of rows, and a manifest with each
part's rows and the number of its first row is written last. Until then there is nothing to read; parts that a failed write has left
behind are in a folder of their own that no manifest names. A page is read from the one or two parts that hold its rows,
wherever in the table it is. Keys should end with a unique one, or rows that tie have no fixed order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "folder string, file string, rows long, first long, format string, keys string, columns string"


class OrderedParts:
    """keys: names of columns, `name desc` for falling ones (nulls first in rising order, last in falling order)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    @staticmethod
    def _order(keys: list[str]) -> list[Column]:
        return [F.desc(k.removesuffix(" desc")) if k.endswith(" desc") else F.asc(k) for k in keys]

    @classmethod
    def write(cls, df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", rows: int = 100_000) -> OrderedParts:
        """Parts of at most `rows` rows. CSV parts have no header; the manifest names the columns. A table that is there is replaced."""
        spark, path = df.sparkSession, path.rstrip("/")
        folder = f"parts-{uuid.uuid4().hex}"
        df.orderBy(*cls._order(keys)).write.option("maxRecordsPerFile", rows).format(fmt).save(f"{path}/{folder}")
        back = cls._reader(spark, fmt, df.schema.toDDL()).load(f"{path}/{folder}")
        counts = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
        number = [F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)\.", k).cast("long") for k in (1, 2)]
        before = F.sum("rows").over(Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
        fixed = {"folder": folder, "format": fmt, "keys": "|".join(keys), "columns": df.schema.toDDL()}
        made = counts.select("file", "rows", F.coalesce(before, F.lit(0)).alias("first"), *[F.lit(v).alias(k) for k, v in fixed.items()])
        empty = spark.createDataFrame([(folder, None, 0, 0, *list(fixed.values())[1:])], MANIFEST)
        (made if made.take(1) else empty).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        return cls(spark, path)

    @staticmethod
    def _reader(spark: SparkSession, fmt: str, columns: str):
        return spark.read.format(fmt).schema(columns).option("multiLine", fmt == "csv").option("escape", "\\")

    def _read(self, fixed, files: list[str]) -> DataFrame:
        paths = [f"{self.path}/{fixed.folder}/{f}" for f in files]
        return self._reader(self.spark, fixed["format"], fixed["columns"]).load(paths) if paths else self.spark.createDataFrame([], fixed["columns"])

    def page(self, skip: int, limit: int) -> DataFrame:
        """Rows skip .. skip + limit - 1 in their order."""
        fixed = self.manifest.first()
        parts = self.manifest.where((F.col("first") < skip + limit) & (F.col("first") + F.col("rows") > skip)).orderBy("first").collect()
        rows = self._read(fixed, [p.file for p in parts]).orderBy(*self._order(fixed["keys"].split("|")))
        return rows.offset(skip - parts[0]["first"] if parts else 0).limit(limit)

    def numbered(self, name: str = "place") -> DataFrame:
        """All rows with their numbers from 0. A part's rows are numbered in one task; its size is bounded."""
        fixed = self.manifest.first()
        rows = self._reader(self.spark, fixed["format"], fixed["columns"]).load(f"{self.path}/{fixed.folder}")
        columns = rows.columns
        named = rows.select("*", F.col("_metadata.file_name").alias("_file"))
        starts = self.manifest.where("file IS NOT NULL").select(F.col("file").alias("_file"), F.col("first").alias("_first"))
        place = F.row_number().over(Window.partitionBy("_file").orderBy(*self._order(fixed["keys"].split("|")))) - 1
        return named.join(starts, "_file").withColumn(name, (F.col("_first") + place).cast("long")).select(*columns, name)
