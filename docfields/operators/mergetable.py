"""A stored table of fields that takes edits by merge-on-read.

Below the table's folder:

    base/gen=G/bucket=B      fields of a bucket (a hash of the id), as the generation that wrote them left them
    changes/seq=N/bucket=B   the edits of one append; they stay, as the audit trail
    commits/commit=C         one file: the buckets' generations and the appends that are not yet in them

An append writes its edits and a commit, nothing else. Readers merge the base with what is pending, and read only the buckets they
need. Compaction rewrites the buckets whose pending edits have outgrown a share of their rows. An operation counts from its commit
on, which is one file, so a failed one leaves nothing that readers see, and may be tried again. One writer at a time.

A field's last edit in the order of (created_at, id) wins, in whatever order edits arrive; so an edit that is appended again changes
nothing. An edit id that comes again with other content counts as it came first, while it is pending or the field's last; compaction
forgets the ids of edits that others have replaced. Edits without an id or a field, and edits of unknown fields, change nothing.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from docfields.operators import edits

STATE = "kind string, bucket int, number long, rows long, note string"
CHANGE = "id long, field_id long, new_value string, created_at timestamp"
_LAST = "_edited_at timestamp, _edited_by long"


class FieldTable:
    """Fields have at least id, field_value, is_edited and original_value; edits id, field_id, new_value and created_at. Columns bucket
    and gen, and names that begin with `_`, are the table's own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, fields: DataFrame, path: str, buckets: int = 256) -> FieldTable:
        table = cls(fields.sparkSession, path)
        columns = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _LAST.split(", ")]
        base = fields.select("*", *columns)
        counts = table._write(base, "id", buckets, "base/gen=0")
        table._commit(0, [("table", None, -1, buckets, base.schema.json()), *[("base", b, 0, n, None) for b, n in counts.items()]])
        return table

    def _state(self) -> tuple[int, list]:
        """The newest commit's number and rows: one for a bucket and one for a bucket's part in a pending append."""
        commits = self.spark.read.schema(f"{STATE}, commit long").parquet(f"{self.path}/commits")
        last = commits.agg(F.max("commit")).first()[0]
        return last, [tuple(r)[:5] for r in commits.where(F.col("commit") == last).collect()]

    def _commit(self, number: int, rows: list) -> None:
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={number}")

    def _write(self, df: DataFrame, key: str, buckets: int, folder: str) -> dict[int, int]:
        """Writes rows by bucket, large buckets in several files, and counts them."""
        dealt = df.withColumn("bucket", _bucket(F.col(key), buckets))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        back = self.spark.read.schema(dealt.schema).parquet(f"{self.path}/{folder}")
        return {r.bucket: r["count"] for r in back.groupBy("bucket").count().collect()}

    def _read(self, kind: str, folder: str, rows: list, schema: StructType | str, only: set[int] | None) -> DataFrame:
        """Rows of the listed buckets, with their number (generation or append)."""
        name = folder.split("=")[0].split("/")[1]
        full = StructType(self.spark.createDataFrame([], schema).schema.fields).add("bucket", IntegerType()).add(name, LongType())
        paths = [f"{self.path}/{folder}{n}/bucket={b}" for k, b, n, *_ in rows if k == kind and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{folder.split('/')[0]}").parquet(*paths)

    def append(self, changes: DataFrame, number: int | None = None) -> None:
        """Adds edits. Numbers go up from 0; one that was committed before is left out, so a writer that isn't sure may try again."""
        last, rows = self._state()
        (_, _, top, buckets, note), *rest = sorted(rows, key=lambda r: r[0] != "table")
        if number is not None and number <= top:
            return
        if number not in (None, top + 1):
            raise ValueError(f"the next append has number {top + 1}, not {number}")
        wanted = changes.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGE.split(", ")])
        counts = self._write(wanted.where("id IS NOT NULL AND field_id IS NOT NULL"), "field_id", buckets, f"changes/seq={top + 1}")
        self._commit(last + 1, [("table", None, top + 1, buckets, note), *rest, *[("changes", b, top + 1, n, None) for b, n in counts.items()]])

    def _merged(self, rows: list, only: set[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(next(r[4] for r in rows if r[0] == "table")))
        base = self._read("base", "base/gen=", rows, schema, only).select(*schema.names)
        pending = _once(self._read("changes", "changes/seq=", rows, CHANGE, only))
        newest = pending.groupBy(F.col("field_id").alias("id")).agg(F.max(F.struct("created_at", F.col("id").alias("by"), "new_value")).alias("_new"))
        joined = base.join(newest, "id", "left")
        found, edited = F.col("_new").isNotNull(), F.coalesce("is_edited", F.lit(False))
        later = found & (F.col("_edited_by").isNull() | ((F.col("_new.by") != F.col("_edited_by")) & (F.struct("_new.created_at", "_new.by") > F.struct("_edited_at", "_edited_by"))))
        new = {
            "original_value": F.when(found & ~edited, F.col("field_value")).otherwise(F.col("original_value")),
            "field_value": F.when(later, F.col("_new.new_value")).otherwise(F.col("field_value")),
            "is_edited": found | edited,
            "_edited_at": F.when(later, F.col("_new.created_at")).otherwise(F.col("_edited_at")),
            "_edited_by": F.when(later, F.col("_new.by")).otherwise(F.col("_edited_by")),
        }
        return joined.withColumns(new).select(*schema.names)

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The fields as they are now; with `ids` (a column id) those fields alone, from their buckets alone."""
        _, rows = self._state()
        only = None
        if ids is not None:
            buckets = next(r[3] for r in rows if r[0] == "table")
            only = {r.b for r in ids.select(_bucket(F.col("id"), buckets).alias("b")).distinct().collect()}
        out = self._merged(rows, only).drop("_edited_at", "_edited_by")
        return out if ids is None else out.join(ids.select("id"), "id", "left_semi")

    def history(self) -> DataFrame:
        """All committed edits, each once."""
        _, rows = self._state()
        top = next(r[2] for r in rows if r[0] == "table")
        if top < 0:
            return self.spark.createDataFrame([], CHANGE)
        return _once(self.spark.read.schema(f"{CHANGE}, bucket int, seq long").parquet(f"{self.path}/changes").where(F.col("seq") <= top))

    def value_as_of(self, at: datetime) -> DataFrame:
        return edits.value_as_of(self.current(), self.history(), at)

    def compact(self, share: float = 0.1) -> set[int]:
        """Rewrites the buckets with more pending edits than `share` of their rows; returns them."""
        last, rows = self._state()
        size = {b: n for k, b, _, n, _ in rows if k == "base"}
        waiting: dict[int, int] = {}
        for k, b, _, n, _ in rows:
            if k == "changes":
                waiting[b] = waiting.get(b, 0) + n
        full = {b for b, n in waiting.items() if n > share * size.get(b, 0)}
        if not full:
            return full
        (_, _, top, buckets, note), *_ = [r for r in rows if r[0] == "table"]
        gen = last + 1
        counts = self._write(self._merged(rows, full), "id", buckets, f"base/gen={gen}")
        stay = [r for r in rows if r[0] != "table" and r[1] not in full]
        self._commit(gen, [("table", None, top, buckets, note), *stay, *[("base", b, gen, n, None) for b, n in counts.items()]])
        return full


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _once(changes: DataFrame) -> DataFrame:
    """An edit id of a field counts as it came first."""
    first = changes.groupBy("field_id", "id").agg(F.min(F.struct("seq", "created_at", "new_value")).alias("_c"))
    return first.select("id", "field_id", "_c.new_value", "_c.created_at")
