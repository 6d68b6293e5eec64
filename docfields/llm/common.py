"""Shared helpers of the training-data operators: table reading, the shared scratch folder, samples and task-side iteration."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship

#: Rows, and bytes of text, that a task turns into Python objects at once; a longer text is taken alone.
SLICE, SLICE_BYTES = 4096, 2 << 20
#: Rows that Spark sends to a Python task at once, in place of its default of 10,000, which is 100 MB of texts of 10 KB in the
#: executor and again in the worker. Any other setting of the session stays.
BATCH_ROWS, BATCH_DEFAULT = "1000", "10000"


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the package shipped and Arrow batches fit for texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == BATCH_DEFAULT:
        spark.conf.set(key, BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one is made only in local mode, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docfields-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = tuned(df.sparkSession)
    path = f"{scratch(spark)}/docfields-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids hash as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sampled(df: DataFrame, id_col: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of the id, so the same rows at every run. `rows` is an upper limit too."""
    if total <= rows:
        return df
    grid = 1 << 30
    return df.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(grid)) < int(grid * rows / total)).limit(int(rows * 1.2) + 10)


def parts_of(batches: Iterable[pa.RecordBatch], text_col: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE rows and SLICE_BYTES of text, one row at least."""
    for batch in batches:
        texts = batch.column(text_col)
        length = pc.list_value_length if pa.types.is_list(texts.type) else pc.binary_length
        ends = np.cumsum(pc.fill_null(length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            most = SLICE_BYTES + (ends[start - 1] if start else 0)
            stop = min(start + SLICE, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


def _give_back() -> None:
    """At the end of a task, returns memory that Arrow and the C library keep for later: the worker may go on to other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Lists of the named columns, slice by slice; texts stand in the last one."""
    for part in parts_of(batches, columns[-1]):
        yield tuple(part.column(c).to_pylist() for c in columns)


def words_of(texts: pa.Array, split: Callable[[pa.Array], pa.ListArray] = pc.ascii_split_whitespace) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each text's words begin and end, the number of each word, the distinct words by number)."""
    lists = split(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        words = words.filter(pa.array(real))
    coded = words.dictionary_encode()
    return ends, coded.indices.to_numpy(), coded.dictionary


def rows_where(df: DataFrame, text_col: str, make: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of df, with all columns, whose text (null as empty) passes; make() gives a task its test. No shuffle, no key."""
    tuned(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for part in parts_of(batches, at):
            yield part.filter(pa.array([passes(t or "") for t in part.column(at).to_pylist()], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Memory(dict):
    """What `make` gives for the keys met of late, in about `most_bytes` at most, if a key and what it stands for take `each` bytes
    beside the key's characters. Keys of over 64 characters are not kept. Meant to live for one task: `clear` it at the end, since
    Python workers go on to serve other stages."""

    def __init__(self, make: Callable, most_bytes: int, each: int = 200) -> None:
        super().__init__()
        self.make, self.most, self.each, self.held, self.old = make, most_bytes // 2, each, 0, {}

    def met(self, key):
        """What the key stands for if it is remembered, else None."""
        return self.get(key) or self.old.get(key)

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if self.held >= self.most:
                self.old = dict(self)
                super().clear()
                self.held = 0
            self[key] = found
            self.held += self.each + 4 * len(key)
        return found

    def clear(self) -> None:
        super().clear()
        self.old, self.held = {}, 0
