"""Ordered parts: what lies in the files, pages, and writes that fail."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docfields.operators.ordered import OrderedParts


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_parts_end_to_end_are_in_order_and_pages_read_few_parts(spark, tmp_path, fmt):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(40))).alias("day"), F.concat(F.lit("a\"b,\n"), F.col("id").cast("string")).alias("name")).repartition(7)
    want = [tuple(r) for r in df.orderBy(F.desc("day"), "id").collect()]
    parts = OrderedParts.write(df, str(tmp_path / "t"), ["day desc", "id"], fmt, rows=300)
    listed = parts.manifest.orderBy("first").collect()
    assert max(p.rows for p in listed) <= 300 and sum(p.rows for p in listed) == 5000
    if fmt == "json":
        lines = [json.loads(line) for p in listed for line in Path(tmp_path / "t" / p.folder / p.file).read_text().splitlines()]
        assert [r["id"] for r in lines] == [w[0] for w in want]
    for skip, limit in ((0, 20), (2990, 300), (4990, 20), (5000, 10)):
        page = OrderedParts(spark, str(tmp_path / "t")).page(skip, limit)
        assert [tuple(r) for r in page.collect()] == want[skip : skip + limit]
        assert len(page.inputFiles()) <= 3
    numbered = parts.numbered().orderBy("place").collect()
    assert [tuple(r)[:3] for r in numbered] == want and [r.place for r in numbered] == list(range(5000))


def test_a_write_that_fails_leaves_no_manifest_and_an_empty_table_has_empty_pages(spark, tmp_path):
    with pytest.raises(PySparkException):
        OrderedParts.write(spark.range(100).select("id", F.raise_error("no").cast("string").alias("x")), str(tmp_path / "t"), ["id"])
    with pytest.raises(PySparkException):
        OrderedParts(spark, str(tmp_path / "t")).page(0, 1)
    done = OrderedParts.write(spark.range(10), str(tmp_path / "t"), ["id desc"])
    with pytest.raises(PySparkException):
        OrderedParts.write(spark.range(100).select((F.col("id") + F.when(F.col("id") > 90, F.raise_error("no").cast("long")).otherwise(0)).alias("id")), str(tmp_path / "t"), ["id"])
    assert [r.id for r in done.page(2, 3).collect()] == [7, 6, 5]
    none = OrderedParts.write(spark.range(0), str(tmp_path / "none"), ["id"])
    assert none.page(0, 5).collect() == [] and none.numbered().collect() == []
