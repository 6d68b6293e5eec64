"""Stored analyses: documents are dealt out before their analyses are made, and paths are taken in one go."""

import json

import pytest
from pyspark.sql import functions as F

from docfields.operators import extraction, layout
from docfields.plans import registry
from docfields.sources import files


@pytest.mark.parametrize("part", [0, 1])
def test_a_file_of_one_part_is_worked_on_by_many_tasks(spark, part):
    analyses = registry._stored_layouts(spark, "/root/testdata/sf0.001")[part]
    spread = analyses.select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread == 4  # spark.sql.shuffle.partitions of the tests


def test_paths_that_give_nothing_are_looked_up(spark):
    rows = [
        {"document_id": 1, "page_number": 1, "words": None},
        {"document_id": "2", "page_number": 1.0, "words": [{"content": 5, "confidence": "high"}, None, 7], "paragraphs": []},
        {"document_id": 3, "page_number": 1, "tables": {}},
        {"document_id": 4, "page_number": 1, "lines": "x"},
        {"document_id": {}, "page_number": 1},
        [{"document_id": 6, "page_number": []}, {"document_id": 7, "page_number": 2}],
        "text",
    ]
    texts = spark.createDataFrame([("f", json.dumps(r)) for r in rows], "file string, value string")
    kept, aside = files.declared(files.raw_texts(texts), layout.ANALYSIS)
    got = {r.document_id: r for r in kept.collect()}
    assert sorted(got) == [1, 2, 7] and got[1].words is None and got[2].paragraphs == [] and got[2].page_number == 1
    assert [w and (w.content, w.confidence) for w in got[2].words] == [("5", None), None, None]
    assert sorted(r.reason for r in aside.collect()) == ["document_id is no bigint", "lines is no list", "no document_id", "page_number is no int", "tables is no list"]


def test_a_run_over_dealt_analyses_deals_no_boxes(spark, monkeypatch):
    plans, written = {}, extraction.bucketed

    def spy(df, name, key, buckets, exchange=True):
        plans[name] = (exchange, df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, key, buckets, exchange)

    monkeypatch.setattr(extraction, "bucketed", spy)
    assert registry.QUERIES["located_fields"](spark, "/root/testdata/sf0.001").count()
    exchange, shown = plans["analyses"]
    # The one exchange is of texts, below what makes boxes of them; pages are decoded a few at a time.
    assert not exchange and shown.count("Exchange") == 1 and shown.index("Generate") < shown.index("Exchange")
    assert int(extraction.SETTINGS["spark.sql.parquet.columnarReaderBatchSize"]) < 1000
