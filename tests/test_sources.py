"""Tables of a database (the embedded one in Spark's jars) and stored analyses."""

import json
from datetime import date, datetime, timedelta

from docfields.operators import layout
from docfields.sources import files

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_a_table_is_read_in_ranges_of_equal_counts_and_loaded_once(spark):
    url = "jdbc:derby:memory:forms;create=true"
    start = datetime(2024, 1, 1)
    rows = [(k, f"n{k}", None if k % 50 == 0 else start + timedelta(hours=k if k < 300 else 24 * (k - 280))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, created_at timestamp")
    types = {**DERBY, "createTableColumnTypes": "name varchar(50)"}
    df.where("id < 0").write.jdbc(url, "forms", properties=types)
    files.load_jdbc(df.where("id < 250"), url, "forms", "id", types)
    files.load_jdbc(df.unionByName(df.where("id % 2 = 0")), url, "forms", "id", types)  # what tasks that were tried again leave behind
    edges = files.balanced_days(spark, url, "forms", 8, "\"created_at\"", DERBY)
    assert edges == sorted(set(edges)) and len(edges) == 9
    back = files.read_jdbc(spark, url, "forms", column="\"created_at\"", properties=DERBY, edges=edges)
    assert back.rdd.getNumPartitions() == 9
    sizes = back.rdd.glom().map(len).collect()
    assert sum(sizes) == 400 and max(sizes[:8]) <= 400 / 8 + 24 and sizes[8] == 8
    assert sorted((r.id, r.name, r.created_at) for r in back.collect()) == rows
    steps = files.read_jdbc(spark, url, "forms", date(2024, 1, 3), date(2024, 2, 1), 7, "\"created_at\"", DERBY)
    assert sorted(r.id for r in steps.collect()) == list(range(400))
    files.write_jdbc(df.where("id = 1"), url, "forms", DERBY)
    assert steps.count() == 401


def test_a_table_without_times(spark):
    url = "jdbc:derby:memory:none;create=true"
    spark.createDataFrame([(1, None)], "id long, created_at timestamp").write.jdbc(url, "forms", properties=DERBY)
    edges = files.balanced_days(spark, url, "forms", 8, "\"created_at\"", DERBY)
    assert edges == [] and [r.id for r in files.read_jdbc(spark, url, "forms", column="\"created_at\"", properties=DERBY, edges=edges).collect()] == [1]


def test_stored_analyses_that_are_set_aside(spark, tmp_path):
    polygon = [0, 0.5, 1.0, 0, 1, 1, 0, 1]
    good = {"document_id": 1, "page_number": 2, "words": [{"content": "w", "confidence": 1, "polygon": polygon, "more": {}}], "lines": None, "engine": "x"}
    bad = [{"page_number": 1}, {"document_id": 3, "page_number": None}, {"document_id": 4, "page_number": 1, "lines": {"content": "x"}}, {"document_id": "five", "page_number": 1}, 7, None]
    (tmp_path / "a.json").write_text(json.dumps([good, *bad], indent=1))
    (tmp_path / "b.json").write_text('{"document_id": 9, "page_nu')
    (tmp_path / "c.json").write_text(" \n")
    (tmp_path / "d.json").write_text("[]")
    kept, aside = files.declared(files.raw_layouts(spark, str(tmp_path), whole=True), layout.ANALYSIS)
    row = kept.collect()
    assert [(r.document_id, r.page_number, r.words[0].polygon, r.lines) for r in row] == [(1, 2, [float(x) for x in polygon], None)]
    assert [b.content for b in layout.flatten_boxes(kept).collect()] == ["w"]
    reasons = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in aside.select("file", "reason").collect())
    assert reasons == sorted([("a.json", "no document_id"), ("a.json", "no page_number"), ("a.json", "lines is no list"), ("a.json", "document_id is no bigint"), ("a.json", "no document_id"), ("a.json", "no document_id"), ("b.json", "no JSON")])
