"""The run over a corpus: its rows, and plans that leave documents where they were dealt."""

import json

from docfields.operators import extraction, layout


def test_rows_and_plans(spark, monkeypatch):
    polygon = [0.0] * 8
    page = lambda d, n, *lines: {"document_id": d, "page_number": n, "words": [{"content": w, "confidence": 1.0, "polygon": polygon} for x in lines for w in x.split()], "lines": [{"content": x, "polygon": polygon} for x in lines]}
    pages = spark.createDataFrame([page(1, 2, "Name: Ann", "Total 12"), page(1, 1, "Form A", "Total 12"), page(2, 1, "Hello there")], layout.ANALYSIS)
    raw = spark.createDataFrame([(1, json.dumps({"fields": [{"field_key": "Form A", "field_value": "Ann"}, {"field_key": "Totl 12"}]})), (2, "x"), (3, json.dumps({"fields": [{"field_key": "a"}]})), (None, "x")], "document_id long, response string")
    versions = spark.createDataFrame([(1, 3), (1, 2)], "document_id long, version int")
    plans, written = {}, extraction.bucketed

    def spy(df, name, key, buckets, exchange=True):
        if not exchange:
            plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, key, buckets, exchange)

    monkeypatch.setattr(extraction, "bucketed", spy)
    before = {k: spark.conf.get(k, None) for k in (*extraction.SETTINGS, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = extraction.extract(pages, raw, versions)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(plans) == {"fields", "found", "rest", "rated", "near", "matches", "located"}
    assert not any("Exchange hashpartitioning" in p for ps in plans.values() for p in ps)
    assert {k: spark.conf.get(k, None) for k in before} == before
    shown = lambda m: m and (m.matched_text, m.page)
    rows = {(r.document_id, r.sort_order): (r.version, shown(r.key_bbox), shown(r.value_bbox), r.is_valid) for r in run["fields"].collect()}
    assert rows == {(1, 0): (4, ("Form A", 1), ("Name: Ann", 2), True), (1, 1): (4, ("Total 12", 1), None, True), (3, 0): (1, None, None, True)}
    assert {(r.document_id, r.version, r.total_fields, r.located_fields) for r in run["extractions"].collect()} == {(1, 4, 2, 1), (3, 1, 1, 0)}
    assert [tuple(r) for r in run["failures"].collect()] == [(2, "Invalid JSON")]
