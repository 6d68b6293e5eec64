"""What the layout queries shuffle: nothing, or sums of pages."""

import pytest
from pyspark.sql import functions as F

from docfields.operators import layout, matching
from docfields.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_counts", "reading_order"])
def test_no_exchange(spark, name):
    assert "Exchange" not in plan(registry.QUERIES[name](spark, SF))


def test_boxes_of_all_kinds_read_analyses_once_and_are_not_sorted(spark):
    shown = plan(registry.QUERIES["flatten_boxes"](spark, SF))
    assert shown.count("FileScan") == 1
    # The roles' maximum sorts counts alone: the first aggregate over the boxes is by hash.
    above = shown[: shown.index("Generate")]
    assert above.rfind("HashAggregate") > above.rfind("SortAggregate") > 0


def test_missing_parts_of_an_analysis_have_no_boxes(spark):
    row = "named_struct('page_number', 1, 'polygon', array(1D, 2D, 3D))"
    df = spark.sql(f"""SELECT 1L AS document_id, 1 AS page_number, null AS words, array(named_struct('content', 'l', 'polygon', null)) AS lines, null AS selection_marks,
        array(named_struct('row_count', 1, 'column_count', 1, 'regions', null, 'cells', array(named_struct('content', 'c', 'row_index', 0, 'column_index', 0, 'regions', array({row})), null)), null) AS tables,
        array(named_struct('content', 'x', 'role', null, 'regions', null), named_struct('content', 'p', 'role', null, 'regions', array({row}))) AS paragraphs""")
    df = spark.createDataFrame(df.collect(), layout.ANALYSIS)
    got = [(r.type, r.content, r.ordinal.o0, r.role, r.odd_polygon) for r in layout.flatten_boxes(df).orderBy("ordinal").collect()]
    assert got == [("line", "l", 0, None, False), ("table_cell", "c", 0, None, True), ("paragraph", "p", 1, "text", True)]


def test_rectangle_as_an_aggregate_keeps_limits_only(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 3.0, 4.0, 9.0]), (1, [2.0, 7.0]), (1, None), (2, [4.0]), (3, None)], "k int, p array<double>")
    got = df.groupBy("k").agg(matching.rectangle_around(F.col("p")).alias("u"))
    assert "collect_list" not in plan(got)
    assert {r.k: r.u for r in got.collect()} == {1: [1.0, 4.0, 9.0, 4.0, 9.0, 7.0, 1.0, 7.0], 2: [], 3: []}


def test_a_run_deals_words_and_lines_only(spark):
    from docfields.operators import extraction

    run = extraction.extract(*[spark.createDataFrame([], s) for s in (layout.ANALYSIS, "document_id long, response string", "document_id long, version int")], buckets=2)
    assert run["fields"].count() == 0
    tables = [t.name for t in spark.catalog.listTables() if t.name.endswith("_analyses")]
    assert tables and all(set(spark.table(t).columns) == {"document_id", "page_number", "words", "lines"} for t in tables if spark.table(t).count() == 0)


@pytest.mark.parametrize("name", ["stored_layouts", "rejected_layouts"])
def test_analyses_as_texts_are_not_written(spark, name):
    from pathlib import Path

    from docfields.functions.store import shared_folder

    before = set(Path(shared_folder(spark)).glob("*"))
    assert registry.QUERIES[name](spark, SF).count()
    assert set(Path(shared_folder(spark)).glob("*")) == before


def test_fields_are_dealt_once_for_exports(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(registry.QUERIES["export_nested"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # customers, orders by customer (for versions), extractions by id, fields
    assert shown.count("Exchange hashpartitioning") == 4


@pytest.mark.parametrize("name", ["match_text", "match_fields", "match_contains", "match_equal_lines"])
def test_matching_broadcasts_nothing(spark, name):
    shown = plan(registry.QUERIES[name](spark, SF))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown
