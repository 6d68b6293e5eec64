"""What SQL can't express: similarity ratios, scans in order, running means, files and streams, against plain statements of the rules."""

import json
import random
import time
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docfields.operators import edits, exports, layout, matching, responses
from docfields.sources import files
from docfields.streaming import jobs


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_ratio_keeps_the_order_of_its_arguments(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "x"), ("x", ""), ("same", "same"), ("a" * 300 + "b", "b" + "a" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", matching.fuzzy_ratio("a", "b"))
    assert [r.r for r in df.collect()] == [ratio(a, b) for a, b in pairs]


def scan(target, lines):
    """The line that a scan in order ends with, and its confidence."""
    best, at = 0.0, None
    for k, line in enumerate(lines):
        r = ratio(target, line)
        if target in line or line in target:
            if r > best:
                best, at = max(r, 0.9), k
        elif r >= 0.85 and r > best:
            best, at = r, k
    return at, best


def test_similar_lines_follow_the_scan(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    cases = []
    for i in range(60):
        target = " ".join(word() for _ in range(3))
        lines = [rng.choice([target + " " + word(), target[:-1] + "z", target[1:], word(), target[: len(target) // 2], ""]).strip() for _ in range(8)]
        cases.append((i, target, lines))
    boxes = spark.createDataFrame([(i, k, "line", x, 1, [0.0] * 8) for i, _, lines in cases for k, x in enumerate(lines)], "extraction_id int, ordinal int, type string, content string, page_number int, polygon array<double>")
    targets = spark.createDataFrame([(i, 0, t, t) for i, t, _ in cases], "extraction_id int, target_id int, target string, t string")
    got = {r.extraction_id: (r.matched_text, r.confidence) for r in matching.match_similar_lines(targets, boxes).collect()}
    for i, target, lines in cases:
        at, best = scan(target, lines)
        assert got.get(i) == (None if at is None else (lines[at], best))


def test_words_and_unions(spark):
    content = ["Invoice", "number", "Total", "amuont", "of", "42"]
    boxes = spark.createDataFrame([(1, k, "word", c, 1 + k // 3, [k * 10.0, 0.0, k * 10.0 + 8, 0.0, k * 10.0 + 8, 5.0, k * 10.0, 5.0]) for k, c in enumerate(content)], "extraction_id int, ordinal int, type string, content string, page_number int, polygon array<double>")
    targets = spark.createDataFrame([(1, 0, "numbr"), (1, 1, "invoice number missing words"), (1, 2, "nothing like these here"), (1, 3, " "), (1, 4, None), (1, 5, "TOTAL")], "extraction_id int, target_id int, target string")
    got = {r.target_id: r for r in matching.match_text(targets, boxes).collect()}
    assert set(got) == {0, 1, 5}
    assert got[0].matched_text == "number" and got[0].confidence == ratio("number", "numbr")
    assert (got[1].matched_text, got[1].confidence, got[1].page) == ("Invoice number", 0.5, 1) and got[1].polygon == [0.0, 0.0, 18.0, 0.0, 18.0, 5.0, 0.0, 5.0]
    assert (got[5].matched_text, got[5].confidence) == ("Total", 1.0)


def test_reading_order_follows_the_running_mean(spark):
    rng = random.Random(9)
    pages = {p: [(rng.uniform(0, 60), rng.uniform(0, 200), rng.uniform(4, 14), f"t{k}") for k in range(rng.randrange(1, 25))] for p in range(25)}
    rows = [(1, p, k, t, 0.5, [[x, y], [x + 5, y], [x + 5, y + h], [x, y + h]]) for p, blocks in pages.items() for k, (y, x, h, t) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, ordinal int, text string, confidence double, box array<array<double>>")
    got = {}
    for r in layout.reading_order(df).collect():
        got.setdefault(r.page_number, {})[r.line_no] = r.text
    for p, blocks in pages.items():
        tolerance = 0.5 * sum((y + h) - y for y, _, h, _ in blocks) / len(blocks)
        lines, total = [], 0.0
        for y, x, h, t in sorted(blocks, key=lambda b: (b[0] + (b[0] + b[2])) / 2):
            centre = (y + (y + h)) / 2
            if lines and abs(centre - total / len(lines[-1])) <= tolerance:
                lines[-1].append((x, t, centre))
                total += centre
            else:
                lines.append([(x, t, centre)])
                total = centre
        lines.sort(key=lambda line: sum(c for _, _, c in line) / len(line))
        assert [got[p][k + 1] for k in range(len(lines))] == [" ".join(t for _, t, _ in sorted(line)) for line in lines]


def test_files(spark, tmp_path):
    day = tmp_path / "2024" / "03"
    day.mkdir(parents=True)
    for name, data in (("a.png", b"one"), ("b.pdf", b"two"), ("c.pdf", b"two")):
        (day / name).write_bytes(data)
    found = files.scan_uploads(spark, str(tmp_path), "*.pdf").select(F.col("path").alias("id"), "content")
    again = files.repeated_uploads(found).collect()
    assert len(again) == 1 and again[0].n == 2 and again[0].first_id.endswith("b.pdf")
    polygon = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    page = {"document_id": 1, "page_number": 2, "words": [{"content": "w", "confidence": 0.9, "polygon": polygon[:7]}], "lines": [{"content": "w", "polygon": polygon}], "selection_marks": [{"state": "selected", "confidence": 1.0, "polygon": polygon}]}
    page["tables"] = [{"row_count": 1, "column_count": 1, "regions": [{"page_number": 2, "polygon": polygon}, {"page_number": 3, "polygon": polygon}], "cells": [{"content": "c", "row_index": 0, "column_index": 0, "regions": [{"page_number": 2, "polygon": polygon}]}]}]
    page["paragraphs"] = [{"content": "p" * 101, "regions": [{"page_number": 2, "polygon": polygon}]}, {"content": "q" * 100, "role": "title", "regions": [{"page_number": 1, "polygon": polygon}]}]
    (tmp_path / "layout.json").write_text(json.dumps([page], indent=1))
    boxes = layout.flatten_boxes(files.read_layouts(spark, str(tmp_path / "layout.json"), layout.ANALYSIS)).orderBy("ordinal").collect()
    assert [b.type for b in boxes] == ["word", "line", "selection_mark", "table", "table_cell", "paragraph"]
    assert [b.odd_polygon for b in boxes] == [True] + [False] * 5
    assert boxes[5].content == "p" * 100 + "..." and boxes[5].role == "text" and boxes[3].row_count == 1


@pytest.fixture
def log(spark, tmp_path):
    """Three files of a log, with their rows."""
    start = datetime(2024, 1, 1)
    rows = [(k, ("ocr", "upload")[k % 2], ("completed", "failed")[k % 3 == 0], start + timedelta(hours=5 * k)) for k in range(60)]
    schema = "id long, step string, status string, created_at timestamp"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log"), schema


def test_stream_counts_equal_the_batch(spark, log, tmp_path):
    path, schema = log
    stream = jobs.daily_step_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "30 days")
    run = stream.writeStream.format("memory").queryName("daily_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    want = sorted(map(tuple, jobs.daily_step_status(spark.read.parquet(path)).collect()))
    assert sorted(map(tuple, spark.table("daily_counts").collect())) == want and want


def test_stream_of_edits_ends_with_the_batch_values(spark, tmp_path):
    start = datetime(2024, 1, 1)
    fields = spark.createDataFrame([(k, 1, "0", k % 2 == 1, "orig" if k % 2 else None) for k in range(5)], "id long, extraction_id long, field_value string, is_edited boolean, original_value string")
    rows = [(k, k % 4, 1, str(k), start + timedelta(minutes=k), "manual") for k in range(30)]
    schema = "id long, field_id long, extraction_id long, new_value string, created_at timestamp, edit_type string"
    for k in range(3):
        part = rows[10 * k : 10 * k + 10]
        spark.createDataFrame(part + part[:2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edits"))
    # A file source takes the files in the order of their times, which is the order in which they were written.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edits"))
    run = jobs.current_values(stream, fields, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out" / "batch=2"))
    want = edits.apply_edits(fields, spark.createDataFrame(rows, schema))[0]
    columns = ["id", "field_value", "is_edited", "original_value"]
    changed = sorted(map(tuple, want.select(columns).collect()), key=str)
    assert set(changed) <= set(map(tuple, last.select(columns).collect()))


def test_stream_of_edits_goes_on_after_a_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    fields = spark.createDataFrame([(k, 1, "0", False, None) for k in range(3)], "id long, extraction_id long, field_value string, is_edited boolean, original_value string")
    schema = "id long, field_id long, extraction_id long, new_value string, created_at timestamp, edit_type string"
    edit = lambda k, field, value: (k, field, 1, value, start + timedelta(minutes=k), "manual")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edits"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "edits"))
        query = jobs.current_values(stream, fields, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run([edit(1, 0, "first"), edit(2, 1, "second")])
    run([edit(3, 1, "third"), edit(1, 0, "first again")])  # edit 1 was taken before
    last = {r.id: (r.field_value, r.is_edited, r.original_value) for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()}
    assert last == {0: ("first", True, "0"), 1: ("third", True, "0"), 2: ("0", False, None)}


def test_names_of_paths(spark):
    names = ["dir/x.pdf", "a b/c/d e.PNG", ".hidden", "dir.v2/plain", "x.tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.sanitize(df.n)).collect()] == ["x.pdf", "d_e.png", ".hidden.", "plain.", "x.tar.gz"]


def test_rollup_gathers_the_boxes_of_all_pages_and_exports_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, 5, True, ["c"]), (1, 1, 5, True, ["a", "b"]), (2, 1, 5, False, None)], "document_id long, page_number int, processing_time_ms long, success boolean, layout_boxes array<string>")
    assert {r.document_id: r.layout_boxes for r in layout.document_rollup(pages).collect()} == {1: ["a", "b", "c"], 2: []}
    for fmt in ("csv", "json"):
        exports.write_export(pages.select("document_id", "page_number"), str(tmp_path / fmt), fmt, by="document_id")
        back = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(str(tmp_path / fmt))
        assert sorted((r.document_id, r.page_number) for r in back.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_reading_order_of_a_page_of_many_blocks(spark):
    n = 100_000
    k = F.col("id")
    y, x = (F.floor(k / 20) * 20.0), (k % 20) * 10.0
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    blocks = spark.range(n).select(F.lit(1).alias("document_id"), F.lit(1).alias("page_number"), k.alias("ordinal"), k.cast("string").alias("text"), F.lit(1.0).alias("confidence"), F.array(corner(0, 0), corner(8, 0), corner(8, 8), corner(0, 8)).alias("box"))
    began = time.time()
    got = layout.reading_order(blocks)
    assert got.count() == n / 20 and got.where("line_no = 3").first().text == " ".join(map(str, range(40, 60)))
    assert time.time() - began < 60


def test_named_fields_and_chosen_columns(spark):
    templates = spark.createDataFrame([("A", [(None, "n1"), ("k2", "n2"), (None, None)], None)], "name string, expected_fields array<struct<key:string,name:string>>, extraction_prompt string")
    docs = spark.createDataFrame([(1, "text", None, "A")], "document_id int, text string, custom_prompt string, template_name string")
    assert responses.build_prompts(docs, templates).first().prompt.startswith("Expected fields to look for: n1, k2, \n")
    assert files.mime_type(F.lit(None)) is not None
    checked = spark.createDataFrame([(None, 1), ("a.pdf", 1)], "n string, s long").select(files.check_upload(F.col("n"), F.col("s")).alias("v")).collect()
    assert [r.v.ok for r in checked] == [False, True]
