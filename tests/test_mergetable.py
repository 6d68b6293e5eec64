"""The stored table against edits applied at once, and what its operations write and read."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from docfields.operators import edits
from docfields.operators.mergetable import CHANGE, FieldTable
from docfields.streaming import jobs

FIELD = "id long, field_value string, is_edited boolean, original_value string, note string"
START = datetime(2024, 1, 1)


def size(root):
    return sum(p.stat().st_size for p in Path(root).rglob("*.parquet"))


def rows(df):
    return sorted(map(tuple, df.select("id", "field_value", "is_edited", "original_value").collect()), key=str)


def test_edits_in_any_order_equal_edits_applied_at_once(spark, tmp_path):
    rng = random.Random(5)
    fields = spark.createDataFrame([(k, f"v{k}", k % 3 == 0, "was" if k % 3 == 0 else None, None) for k in range(60)], FIELD)
    made = [(k, rng.choice([7, rng.randrange(70)]), rng.choice([None, "", f"n{k}"]), START + timedelta(hours=rng.randrange(50))) for k in range(300)]
    rng.shuffle(made)
    table = FieldTable.create(fields, str(tmp_path / "t"), buckets=8)
    for number in range(4):
        part = spark.createDataFrame(made[number::4] + made[: 5 * number], CHANGE)  # some come again
        table.append(part, number)
        table.append(part, number)
        if number in (1, 2):
            assert table.compact(0.5)
    everything = spark.createDataFrame(made, CHANGE)
    want = edits.apply_edits(fields, everything)[0]
    assert rows(table.current()) == rows(want)
    assert rows(FieldTable(spark, str(tmp_path / "t")).current(spark.createDataFrame([(7,), (8,), (999,)], "id long"))) == rows(want.where("id IN (7, 8)"))
    assert sorted(r.id for r in table.history().collect()) == list(range(300))
    at = START + timedelta(hours=20)
    assert sorted(map(tuple, table.value_as_of(at).collect())) == sorted(map(tuple, edits.value_as_of(want, everything, at).collect()))
    with pytest.raises(ValueError):
        table.append(everything, 9)


def test_a_repeated_id_counts_as_it_came_first_and_rows_without_keys_change_nothing(spark, tmp_path):
    fields = spark.createDataFrame([(1, "a", False, None, "x"), (2, None, None, None, None)], FIELD)
    table = FieldTable.create(fields, str(tmp_path / "t"), buckets=4)
    table.append(spark.createDataFrame([(5, 1, "first", START), (6, None, "no field", START), (None, 2, "no id", START)], CHANGE))
    table.append(spark.createDataFrame([(5, 1, "second", START + timedelta(days=1))], CHANGE))
    assert rows(table.current()) == [(1, "first", True, "a"), (2, None, False, None)]
    table.compact(0.0)
    table.append(spark.createDataFrame([(5, 1, "third", START + timedelta(days=2))], CHANGE))
    assert rows(table.current()) == [(1, "first", True, "a"), (2, None, False, None)]
    none = FieldTable.create(fields.limit(0), str(tmp_path / "none"), buckets=4)
    assert none.current().count() == none.history().count() == 0
    none.append(spark.createDataFrame([(5, 1, "x", START)], CHANGE))
    none.append(spark.createDataFrame([], CHANGE))
    assert none.current().count() == 0 and none.compact() and none.current().count() == 0


def test_an_append_of_one_in_a_hundred_writes_little_and_a_lookup_reads_its_buckets(spark, tmp_path):
    fields = spark.range(100_000).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS field_value", "false AS is_edited", "CAST(NULL AS STRING) AS original_value", "md5(CAST(id AS STRING)) AS note")
    table = FieldTable.create(fields, str(tmp_path / "t"), buckets=16)
    before = size(tmp_path)
    table.append(spark.range(1000).selectExpr("id", "id * 97 AS field_id", "CONCAT('n', id) AS new_value", "TIMESTAMP '2024-01-01' AS created_at"))
    assert table.compact(0.1) == set()
    files = list((tmp_path / "t" / "changes").rglob("*.parquet"))
    assert sum(f.stat().st_size for f in files) <= 0.02 * before and len(files) <= 64
    assert (size(tmp_path) - before) <= 0.02 * before
    one = table.current(spark.createDataFrame([(97,)], "id long"))
    assert [r.field_value for r in one.collect()] == ["n1"]
    assert {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles() if "/base/" in f} == {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles() if "bucket=" in f}
    assert len([f for f in one.inputFiles() if "/base/" in f]) <= 4
    # A compaction that failed before its commit leaves nothing to be read.
    table._write(table.current().selectExpr("id", "'lost' AS field_value", "is_edited", "original_value", "note"), "id", 16, "base/gen=7")
    assert table.current().where("field_value = 'lost'").count() == 0


def test_batches_of_a_stream_survive_a_restart(spark, tmp_path):
    fields = spark.createDataFrame([(k, "0", False, None, None) for k in range(20)], FIELD)
    table = FieldTable.create(fields, str(tmp_path / "t"), buckets=4)
    made = [(k, k % 13, f"n{k}", START + timedelta(minutes=k * 7 % 31)) for k in range(60)]
    for part in range(2):
        for half in range(2):
            spark.createDataFrame(made[part * 30 + half * 15 :][:15] + made[:3], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "edits"))
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edits"))
        run = jobs.merged_values(stream, table.path).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert rows(table.current()) == rows(edits.apply_edits(fields, spark.createDataFrame(made, CHANGE))[0])
