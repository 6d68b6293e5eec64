"""Targets from documents without a text, or without a first line, against the SQL; what matching deals; ratios that are known."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from docfields.operators import matching
from docfields.plans import registry

TEXTS = [None, "", "\nsecond line", "  \nblank first", " \t", "Total due\ntotal DUE now", "one", "\n\n"]


@pytest.mark.parametrize("name", ["match_contains", "match_equal_lines"])
def test_documents_without_a_first_line(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_text", "match_fields"])
def test_matching_deals_texts_once_and_boxes_never(spark, monkeypatch, name):
    plans, written = {}, registry.bucketed

    def spy(df, table, key, buckets, exchange=True):
        if not exchange:
            plans.setdefault(table, []).append(plan(df))
        return written(df, table, key, buckets, exchange)

    monkeypatch.setattr(registry, "bucketed", spy)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert {"found", "rest", "rated", "near", "matches"} <= set(plans)
    assert not any("Exchange hashpartitioning" in p for ps in plans.values() for p in ps)


def test_ratios_without_a_seed_are_known(spark):
    rng, rows = random.Random(5), []
    for k in range(300):
        letters = "abcdef" if k % 2 else "abcdefghijklmnopqrstuvwxyz ,é1"
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(200, 420)))
        at = rng.randrange(100)
        rows.append((rng.choice([line[:at], line[at : at + 30], line[:at] + "a" + line[at:], "".join(rng.choice(letters) for _ in range(9))]) or "a", line))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.withColumn("seed", matching.may_seed(F.length("b"), matching.letter_counts(F.col("a")), matching.letter_counts(F.col("b")))).collect():
        begin = next((k for k, (x, y) in enumerate(zip(r.a, r.b, strict=False)) if x != y), min(len(r.a), len(r.b)))
        assert r.seed or SequenceMatcher(None, r.a, r.b).ratio() == 2.0 * begin / (len(r.a) + len(r.b))
