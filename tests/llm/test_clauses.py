"""Clauses end at runs of marks before white space, in time that grows with the text alone."""

import random
import re
import time

from pyspark.sql import functions as F

from docfields.llm import toxicity


def test_clauses_are_cut_as_by_trying_every_place(spark):
    rng = random.Random(1)
    plain = re.compile(r"[.!?;\n]+(?:\s|$)|\n")
    texts = ["".join(rng.choice("ab .!?;\n\t") for _ in range(rng.randrange(0, 25))) for _ in range(4000)]
    for t in texts:
        assert [m.span() for m in toxicity.CLAUSE_END.finditer(t)] == [m.span() for m in plain.finditer(t)], repr(t)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", f"(?U){toxicity.CLAUSE}").alias("c"))
    for r in df.collect():
        assert [c for c in r.c if c] == [c for c in plain.split(r.t) if c], repr(r.t)


def test_a_million_marks_take_no_time():
    began = time.time()
    for run in (".", "!?", ";.\n."):
        toxicity.CLAUSE_END.split("you idiot " + run * (1_000_000 // len(run)) + "x")
    assert time.time() - began < 3
