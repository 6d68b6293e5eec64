"""Hard negatives by slots against a plain search of every window."""

import random

import pytest

from docfields.llm import hard_negatives as hn

SCHEMA = "id long, label string, v array<long>"


def plain(anchors, rows, n_pos, n_neg, low, high):
    out = []
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    for key, label, v in {(i, c, tuple(v)) for i, c, v in anchors}:
        scored = sorted((-dot(v, w), other, c) for other, c, w in rows if other != key)
        for s, other, _ in [x for x in scored if x[2] == label][:n_pos]:
            window = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(key, other, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_search(spark, seed):
    rng = random.Random(seed)
    vector = lambda: [rng.randrange(-3, 9) for _ in range(rng.choice([4, 4, 4, 3, 0]))]
    rows = [(rng.randrange(60), rng.choice("aaab" if seed % 2 else "abc"), vector()) for _ in range(150)]
    rows += rows[:20] + [(500 + k, "b", [8, 8, 8, 8]) for k in range(30)]
    anchors = [r for r in rows if r[0] % 10 == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hn.mine(df.where("id % 10 = 0"), df, 4, 3, 50, 95, anchor_block=7, candidate_block=40)
    assert sorted(map(tuple, got.collect())) == plain(anchors, rows, 4, 3, 50, 95)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_overlapping_windows_share_slots(spark):
    # Positives of 100, 90 and 90: limits 95 and 85. Negatives at the limits, between them and below.
    rows = [(0, "a", [10, 0]), (1, "a", [10, 1]), (2, "a", [9, 1]), (3, "a", [9, 2])] + [(10 + k, "b", [0, 0]) for k in range(3)]
    rows += [(20, "b", [9, 0]), (21, "b", [8, 0]), (22, "b", [5, 0]), (23, "b", [4, 0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, hn.mine(df.where("id = 0"), df, 3, 2).collect()))
    assert got == plain([rows[0]], rows, 3, 2, 50, 95)
    assert [(r[1], r[3]) for r in got] == [(1, 20), (1, 21), (2, 21), (2, 22), (3, 21), (3, 22)]


def test_large_numbers_stay_exact(spark):
    rows = [(0, "a", [2**31, 1]), (1, "a", [2**31, 5]), (2, "b", [2**30 + 7, 2]), (3, "b", [2**30 + 7, 3]), (4, "b", [2**30 - 1, 0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hn.mine(df.where("id = 0"), df).collect())) == plain([rows[0]], rows, 5, 3, 50, 95)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(0, 1, [0.5, 0.5], "x"), (1, 1, [0.5, 0.25], "x"), (2, 2, [0.25, 0.3], "x"), (None, 1, [1.0, 1.0], "x"), (3, None, [1.0, 1.0], "x"), (4, 2, None, "x"), (5, 2, [nan, 1.0], "x"), (6, 2, [inf, 1.0], "x"), (7, 2, [None, 1.0], "x")]
    df = spark.createDataFrame(raw, "vec_id long, label int, embedding array<float>, anchor string")
    rows = hn.labelled_vectors(df, "vec_id", df.label, "embedding", 256)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2]
    assert [tuple(r)[:4] for r in hn.mine(rows.where("id = 0"), rows).collect()] == [(0, 1, 1, 2)]
    empty = rows.where("false")
    assert hn.mine(empty, rows).collect() == [] and hn.mine(rows, empty).collect() == [] and hn.mine(empty, empty).collect() == []
