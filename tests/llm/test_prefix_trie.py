"""The trie of prefixes against a plain dictionary of tuples, with queues that spill and shards of few conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from docfields.llm import prefix_trie as pt
from docfields.llm.common import materialise

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuild(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + -c % 20
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = sum(saved[p] for p in children[path]) + (len(nodes[path]) - 1) * words
    digest = lambda path: hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in nodes.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def placed(df):
    return materialise(pt.placed_turns(df, "conv_id", "turn", "role", "text"), "placed")


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 5)
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 60), *([None] if seed else [])]:
        for turn in range(rng.choice([1, 2, 3, 6, 17])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(["yes", "yes yes ", "no", "", None, "a b c"])))
        rows += rows[-1:] * (c is not None and c % 7 == 0)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", depth string").repartition(3)
    got = pt.trie(pt.rebuilt(placed(df)), top=40, least=(1, 3, 1000)[seed])
    assert found(got) == plain(rebuild(rows))


def test_one_long_conversation_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(60 if c < 3 else 40)]
    got = pt.trie(pt.rebuilt(placed(spark.createDataFrame(rows, SCHEMA).repartition(5))), least=1)
    assert found(got) == plain(rebuild(rows))


def test_turns_are_placed_across_tasks(spark):
    rows = [(7, t % 50, "user", f"text {t % 3}") for t in range(900)] + [(8, None, None, None)] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = defaultdict(list)
    for r in placed(df).collect():
        got[r.conv].append(r.pos)
    assert {c: sorted(p) for c, p in got.items()} == {7: list(range(1, 901)), 8: list(range(1, 41))}


def test_empty_table(spark):
    assert found(pt.trie(pt.rebuilt(placed(spark.createDataFrame([], SCHEMA))))) == []


def test_messages_come_in_order_when_they_spill():
    rng = random.Random(3)
    keys = sorted({(-rng.randrange(9), rng.randrange(50), 0) for _ in range(300)})
    sent = [(rng.choice(keys), k, 2 * k) for k in range(5000)]
    inbox = pt.Inbox(64)
    for m in sent:
        inbox.put(m)
    assert len(inbox.heap) < 64
    assert [m for key in keys for m in inbox.take(key)] == sorted(sent)
    inbox.put((keys[0], 1, 1))
    with pytest.raises(ValueError, match="not here"):
        list(inbox.take(keys[1]))
