"""Cost-balanced packing against the tokenizers library, a packer of single pieces, and its own promises."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docfields.llm import balanced_packing as bp

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "foo", "Bar's", "'s", " ,", "..", "É", "ß", "12", " ", "　", "<|endoftext|>", "\x01", "\x02", "\x00", "日本", "🙂", "\r\n", "\x1c", "\x85", "'", "Ġ", "Ġfoo", " foo"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(4000)]
    found = bp.encoder(PATH).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert found.ids[found.ends[k] : found.ends[k + 1]].tolist() == ids_of(tokenizer, t)[:-1], repr(t)


def test_frequent_words_stay_known(tokenizer, monkeypatch):
    """When more words came than may be remembered, those met often are not encoded again, and the rest is forgotten."""
    monkeypatch.setattr(bp, "REMEMBERED", 60)
    own, coded, rng = bp.ByteEncoder(PATH), Counter(), random.Random(4)
    plain = own.ready
    monkeypatch.setattr(own, "ready", lambda w: coded.update([w.lstrip(" Ġ")]) or plain(w))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    often = [word() for _ in range(25)]
    for k in range(40):
        texts = [" ".join(["É", *often, *(word() for _ in range(20))]), f"a  {k} \n\t{'x y  ' * 40}{k}" if k % 3 else ""]
        found = own.encode(pa.array(texts))
        for t, a, b in zip(texts, found.ends[:-1], found.ends[1:], strict=True):
            assert found.ids[a:b].tolist() == ids_of(tokenizer, t)[:-1]
        assert len(own.number) <= 60 and len(own.known.ends) == len(own.number) + 1
    assert max(coded[w] for w in often) == 1


def test_memory_holds_when_every_word_is_frequent_or_long(tokenizer, monkeypatch):
    monkeypatch.setattr(bp, "REMEMBERED", 40)
    own, rng = bp.ByteEncoder(PATH), random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [" ".join(word(12) for _ in range(50)), *(word(3000) for _ in range(3))]
    for _ in range(9):
        found = own.encode(pa.array(texts))
        assert [found.ids[a:b].tolist() for a, b in zip(found.ends[:-1], found.ends[1:], strict=True)] == [ids_of(tokenizer, t)[:-1] for t in texts]
        assert len(own.number) <= 40 and sum(map(len, own.number)) <= 40 * 16


def one_by_one(lengths, capacity, cost):
    """Descending pieces, each into the cheapest sequence with room; what fits nowhere is cut at the roomiest. Sequences' costs."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << k for k in range(20) if total % capacity >> k & 1]
    costs, todo = [0] * len(rooms), defaultdict(int, Counter(lengths))
    for n in range(max(lengths, default=0), 0, -1):
        for _ in range(todo[n]):
            fit = [k for k, r in enumerate(rooms) if r >= n]
            k = min(fit, key=lambda k: costs[k]) if fit else max(range(len(rooms)), key=lambda k: (rooms[k], -costs[k]))
            size = min(n, rooms[k])
            todo[n - size] += 1
            costs[k] += cost(size)
            rooms[k] -= size
    assert not any(rooms)
    return costs


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_greedy_packing_without_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 30, 64])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 300))]
    plan = bp.plan(dict(Counter(lengths)), capacity, 3, 1)
    rank, pieces = Counter(), []
    for n in lengths:
        pieces.append((n, rank[n]))
        rank[n] += 1
    piece, step = plan.places(*(np.array(c) for c in zip(*pieces, strict=True)))
    tokens, sequences, costs = defaultdict(list), defaultdict(list), Counter()
    for p, s in zip(piece.tolist(), step.tolist(), strict=True):
        seq, size = int(plan.first[s]) + pieces[p][1] - int(plan.low[s]), int(plan.size[s])
        tokens[p].append((int(plan.at[s]), size))
        sequences[seq].append((int(plan.offset[s]), size))
        costs[seq] += 3 * size + size * size
    for p, (n, _) in enumerate(pieces):
        at = 0
        for start, size in sorted(tokens[p]):
            assert start == at
            at += size
        assert at == n
    sizes = []
    for parts in sequences.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        sizes.append(at)
    assert sorted(sizes, reverse=True) == [capacity] * (sum(lengths) // capacity) + [1 << k for k in range(9, -1, -1) if sum(lengths) % capacity >> k & 1]
    want = one_by_one(lengths, capacity, lambda n: 3 * n + n * n)
    assert len(want) == len(costs)
    # Ties may fall otherwise than piece by piece, so the costs are close, not equal: no dearer sequence, nearly the same sum.
    assert max(costs.values()) <= max(want) * 1.1 and abs(sum(costs.values()) - sum(want)) <= 0.05 * sum(want)


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    shape = {n: 1 + rng.randrange(50) for n in range(1, 1025)}
    sizes = [len(bp.plan({n: k * times for n, k in shape.items()}, 1024).size) for times in (1, 1000, 10**6)]
    assert max(sizes) < 20_000 and sizes[2] < 1.2 * sizes[1]


def test_rows_are_whole(spark, tokenizer):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", " ", "same text", "same text", *(" ".join(word() for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(60))]
    rows = [(k if k % 9 else None, t, "x", 7) for k, t in enumerate(texts)] + [(3, "same text", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, task int").repartition(3)
    got = bp.pack_documents(df, PATH, capacity=256).collect()
    want = Counter()
    for key, text, *_ in rows:
        ids = ids_of(tokenizer, text)
        want[key, len(ids)] += 1
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    starts = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert starts == want
    known = {(key, len(ids)): ids for key, ids in ((k, ids_of(tokenizer, t)) for k, t, *_ in rows) if key is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.ids_crc32 == zlib.crc32(np.array(known[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4"))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == 256 or at & (at - 1) == 0
        short += at < 256
    assert short <= 8


def test_empty_table_and_other_ids(spark):
    assert bp.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    for kind, key in (("string", "k"), ("int", 4), ("decimal(5,0)", None)):
        assert bp.pack_documents(spark.createDataFrame([(key, "one two")], f"doc_id {kind}, text string"), PATH).first().doc_tokens == 3
