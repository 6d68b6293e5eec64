"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces of at most `capacity` tokens. The driver sees only how many pieces there are of each length (at
most `capacity` numbers) and packs counts: longest lengths first, each into the sequences with the least room that suffices,
many alike sequences at once. The plan says for each length which slots, in order, its pieces take; a piece takes the slot
with its rank within its length. The ranks are counted in salted groups, so a length that a third of all pieces share is
dealt to many tasks.

Null text counts as empty and yields a piece of the end id alone. Rows repeated in full get slots of their own. Only pieces of
documents longer than the capacity are cut.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, materialise, parts_of, table, words_of

#: Distinct words that a task remembers from slice to slice, about 150 bytes each.
REMEMBERED = 150_000
#: Letters that have one lower case of one character, and marks whose runs are apart from the letters before them.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "".join(c for c in string.punctuation if c != "'")


class Encoder:
    """The ids of words. Tokenizers that drop white space and whose tokens never span it give a text's ids word by word. Words of
    LETTERS go straight to the model in lower case, past a normalizer and a splitter that would do no more to them, and the
    marks behind them apart, where the tokenizer is seen to do just that."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        if self.tokenizer.pre_tokenizer is None or self.slow("a b \t\n\r\v\f c") != [i for w in "abc" for i in self.slow(w)]:
            raise ValueError("the tokenizer must drop white space")
        letters = [c for c in map(chr, range(0x41, 0x100)) if re.fullmatch(f"[{LETTERS}]", c)]
        probes = [*letters, "".join(letters), *"the Straße naïveté ÜBERMÄSSIG".split()]
        self.direct = all(self.slow(w) == self.fast(w.lower()) and all(self.slow(w + e) == self.slow(w) + self.slow(e) for e in (*MARKS, MARKS)) for w in probes)
        self.clear()

    def slow(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def fast(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelt))]

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.known = Ragged(np.empty(0, "<u4"), np.array([0, 0]))

    def numbers(self, words: list[str], how: Callable[[str], list[int]]) -> np.ndarray:
        """The run of `known` that holds each word's ids; words not met before are encoded."""
        new = [w for w in words if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            ids = list(map(how, new))
            flat = np.fromiter(chain.from_iterable(ids), "<u4")
            self.known = Ragged(np.concatenate([self.known.ids, flat]), np.concatenate([self.known.ends, self.known.ends[-1] + np.cumsum(list(map(len, ids)))]))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text. Each distinct word of them is encoded once, and each stem once for all its marks and cases."""
        if len(self.number) > REMEMBERED:
            self.clear()
        ends, number, distinct = words_of(texts)
        found = pc.extract_regex(distinct, f"^(?P<stem>[{LETTERS}]+)(?P<marks>[{re.escape(MARKS)}]*)$")
        plain = found.is_valid().to_numpy(zero_copy_only=False) & self.direct
        stems, marks = (c.filter(pa.array(plain)).dictionary_encode() for c in (pc.utf8_lower(found.field("stem")), found.field("marks")))
        parts = np.zeros((len(distinct), 2), np.int64)
        for at, coded, how in ((0, stems, self.fast), (1, marks, self.slow)):
            parts[plain, at] = self.numbers(coded.dictionary.to_pylist(), how)[coded.indices.to_numpy()]
        parts[~plain, 0] = self.numbers(distinct.filter(pa.array(~plain)).to_pylist(), self.slow)
        words = self.known.take(parts.ravel())
        return Ragged(words.ids, words.ends[::2]).take(number).joined(ends)


@dataclass(frozen=True)
class Ragged:
    """Runs of ids, one after the other: run k is ids[ends[k]:ends[k + 1]]."""

    ids: np.ndarray
    ends: np.ndarray

    def take(self, which: np.ndarray) -> Ragged:
        """The runs of these numbers, in this order."""
        first, size = self.ends[which], np.diff(self.ends)[which]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        return Ragged(self.ids[np.repeat(first - (last - size), size) + np.arange(total)], np.append(0, last))

    def joined(self, ends: np.ndarray) -> Ragged:
        """Runs made of the runs ends[k] to ends[k + 1]."""
        return Ragged(self.ids, self.ends[ends])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end: int = 0, with_ids: bool = False) -> DataFrame:
    """id, piece (from 0), start, length, ids_crc32 and, if wanted, the ids of each piece."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = [(id_col, id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4")
        for part in parts_of(batches):
            found = encoder(tokenizer).encode(part.column("text"))
            rows = []
            for key, a, b in zip(part.column("id").to_pylist(), found.ends[:-1].tolist(), found.ends[1:].tolist(), strict=True):
                whole = np.concatenate([found.ids[a:b], last])
                for n, at in enumerate(range(0, len(whole), capacity)):
                    piece = whole[at : at + capacity]
                    rows.append((key, n, at, len(piece), zlib.crc32(piece), *([piece.astype(np.int32)] if with_ids else [])))
            yield batch_of(out, *([list(c) for c in zip(*rows, strict=True)] or [[] for _ in out]))
        encoder(tokenizer).clear()

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots as (length, first rank, end rank, first sequence, pieces in each sequence, offset): ranks first..end take sequences
    first sequence, + 1, ..., so many pieces in each, one behind the other from the offset. Best fit, longest first; a sequence
    that fits a length takes as many of it as it holds before the next is looked at, as best fit does with equal lengths."""
    room: dict[int, list[tuple[int, int]]] = {}  # left over -> [(first sequence, how many)]
    sizes: list[int] = []  # the keys of room, in order
    out, used = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(sizes, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                left = sizes[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[k]
            else:
                left, first = capacity, used
                n = -(-todo // (capacity // length))
                used += n
            each = left // length
            full = min(n, todo // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - left))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, first, full)
                first, n = first + full, n - full
            if n and todo:  # fewer are left than one sequence holds
                out.append((length, rank, rank + todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                first, n, todo = first + 1, n - 1, 0
            put(left, first, n)
    return out


def pack(found: DataFrame, capacity: int, tie: list[str], salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a `length`; `tie` names columns that order pieces of one length."""
    cells = found.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int"))
    counts = cells.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than the capacity")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = cells.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*tie)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slots = found.sparkSession.createDataFrame(plan(histogram, capacity), "_length long, _from long, _to long, _first long, _each long, _offset long")
    # A length has a few slots for each of at most `capacity` kinds of room, whatever the number of pieces.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    return placed.withColumns({"sequence_id": F.col("_first") + F.floor(at / F.col("_each")).cast("long"), "offset": F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")}).drop("_salt", "_rank", "_before", "_length", "_from", "_to", "_first", "_each", "_offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    found = materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end), "pieces")
    return pack(found, capacity, [id_col, "piece", "start", "ids_crc32"]).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
