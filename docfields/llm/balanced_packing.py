"""Packing that balances the sequences' attention cost, planned on a histogram of lengths.

A document is its ids and an end id. Longer ones are cut into pieces of `capacity` tokens, the last one shorter. A piece of n
tokens costs `linear * n + quadratic * n * n`, in whole numbers. Pieces are taken by falling length, each into the sequence of the
lowest cost that has room for it. There are as many sequences as the tokens fill: full ones, and for what is left one for each
power of two in it. So no sequence needs padding, and a piece that fits nowhere is cut at the roomiest sequence, which it fills;
its rest waits for its turn among the pieces of its own length.

The driver sees how many pieces there are of each length (at most `capacity` numbers) and plans counts: many alike sequences take
many alike pieces in one step. A piece finds its places by its rank within its length. Ranks are counted without a sort: a task
numbers its own pieces of each length, and to that comes how many the tasks before it have. Ids travel once, beside the piece,
since a checksum of a part needs them.

Null text counts as empty and yields the end id alone. Rows repeated in full, and rows with null or equal ids, are packed each.
Very long texts are encoded alone, one at a time. An empty table gives no rows. Columns beside id and text are not looked at.
"""

from __future__ import annotations

import heapq
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import materialise, parts_of, table
from docfields.llm.packing import LETTERS, Encoder, Ragged

#: Cost of a token beside the others of its piece, for layers of width d: 24 d^2 of weights to 4 d for each token attended to.
LINEAR, QUADRATIC = 6 * 1024, 1
#: Distinct words that a worker remembers from slice to slice and from task to task, about 150 bytes each; when there are more, or
#: more than so many characters for each on average, it goes on with those met in several slices and no longer than LONG.
REMEMBERED, CHARACTERS, LONG = 400_000, 16, 64
FIRST, LINE = "\x01", "\x02"
#: Marks that stay one token group behind a word; an apostrophe may begin a group of its own.
MARKS = "".join(c for c in string.punctuation if c != "'")
#: All that may be white space to a tokenizer; more than it takes for such does no harm.
SPACE = r"\s\v\x1c-\x1f\x{85}\p{Z}"


class Numbers(dict):
    """Numbers from 0 for keys, in the order in which they were first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class ByteEncoder(Encoder):
    """The ids of texts for byte-level tokenizers whose groups never hold white space after something else: a text may be cut
    before a space or line break that follows another character. Each distinct stretch between such cuts is encoded once, and
    plain words apart from the marks behind them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probe = "a b,\n c \n\nd  e\t f\n"
        parts = ["a", " b,", "\n c", " \n\nd", "  e\t f", "\n"]
        if self.slow(probe) != [i for p in parts for i in self.slow(p)]:
            raise ValueError("the tokenizer must not join white space to what stands before it")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in [" ", *map(chr, range(0xC0, 0x100))]})
        self.space = self.spelt[ord(" ")]
        letters = [c for c in map(chr, range(0x41, 0x100)) if re.fullmatch(f"[{LETTERS}]", c)]
        probes = [s + w for w in [*letters, "".join(letters), "0123", *"the Straße naïveté ÜBERMÄSSIG".split()] for s in ("", " ")]
        self.direct = all(self.slow(w) == self.fast(w) and all(self.slow(w + e) == self.slow(w) + self.slow(e) for e in (*MARKS, MARKS)) for w in probes)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.clear()

    def fast(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.spelt))]

    def ready(self, word: str) -> list[int]:
        """The ids of a word of ASCII letters, or a number, that may follow a space: only that is spelt otherwise by the model."""
        return [t.id for t in self.model.tokenize(self.space + word[1:] if word[0] == " " else word)]

    def clear(self) -> None:
        self.number, self.known = Numbers({"": 0}), Ragged(np.empty(0, "<u4"), np.array([0, 0]))
        self.met, self.held = np.ones(1, np.int64), 0

    def numbers(self, words: list[str], how: Callable[[str], list[int]]) -> np.ndarray:
        """The run of `known` that holds each word's ids; words not met before are encoded."""
        before = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > before:
            new = list(islice(reversed(self.number), len(self.number) - before))[::-1]
            ids = list(map(how, new))
            flat = np.fromiter(chain.from_iterable(ids), "<u4")
            self.known = Ragged(np.concatenate([self.known.ids, flat]), np.concatenate([self.known.ends, self.known.ends[-1] + np.cumsum(list(map(len, ids)))]))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            self.held += sum(map(len, new))
        self.met[found] += 1
        return found

    def forget(self) -> None:
        """Keeps the words met in several slices, at most three quarters of what may be remembered. Old meetings count half, so
        words that no longer come are forgotten in time."""
        words, least = list(self.number), 2
        size = np.fromiter(map(len, words), np.int64, len(words))
        most, kept = REMEMBERED * 3 // 4, (size <= LONG) & (self.met >= least)
        while np.count_nonzero(kept) > most or size[kept].sum() > most * CHARACTERS:
            least += 1
            kept &= self.met >= least
        kept[0] = True
        which = np.flatnonzero(kept)
        self.number = Numbers({words[k]: n for n, k in enumerate(which.tolist())})
        self.known, self.met, self.held = self.known.take(which), (self.met[which] + 1) // 2, sum(map(len, self.number))

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text. A text that holds FIRST, LINE or the model's sign for a space itself is encoded whole."""
        odd = pc.match_substring_regex(texts, f"[{FIRST}{LINE}{self.space}]").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(plain, "\n", f" {LINE}"), ""), " ")
        words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        # A stretch goes on past a word that is empty or ends in white space.
        open_ = pc.match_substring_regex(distinct, f"(^|[{FIRST}{LINE}{SPACE}])$").to_numpy(zero_copy_only=False)[which]
        head = np.append(True, ~open_[:-1]) if len(words) else np.empty(0, bool)
        head[ends[:-1]] = True
        heads = np.flatnonzero(head)
        size = np.diff(np.append(heads, len(words)))
        joined = size > 1
        run = which[heads].astype(np.int64)
        used = np.zeros(len(distinct), bool)
        used[run[~joined]] = True
        rest = iter(_strings(words.filter(pa.array(np.repeat(joined, size)))))
        stretches = Numbers()
        run[joined] = [len(distinct) + stretches[_shown(list(islice(rest, n)))] for n in size[joined].tolist()]
        parts = np.zeros((len(distinct) + len(stretches), 3), np.int64)
        parts[: len(distinct)][used] = self._parts(distinct.filter(pa.array(used)))
        parts[len(distinct) :, 1] = self.numbers(list(stretches), self.slow)
        runs = self.known.take(parts.ravel())
        found = Ragged(runs.ids, runs.ends[::3]).take(run).joined(np.searchsorted(heads, ends))
        if len(self.number) > REMEMBERED or self.held > REMEMBERED * CHARACTERS:
            self.forget()
        if not odd.any():
            return found
        ids = [np.array(self.slow(t), "<u4") if whole else found.ids[a:b] for t, whole, a, b in zip(texts.to_pylist(), odd, found.ends[:-1], found.ends[1:], strict=True)]
        return Ragged(np.concatenate(ids), np.append(0, np.cumsum(list(map(len, ids)))))

    def _parts(self, words: pa.Array) -> np.ndarray:
        """The runs of `known` that each word, with the space or line break before it, is made of."""
        found = pc.extract_regex(words, f"^(?P<before>[{FIRST}{LINE}]?)(?P<stem>[{LETTERS}]+|[0-9]+)(?P<marks>[{re.escape(MARKS)}]*)$")
        plain = found.is_valid().to_numpy(zero_copy_only=False) & self.direct
        parts = np.zeros((len(words), 3), np.int64)
        lines = pc.fill_null(pc.equal(found.field("before"), LINE), False).to_numpy(zero_copy_only=False)
        parts[plain & lines, 0] = self.numbers(["\n"], self.slow)[0]
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(found.field("before"), ""), " ", ""), found.field("stem"), "")
        simple = plain & pc.fill_null(pc.string_is_ascii(found.field("stem")), False).to_numpy(zero_copy_only=False)
        for at, which, column, how in ((1, simple, spaced, self.ready), (1, plain & ~simple, spaced, self.fast), (2, plain, found.field("marks"), self.slow)):
            coded = column.filter(pa.array(which)).dictionary_encode()
            if len(coded):
                parts[which, at] = self.numbers(_strings(coded.dictionary), how)[coded.indices.to_numpy()]
        others = _strings(words.filter(pa.array(~plain)))
        parts[~plain, 1] = self.numbers([_shown([w]) for w in others], self.slow)
        return parts


def _strings(texts: pa.Array) -> list[str]:
    """What `to_pylist` gives for texts without nulls, about six times faster, since no scalar is made for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _shown(words: list[str]) -> str:
    """The stretch of text that these words of a split stand for."""
    return "".join(w[1:] if w.startswith(FIRST) else "\n" + w[1:] if w.startswith(LINE) else " " + w for w in words)


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


PIECES = "start long, length int, doc_tokens long, ids_crc32 long, ids binary, task int, nth long"


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end: int = 0) -> DataFrame:
    """id, start, length, doc_tokens, ids_crc32 and the ids (little-endian, of 16 bits if the vocabulary allows, else 32) of each piece;
    `task` made it and gave it the number `nth` among its pieces of that length."""
    kind = df.schema[id_col].dataType.simpleString()
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met, last = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end], "<u4")
        width = "<u4" if end >= 1 << 16 else encoder(tokenizer).width
        for part in parts_of(batches):
            found = encoder(tokenizer).encode(part.column("text"))
            rows, taken = [], []
            for k, (a, b) in enumerate(zip(found.ends[:-1].tolist(), found.ends[1:].tolist(), strict=True)):
                whole = np.concatenate([found.ids[a:b], last])
                for at in range(0, len(whole), capacity):
                    piece = whole[at : at + capacity]
                    rows.append((at, len(piece), len(whole), zlib.crc32(piece), piece.astype(width).tobytes(), task, int(met[len(piece)])))
                    met[len(piece)] += 1
                    taken.append(k)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            arrays = [part.column("id").take(pa.array(taken, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "nth"])

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


@dataclass(frozen=True)
class Plan:
    """Steps: pieces of a length with ranks in [low, high) put `size` of their tokens, from `at` on, into the sequences `first`,
    `first` + 1, ... behind `offset` tokens. `cuts` is how often these pieces were cut before; for one number of cuts the steps'
    ranks are disjoint. Steps are in the order of (cuts, length, low)."""

    cuts: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    size: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the piece, number of the step) of all parts of these pieces."""
        pieces_, steps = [], []
        for cuts in np.unique(self.cuts):
            lo, hi = np.searchsorted(self.cuts, [cuts, cuts + 1])
            starts = np.array(list(zip(self.length[lo:hi], self.low[lo:hi], strict=True)), dtype=[("n", "i8"), ("r", "i8")])
            k = lo - 1 + np.searchsorted(starts, np.array(list(zip(length, rank, strict=True)), dtype=starts.dtype), side="right")
            hit = np.flatnonzero(k >= lo)
            hit = hit[(self.length[k[hit]] == length[hit]) & (rank[hit] < self.high[k[hit]])]
            pieces_.append(hit)
            steps.append(k[hit])
        return np.concatenate([*pieces_, np.empty(0, np.int64)]), np.concatenate([*steps, np.empty(0, np.int64)])


def plan(histogram: dict[int, int], capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> Plan:
    total = sum(n * k for n, k in histogram.items())
    tail = [1 << k for k in reversed(range(capacity.bit_length())) if total % capacity >> k & 1]
    # (cost, room, size) -> [(first sequence, how many)]
    alike: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    if total >= capacity:
        alike[0, capacity, capacity].append((0, total // capacity))
    for k, size in enumerate(tail):
        alike[0, size, size].append((total // capacity + k, 1))
    todo = defaultdict(list, {n: [(n, 0, k, 0, 0)] for n, k in histogram.items() if k})  # length left -> (length, low, high, at, cuts)
    steps = []

    def put(state: tuple[int, int, int], size: int, of: tuple[int, int, int, int, int]) -> tuple[int, tuple[int, int, int]]:
        """One step: sequences of a state take `size` tokens of as many pieces. The pieces taken, and the sequences' new state."""
        cost, room, whole = state
        length, low, high, at, cuts = of
        first, n = alike[state].pop()
        m = min(n, high - low)
        if m < n:
            alike[state].append((first + m, n - m))
        elif not alike[state]:
            del alike[state]
        steps.append((cuts, length, low, low + m, at, size, first, whole - room))
        new = (cost + linear * size + quadratic * size * size, room - size, whole)
        if new[1]:
            alike[new].append((first, m))
        return m, new

    for size in range(max(todo, default=0), 0, -1):
        if size not in todo:
            continue
        fit = [s for s in alike if s[1] >= size]
        heapq.heapify(fit)
        for of in todo.pop(size):
            while of[1] < of[2]:
                while fit and fit[0] not in alike:
                    heapq.heappop(fit)
                length, low, high, at, cuts = of
                if fit:
                    m, new = put(fit[0], size, of)
                    if new[1] >= size:
                        heapq.heappush(fit, new)
                else:
                    state = max(alike, key=lambda s: (s[1], -s[0]))
                    m, _ = put(state, state[1], of)
                    todo[size - state[1]].append((length, low, low + m, at + state[1], cuts + 1))
                of = (length, low + m, high, at, cuts)
    columns = np.array(sorted(steps), dtype=np.int64).reshape(-1, 8).T
    return Plan(*columns)


def pack(found: DataFrame, id_col: str, capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each part of the pieces, a table that can be read again."""
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than the capacity")
    steps = plan(histogram, capacity, linear, quadratic)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = found.join(before, ["length", "task"]).select(id_col, "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("before") + F.col("nth")).alias("rank"))
    kind = found.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, start, rank, crc = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "start", "rank", "ids_crc32"))
            piece, step = steps.places(length, rank)
            at, size = steps.at[step], steps.size[step]
            sums, ids = crc[piece], batch.column("ids")
            for k in np.flatnonzero(size != length[piece]).tolist():
                whole = ids[int(piece[k])].as_buffer()
                kept = np.frombuffer(whole, "<u2" if whole.size == 2 * length[piece[k]] else "<u4")
                sums[k] = zlib.crc32(kept[at[k] : at[k] + size[k]].astype("<u4"))
            row = pa.array(piece)
            arrays = [batch.column(id_col).take(row), pa.array(start[piece] + at), pa.array(size), pa.array(sums), batch.column("doc_tokens").take(row), pa.array(steps.first[step] + rank[piece] - steps.low[step]), pa.array(steps.offset[step])]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ship()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = 0, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    return pack(materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end), "pieces"), id_col, capacity, linear, quadratic)


def op13_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
