"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a string there is exactly one token that its encoding can end with. The table of these last tokens is
filled from left to right: an automaton reports the pieces that end at a position, and a piece is the last token if it may
stand after the last token of what precedes it. Whether two tokens may stand side by side is decided by undoing their
merges, latest first, and asking at each step whether the two symbols at the border would have been merged before either
was used up (``PrefixTable.side_by_side``). The ids are then read off backwards.

Text falls apart at spaces and line breaks wherever no piece of the model spans such a place, so each distinct stretch is
encoded once per task (bounded memory) and its ids are reused. Pieces of spaces alone all have one score in common models;
their merges come last and go leftmost first, which ``PrefixTable.spaces`` follows.

Null text counts as empty; an empty text has no ids but the end id. Texts of any length are encoded whole; rows repeated in full
give equal rows, an empty table an empty one. Models must be of type BPE with identity normalization.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import Memory, batch_of, parts_of, rows_of, table, words_of

SPACE = "▁"
#: Spaces that aren't each followed by a word.
RUN_OF_SPACES = re.compile(r"^ |  | \n|\n |^\n| $")
#: Bytes of distinct stretches of text, and pairs of tokens, that a task remembers (a pair takes about 100 bytes).
REMEMBERED, PAIRS = 64 << 20, 300_000


class PrefixTable:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalization are supported")
        kinds = {k: {i for i, p in enumerate(model.pieces) if p.type == v} for k, v in model.pieces[0].Type.items()}
        if kinds["USER_DEFINED"] or kinds["UNUSED"]:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = normal.add_dummy_prefix
        self.end = model.trainer_spec.eos_id
        self.unknown = model.trainer_spec.unk_id
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i in kinds["NORMAL"]}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in kinds["BYTE"]}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.surface = ["" if i in kinds["CONTROL"] else model.trainer_spec.unk_surface if i in kinds["UNKNOWN"] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.chars = {p for p in self.ids if len(p) == 1}
        score = [p.score for p in model.pieces]
        merged = sorted((p for p in self.ids if len(p) > 1 and p.strip(SPACE)), key=lambda p: -score[self.ids[p]])
        if any(SPACE in p[1:] for p in merged) or len({score[self.ids[p]] for p in merged}) < len(merged):
            raise ValueError("pieces with inner spaces or equal scores are not supported")
        self.breaks = not any("\n" in p for p in self.ids)
        self.time = dict.fromkeys(self.chars, -1) | {p: k for k, p in enumerate(merged)}
        self.parts: dict[str, tuple[str, str]] = {}
        for p in merged:  # in the order in which pieces come into being
            if parts := self._last_merge(p):
                self.parts[p] = parts
        self.size = [len(p) for p in self.pieces]
        self.matches = ahocorasick.Automaton()
        for p in [*self.chars, *self.parts]:
            self.matches.add_word(p, (self.ids[p], len(p)))
        self.matches.make_automaton()
        self.gaps = {len(p): i for p, i in self.ids.items() if not p.strip(SPACE)}
        self.pairs: dict[int, bool] = {}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.memory = Memory(self._ids_and_text, REMEMBERED, each=350)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes this piece, or None if merging its characters never gives it."""
        symbols = list(piece)
        if not self.chars.issuperset(symbols):
            return None
        while len(symbols) > 2:
            joined = [(self.time.get(a + b, len(self.time)), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.parts]
            if not joined:
                return None
            k = min(joined)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols[0], symbols[1]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether two tokens may follow one another. Moments are doubled so that, of merges of one piece, those on the left come first."""
        a, b, used_up = self.pieces[left], self.pieces[right], 2 * len(self.time) + 2
        while True:
            if (joined := a + b) in self.parts and 2 * self.time[joined] < used_up:
                return False
            if self.time[a] < 0 and self.time[b] < 0:
                return True
            if self.time[a] > self.time[b]:
                used_up, a = 2 * self.time[a], self.parts[a][1]
            else:
                used_up, b = 2 * self.time[b] + 1, self.parts[b][0]

    def known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last, pairs, many = [-1] * (len(text) + 1), self.pairs, len(self.pieces)
        for at, (token, size) in self.matches.iter(text):
            if last[at + 1] < 0:
                before = at + 1 - size
                if before:
                    pair = last[before] * many + token
                    try:
                        fits = pairs[pair]
                    except KeyError:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.side_by_side(last[before], token)
                    if not fits:
                        continue
                last[at + 1] = token
        size = self.size
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def stretch(self, text: str) -> list[int]:
        """Ids of a text without runs of spaces; characters that are no pieces become bytes."""
        if self.chars.issuperset(text):
            return self.known(text)
        out, at = [], 0
        for k, c in enumerate(text):
            if c not in self.chars:
                out += self.known(text[at:k]) if k > at else []
                out += [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]
                at = k + 1
        return out + (self.known(text[at:]) if at < len(text) else [])

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that no word took: equal scores, so the leftmost pair that makes a piece is merged, again and again."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.gaps:
                out[-2:] = [out[-2] + out[-1]]
        return [self.gaps[k] for k in out]

    def _ids_and_text(self, text: str) -> tuple[str, str]:
        """The ids of a stretch as decimal text, and what they decode to."""
        if self.chars.issuperset(text):
            if text[-1] in ".," and (met := self.memory.met(text[:-1])):  # one more step of the table from a prefix met before
                ids_text, decoded = met
                if self.side_by_side(int(ids_text[ids_text.rfind(" ") + 1 :]), self.ids[text[-1]]):
                    return f"{ids_text} {self.decimal[self.ids[text[-1]]]}", decoded + text[-1]
            ids = self.known(text)
            return " ".join([self.decimal[i] for i in ids]), "".join([self.surface[i] for i in ids])
        ids = self.stretch(text)
        return " ".join(map(str, ids)), self.decoded(ids)

    def stretches(self, text: str) -> Iterator[tuple[str, str]]:
        """(ids as text, decoded text) of each stretch, in order; the text has spaces for its U+2581."""
        head = SPACE if self.prefix else ""
        for k, line in enumerate(text.split("\n") if self.breaks else [text]):
            if k:
                yield self.memory["\n"]
                head = ""
            words = line.split(" ")
            waiting = 0
            for i, word in enumerate(words):
                before = SPACE if i else head
                if not word:
                    waiting += len(before)
                elif not waiting:
                    yield self.memory[before + word]
                else:  # the word's own space joins the run before it, unless the word takes it
                    ids = self.stretch(before + word)
                    alone = bool(before) and ids[0] == self.ids[SPACE]
                    run, rest = self.spaces(waiting + alone), ids[1:] if alone else ids
                    if not before:
                        run, rest = self.spaces(waiting), ids
                    both = run + rest
                    yield " ".join(map(str, both)), self.decoded(both)
                    waiting = 0
            if waiting:
                run = self.spaces(waiting)
                yield " ".join(map(str, run)), self.decoded(run)

    def encoded(self, text: str) -> tuple[str, str]:
        """Decimal ids with the end id, and the decoded text."""
        if not text:
            return str(self.end), ""
        text = text.replace(SPACE, " ")
        if self.breaks and not RUN_OF_SPACES.search(text):
            cut = (SPACE if self.prefix else "") + text.replace(" ", f" {SPACE}").replace("\n", " \n ")
            parts = [self.memory[k] for k in cut.split(" ") if k]
        else:
            parts = list(self.stretches(text))
        decoded = "".join([d for _, d in parts])
        return " ".join([i for i, _ in parts if i]) + f" {self.end}", decoded[1:] if self.prefix and decoded.startswith(" ") else decoded

    def encode(self, texts: pa.Array) -> list[tuple[str, str]]:
        """What `encoded` gives for each text. Each distinct stretch is looked up once; texts with runs of spaces go one by one, and
        so do those whose ids might outgrow an Arrow array of strings."""
        size = pc.binary_length(texts)
        plain = pc.and_not(pc.and_(pc.greater(size, 0), pc.less(size, 1 << 26)), pc.or_(pc.match_substring(texts, SPACE), pc.match_substring_regex(texts, RUN_OF_SPACES.pattern)))
        plain = plain.to_numpy(zero_copy_only=False) & self.breaks
        out = list(map(self.encoded, texts.filter(pa.array(~plain)).to_pylist()))
        if plain.any():
            cut = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(plain)), " ", " " + SPACE), "\n", " \n ")
            ends, number, distinct = words_of(pc.binary_join_element_wise(SPACE, cut, "") if self.prefix else cut, lambda x: pc.split_pattern(x, " "))
            ids, decoded = zip(*[self.memory[w] for w in distinct.to_pylist()], strict=True)
            whole = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.string()).take(pa.array(number))), by).to_pylist() for c, by in ((ids, " "), (decoded, ""))]
            found = iter([(f"{i} {self.end}", d[1:] if self.prefix and d.startswith(" ") else d) for i, d in zip(*whole, strict=True)])
            rest = iter(out)
            out = [next(found) if p else next(rest) for p in plain.tolist()]
        return out

    def forget(self) -> None:
        """Gives the stretches of a task's texts back. Pairs are the model's, of bounded number, and stay for the worker's next task."""
        self.memory.clear()

    def decoded(self, ids: list[int]) -> str:
        """What ids stand for, spaces of the first piece included; bytes that are no UTF-8 become U+FFFD."""
        surface, byte_of, out, raw = self.surface, self.byte_of, [], bytearray()
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(surface[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.decoded(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode(df: DataFrame, id_col: str, text_col: str, model: str, digests: bool = False) -> DataFrame:
    """Encodes every whole text: id, n_tokens, and either the ids and the text decoded from them or, with digests, the
    SHA-256 of both. No shuffle; a worker's memory is the model, the remembered stretches and one slice of texts."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = pa.schema([(id_col, id_type), ("n_tokens", pa.int64()), (names[0], pa.string() if digests else pa.list_(pa.int32())), (names[1], pa.string())])
    schema = f"`{id_col}` {kind}, n_tokens long, {names[0]} {'string' if digests else 'array<int>'}, {names[1]} string"

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = prefix_table(model)
        for part in parts_of(batches):
            keys, done = part.column("id"), codec.encode(part.column("text"))
            counts = [i.count(" ") + 1 for i, _ in done]
            if digests:
                yield batch_of(out, keys, counts, [hashlib.sha256(i.encode()).hexdigest() for i, _ in done], [hashlib.sha256(d.encode()).hexdigest() for _, d in done])
            else:
                yield batch_of(out, keys, counts, [list(map(int, i.split(" "))) for i, _ in done], [d for _, d in done])
        codec.forget()

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, ids_col: str, model: str) -> DataFrame:
    """Decodes arrays of ids: id, decoded. Null ids decode to the empty text."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([(id_col, id_type), ("decoded", pa.string())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = prefix_table(model)
        for keys, ids in rows_of(batches, "id", "ids"):
            yield batch_of(out, keys, [codec.decode(i or []) for i in ids])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", P.path("piece_bpe_32k.model"), digests=True)
