"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens carry character spans; these are joined, as intervals, to the spans of the
document's sections or fields, and a token that crosses a boundary is given to one of them by a stated rule:

* ``largest`` (default): the section that holds most of its characters, the earlier one on ties;
* ``first``: the section that holds its first character that lies in any section;
* ``split``: each section gets the share of the token's characters that it holds.

Counts of a document's sections add up to the document's tokens wherever the sections cover the text.
Null text counts as empty: one section (0, 0, 0) without tokens. Characters outside every section belong to none.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, rows_of, table

RULES = ("largest", "first", "split")
Spans = list[tuple[int, int]]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """The tokenizer and the length in bytes of each of its tokens; one of each per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of each token. A token of part of a character spans that whole character."""
    encoding, size = _encoder(path, pattern)
    ids = encoding.encode_to_numpy(text, disallowed_special=())
    ends = np.cumsum(size[ids])
    starts = ends - size[ids]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(raw) == len(text):
        return starts, ends
    place = np.cumsum((raw & 0xC0) != 0x80) - 1
    return place[starts], place[ends - 1] + 1


def line_sections(text: str) -> Spans:
    """Each line with the line break that ends it."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, spans: Spans, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each span, and tokens that touch it and something outside it. Spans are in order and apart."""
    first, last = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    own = np.clip(np.searchsorted(last, starts, side="right"), 0, len(spans) - 1)  # the first span that ends after the token's start
    inside = (starts >= first[own]) & (ends <= last[own])
    got = np.bincount(own[inside], minlength=len(spans)).astype(float)
    crossing = np.zeros(len(spans), dtype=np.int64)
    for a, b, k in zip(starts[~inside].tolist(), ends[~inside].tolist(), own[~inside].tolist(), strict=True):
        held = []
        while k < len(spans) and first[k] < b:
            if (n := min(b, last[k]) - max(a, first[k])) > 0:
                held.append((k, n))
                crossing[k] += 1
            k += 1
        if held and rule == "split":
            for k, n in held:
                got[k] += n / (b - a)
        elif held:
            got[held[0][0] if rule == "first" else max(held, key=lambda x: (x[1], -x[0]))[0]] += 1
    return got, crossing


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str, pattern: str, sections: Callable[[str], Spans] = line_sections, rule: str = "largest") -> DataFrame:
    """A row for each section of each document: id, section (from 0), its characters, its tokens, those of them that cross
    its edge, and the document's tokens. No shuffle; a task holds one batch of texts."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, section int, start_char long, end_char long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long, document_tokens long"
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([(id_col, ids), ("section", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.float64() if rule == "split" else pa.int64()), ("n_crossing", pa.int64()), ("document_tokens", pa.int64())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches, "id", "text"):
            cols: list[list] = [[] for _ in out]
            for key, text in zip(keys, texts, strict=True):
                starts, ends = token_spans(text, tokenizer, pattern)
                spans = sections(text)
                got, crossing = attribute(starts, ends, spans, rule)
                n = len(spans)
                for c, v in zip(cols, ([key] * n, range(n), [a for a, _ in spans], [b for _, b in spans], (got if rule == "split" else got.astype(np.int64)).tolist(), crossing.tolist(), [len(starts)] * n), strict=True):
                    c.extend(v)
            yield batch_of(out, *cols)

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)


def count_field_tokens(df: DataFrame, id_col: str, fields: list[str], tokenizer: str, pattern: str, separator: str = "\n", rule: str = "largest") -> DataFrame:
    """Tokens of each of several text columns of a row, which are joined by the separator and encoded as one document.
    Null fields are empty. Separators belong to no field; returns `field` beside the columns of count_tokens."""
    mark = "\x00"  # keeps the field boundaries while the row travels as one text; a text's own marks are doubled
    packed = F.concat_ws(mark + "|", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(mark), F.lit(mark + mark)) for c in fields])
    whole, spans = _unpack(mark, separator)
    rows = df.select(F.col(id_col), F.struct(packed.alias("packed")).alias("row")).select(id_col, F.col("row.packed").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    names = list(fields)
    schema = f"`{id_col}` {kind}, field string, start_char long, end_char long, n_tokens double, n_crossing long, document_tokens long"
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([(id_col, ids), ("field", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("document_tokens", pa.int64())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches, id_col, "text"):
            cols: list[list] = [[] for _ in out]
            for key, text in zip(keys, texts, strict=True):
                parts = whole(text)
                at = spans(parts)
                starts, ends = token_spans(separator.join(parts), tokenizer, pattern)
                got, crossing = attribute(starts, ends, at, rule)
                for c, v in zip(cols, ([key] * len(at), names, [a for a, _ in at], [b for _, b in at], got.tolist(), crossing.tolist(), [len(starts)] * len(at)), strict=True):
                    c.extend(v)
            yield batch_of(out, *cols)

    return rows.mapInArrow(run, schema)


def _unpack(mark: str, separator: str) -> tuple[Callable[[str], list[str]], Callable[[list[str]], Spans]]:
    def whole(packed: str) -> list[str]:
        parts, at = [""], 0
        while (i := packed.find(mark, at)) >= 0:
            parts[-1] += packed[at:i]
            if packed[i + 1] == mark:
                parts[-1] += mark
            else:
                parts.append("")
            at = i + 2
        parts[-1] += packed[at:]
        return parts

    def spans(parts: list[str]) -> Spans:
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p) + len(separator)
        return out

    return whole, spans


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary-crossing tokens going to the line that holds most of them."""
    import public_tokenizers as P

    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
