"""Sharding by histogram sort, with DataFrame functions alone.

Rows are ordered by two 63-bit keys: a hash of the text, so equal texts are neighbours, then a hash of the id and the row's place
in the input, so that a group of copies of any size can be cut, even one of rows repeated in full. The keys are written to the
shared folder first: a row has the same place in every pass, whatever executors are lost.

The driver looks for the keys at which the rows, in this order, reach given numbers of bytes: each round counts bytes and rows
exactly below evenly spread probes inside the cells that still hold a wanted boundary, and narrows these cells, until every
boundary is as near as the tolerance asks, or its cell holds one key. Where one text's hash holds a boundary, the second key goes on
inside it. Then the rows are exchanged once, dealt to groups of about RANGE_BYTES inside their shards, and numbered there. A group is
a range of text keys; a text that holds more than a group has groups of its own, ranges of the second key, behind the other texts of
its range. So equal texts of a shard have neighbouring slots at every size.

Law `bytes`: shards have nearly equal sizes. Null text has no bytes; null ids are hashed as such. An empty table gives an empty
result. Columns of the input keep their names; a name that begins with `_` should not be one that is added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.llm.common import materialise, table, text_or_empty

#: Keys are 0 <= key < 2 ** KEY_BITS.
KEY_BITS = 63
#: Most cells that the driver gathers in a round, over all boundaries that are open (one cell for each of them at least).
MOST_CELLS = 1 << 16
#: Rows of a shard are numbered in groups of about this many bytes.
RANGE_BYTES = 256 << 20
#: Fewer texts than this get groups of their own (they are broadcast): those that hold more than this part of all bytes, and a range.
MOST_HOT = 10_000


@dataclass(frozen=True)
class Boundary:
    """Rows before (text key, row key) hold so many bytes and rows."""

    key: tuple[int, int]
    bytes: int
    rows: int


def _narrowed(keyed: DataFrame, key: str, within: str | None, cells: dict, place: Callable[[int | None, int], tuple[int, int]], targets: list[tuple[float, float]], best: dict[int, Boundary]) -> dict:
    """Narrows cells {(value of `within`, index): (bytes below, rows below, targets)} of one width round by round. Fills `best`;
    returns what single keys with several rows still hold, as {key: (bytes below, rows below, targets)}."""
    shift, left = KEY_BITS, {}
    while cells:
        step = max(1, min(12, (MOST_CELLS // len(cells)).bit_length() - 1))
        fine = max(0, shift - step)
        group = F.col(within) if within else F.lit(None).cast("long")
        inside = keyed.select(group.alias("within"), F.shiftright(key, fine).alias("cell"), F.shiftright(key, shift).alias("above"), "size")
        if within:
            here = [(F.col("within") == w) & (F.col("above") == index) for w, index in cells]
            inside = inside.where(reduce(Column.__or__, here))
        elif shift < KEY_BITS:
            inside = inside.where(F.col("above").isin([index for _, index in cells]))
        by_cell: dict[tuple, list] = {}
        for r in inside.groupBy("within", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            by_cell.setdefault((r.within, r.cell >> (shift - fine)), []).append(r)
        narrower: dict[tuple, tuple] = {}
        for (w, index), (size, rows, wanted_here) in cells.items():
            parts = sorted(by_cell.get((w, index), []), key=lambda r: r.cell)
            found = [Boundary(place(w, index << shift), size, rows)]
            for r in parts:
                found.append(Boundary(place(w, (r.cell + 1) << fine), found[-1].bytes + r["size"], found[-1].rows + r.n))
            for t in wanted_here:
                near = min(found, key=lambda b: abs(b.bytes - targets[t][0]))
                if t not in best or abs(near.bytes - targets[t][0]) < abs(best[t].bytes - targets[t][0]):
                    best[t] = near
                if abs(best[t].bytes - targets[t][0]) <= targets[t][1]:
                    continue
                for low, high, r in zip(found, found[1:], parts, strict=False):
                    if low.bytes < targets[t][0] < high.bytes and r.n > 1:
                        where, what = (narrower, (w, r.cell)) if fine else (left, r.cell)
                        where.setdefault(what, (low.bytes, low.rows, []))[2].append(t)
        cells, shift = narrower, fine
    return left


def boundaries(keyed: DataFrame, targets: list[tuple[float, float]]) -> list[Boundary]:
    """For each (wanted bytes, tolerance) the boundary nearest to it that rows allow, or one within the tolerance. keyed has
    `text_key`, `row_key` and `size`. The driver sees at most MOST_CELLS cells a round."""
    best: dict[int, Boundary] = {}
    everything = {(None, 0): (0, 0, list(range(len(targets))))} if targets else {}
    heavy = _narrowed(keyed, "text_key", None, everything, lambda _, k: (k, 0), targets, best)
    if heavy:
        some = keyed.where(F.col("text_key").isin(list(heavy)))
        _narrowed(some, "row_key", "text_key", {(k, 0): v for k, v in heavy.items()}, lambda w, k: (w, k), targets, best)
    return [best[t] for t in range(len(targets))]


def _position(key: Column, cuts: list[Boundary]) -> Column:
    """How many of the cuts, which are in order, are at most `key`: a binary search in steps of falling powers of two."""
    bits = max(1, len(cuts).bit_length())
    top = (1 << 63) - 1
    padded = F.array(*[F.struct(*[F.lit(min(k, top)).cast("long") for k in c]) for c in [*(b.key for b in cuts), *[(top, top)] * (2**bits - len(cuts))]])
    steps = F.array(*[F.lit(2**b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= key, at + step).otherwise(at))


def _grouped(rows: DataFrame, total: int) -> DataFrame:
    """Rows with their groups (_cell, _hot, _part), which are ordered: a range of text keys; -1 or, for a text that holds more than
    RANGE_BYTES, its key; a range of row keys in such a text."""
    bits = lambda size: max(0, -(-int(size) // RANGE_BYTES) - 1).bit_length()
    cell = F.shiftright("_text_key", KEY_BITS - bits(total)).alias("_cell")
    if not bits(total):
        return rows.select("*", cell, F.lit(-1).cast("long").alias("_hot"), F.lit(0).cast("long").alias("_part"))
    held = rows.groupBy("_text_key").agg(F.sum("_size").alias("_held")).where(F.col("_held") > max(RANGE_BYTES, total / MOST_HOT))
    hot = held.select("_text_key", F.col("_text_key").alias("_hot"), F.ceil(F.log2(F.col("_held") / RANGE_BYTES)).cast("int").alias("_bits"))
    part = F.coalesce(F.expr(f"shiftright(_row_key, {KEY_BITS} - _bits)"), F.lit(0))
    return rows.join(F.broadcast(hot), "_text_key", "left").withColumns({"_cell": cell, "_hot": F.coalesce("_hot", F.lit(-1)), "_part": part}).drop("_bits")


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None) with _size, _shard and _slot. Boundaries of shards are within `tolerance` of a mean
    shard, or as near as whole rows allow. The kept columns are written once, with the keys."""
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    text = text_or_empty(text_col)
    added = [(F.octet_length(text).cast("long") + 16).alias("_size"), half(text).alias("_text_key"), half(F.col(id_col), F.monotonically_increasing_id()).alias("_row_key")]
    rows = materialise(df.select(*(keep or df.columns), *added), "keyed")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    mean = total / shards
    cuts = boundaries(rows.select(F.col("_text_key").alias("text_key"), F.col("_row_key").alias("row_key"), F.col("_size").alias("size")), [(mean * k, mean * tolerance) for k in range(1, shards)]) if total else []
    cuts.sort(key=lambda b: b.key)
    dealt = _grouped(rows, total).withColumn("_shard", _position(F.struct("_text_key", "_row_key"), cuts))
    group = ["_cell", "_hot", "_part"]
    counts = dealt.groupBy("_shard", *group).agg(F.count("*").alias("_n"))
    begin = counts.withColumn("_begin", F.sum("_n").over(Window.partitionBy("_shard").orderBy(*group)) - F.col("_n")).drop("_n")  # a row for each RANGE_BYTES of the input
    order = Window.partitionBy("_shard", *group).orderBy("_text_key", "_row_key")
    placed = dealt.withColumn("_slot", F.row_number().over(order) - 1).join(begin, ["_shard", *group])
    return placed.withColumn("_slot", (F.col("_slot") + F.col("_begin")).cast("long")).select(*(keep or df.columns), "_size", "_shard", "_slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"))
    out = shard(docs, 40, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
