"""Hard negatives for anchors, by slots between the upper limits of their positives.

An anchor's positives are its best rows of the same label. Each gives a window of scores, from `low` to `high` percent of its own
score, in which negatives (rows of another label) are hard but not too hard. The windows overlap, so they are not searched one by
one: the upper limits, distinct and falling, split the scores below the highest into disjoint slots. Each candidate belongs to one
slot, and the best k of a slot are all that any window can need of it. Tasks keep the best k of each slot for a block of anchors
and a block of candidates; these are combined for each slot. The best k up to a limit are then the slot below it followed by what
the slots further down give, cut at k: one merge from the lowest slot upwards answers all windows. What is below a window's lower limit is
dropped last, which leaves the first ones since scores fall.

Queries and candidates are dealt into blocks of bounded size, whatever their labels and values, and each pair of blocks meets in
one task, first for the positives and then for the slots. Scores are exact as in exact_topk.

Rows with null id, label or vector, or with null, NaN or infinite components, take no part. Vectors of unequal lengths count as
ending in zeros. A row never meets rows of its own id, so rows that repeat an id are no positives or negatives of each other; each is
a candidate to other anchors, and each gives rows of its own. Anchors that agree in id, label and vector count once. Positives of a score below 0 have
an empty window; one of 0 has the window 0 to 0. Empty tables give an empty result. Columns beside these three are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import materialise, table

#: Anchors whose scores a task holds at once.
CHUNK = 256


def labelled_vectors(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v): floor(scale * x) of each component; finite vectors with an id and a label only."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("x"), F.coalesce(bad, F.lit(True)).alias("bad"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND NOT bad").select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each vector, zeros behind its end."""
    vectors = vectors.combine_chunks()
    ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], size)] = flat[ends[0] : ends[-1]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact; beyond a long's range its ends."""
    bound = np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max(initial=0))
    if bound < 2.0**52:  # then so are all partial sums
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Those of `some` with the k best scores, ties to smaller ids, in this order."""
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~ falls as a score rises, without overflow


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def positives(anchors: DataFrame, rows: DataFrame, k: int, anchor_block: int, candidate_block: int) -> DataFrame:
    """anchor (a hash of all of it), anchor_id, positive_id, place (from 1), positive_score."""

    def meet(a: np.ndarray, left: dict, b: np.ndarray, right: dict) -> list[tuple]:
        out = []
        for at in range(0, len(a), CHUNK):
            scores = _products(a[at : at + CHUNK], b)
            for j, s in enumerate(scores):
                hits = _best(s, right["id"], np.flatnonzero((right["label"] == left["label"][at + j]) & (right["id"] != left["id"][at + j])), k)
                out.append((np.full(len(hits), left["anchor"][at + j]), np.full(len(hits), left["id"][at + j]), right["id"][hits], s[hits]))
        return out

    found = _meet(anchors, rows, ("label",), meet, ("anchor", "anchor_id", "positive_id", "positive_score"), anchor_block, candidate_block)
    order = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _meet(anchors: DataFrame, rows: DataFrame, carried: tuple[str, ...], meet, names: tuple[str, ...], anchor_block: int, candidate_block: int) -> DataFrame:
    """What `meet` finds in each pair of blocks: anchors (anchor, id, v, and what they carry) and rows (id, code, v)."""
    facts = [df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first() for df in (anchors, rows)]
    width = max(*(f.width or 0 for f in facts), 1)
    na, nc = (max(1, -(-f.n // most)) for f, most in zip(facts, (anchor_block, candidate_block), strict=True))
    ship()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            plain = [{c: t.column(c).to_numpy() if not pa.types.is_list(t.schema.field(c).type) else t.column(c).to_pylist() for c in t.column_names if c != "v"} for t in (left, right)]
            found = meet(_matrix(left.column("v"), width), plain[0], _matrix(right.column("v"), width), plain[1])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    # Rows are a table read from files, so their places stay; by place, rows repeated in full are spread as well.
    left = anchors.select("anchor", "id", "v", *carried, _block(F.struct("anchor", "id"), na).alias("ab")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = rows.select("id", "label", "v", _block(F.monotonically_increasing_id(), nc).alias("cb")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))
    return left.groupBy("ab", "cb").cogroup(right.groupBy("ab", "cb")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def slots(anchors: DataFrame, rows: DataFrame, k: int, anchor_block: int, candidate_block: int) -> DataFrame:
    """anchor, anchor_id, slot, negative_id, negative_score: the k best of each slot. Anchors carry `limits`, distinct upper limits
    in falling order, and `least`, the lowest lower limit; slot j has the scores in (limits[j + 1], limits[j]]."""

    def meet(a: np.ndarray, left: dict, b: np.ndarray, right: dict) -> list[tuple]:
        out = []
        for at in range(0, len(a), CHUNK):
            scores = _products(a[at : at + CHUNK], b)
            for j, s in enumerate(scores):
                limits = np.array(left["limits"][at + j], np.int64)
                some = np.flatnonzero((s <= limits[0]) & (s >= left["least"][at + j]) & (right["label"] != left["label"][at + j]) & (right["id"] != left["id"][at + j]))
                slot = len(limits) - 1 - np.searchsorted(limits[::-1], s[some])
                for n in np.unique(slot):
                    hits = _best(s, right["id"], some[slot == n], k)
                    out.append((np.full(len(hits), left["anchor"][at + j]), np.full(len(hits), left["id"][at + j]), np.full(len(hits), n), right["id"][hits], s[hits]))
        return out

    found = _meet(anchors, rows, ("label", "limits", "least"), meet, ("anchor", "anchor_id", "slot", "negative_id", "negative_score"), anchor_block, candidate_block)
    order = Window.partitionBy("anchor", "anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def mine(anchors: DataFrame, rows: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = 2048, candidate_block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the first
    `n_negatives` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    Both inputs have (id long, label, v array<long>). Memory of a task is one block of each and CHUNK rows of products. What is
    shuffled is each row once for each block of the other side, then for each anchor and block of candidates `n_positives` rows and
    `n_negatives` for each slot; an anchor has at most `n_positives` slots. Nothing goes to the driver but counts.
    """
    codes = F.xxhash64("label")  # labels of any type, compared as numbers
    rows = materialise(rows.select("id", codes.alias("label"), "v"), "rows")
    anchors = anchors.select("id", codes.alias("label"), "v", F.xxhash64("label", "v").alias("anchor")).dropDuplicates(["id", "anchor"])
    at = lambda share, up: (F.ceil if up else F.floor)(F.col("positive_score").cast("decimal(20,0)") * share / 100).cast("long")
    pairs = positives(anchors, rows, n_positives, anchor_block, candidate_block).where("positive_score >= 0").withColumns({"limit": at(high, False), "least": at(low, True)})
    pairs = materialise(pairs, "positives")
    windows = pairs.groupBy("anchor", "anchor_id").agg(F.sort_array(F.collect_set("limit"), asc=False).alias("limits"), F.min("least").alias("least"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "id"), ["anchor", "id"])
    found = slots(asked, rows, n_negatives, anchor_block, candidate_block)
    # Of each slot, from the highest down, at most n_negatives entries; an anchor has a few slots.
    entry = F.struct("slot", (-F.col("negative_score").cast("decimal(20,0)")).alias("falling"), "negative_id", "negative_score")
    listed = found.groupBy("anchor", "anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    merged = listed.join(windows.drop("least"), ["anchor", "anchor_id"]).select("anchor", "anchor_id", "limits", _suffixes(n_negatives).alias("suffixes"))
    answers = pairs.join(merged, ["anchor", "anchor_id"]).withColumn("answer", F.element_at("suffixes", F.array_position("limits", F.col("limit")).cast("int")))
    each = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter("answer", lambda e: e["negative_score"] >= F.col("least"))).alias("place", "e"))
    return each.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("e.negative_id").alias("negative_id"), "positive_score", F.col("e.negative_score").alias("negative_score"))


def _suffixes(k: int) -> Column:
    """For each slot its entries followed by those of the slots below it, cut at k: made from the lowest slot upwards."""
    nothing = F.array(F.filter("found", lambda e: F.lit(False)))
    own = lambda j: F.filter("found", lambda e: e["slot"] == j)
    down = F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1))
    grown = F.aggregate(down, nothing, lambda acc, j: F.concat(F.array(F.slice(F.concat(own(j), acc[0]), 1, k)), acc))
    return F.slice(grown, 1, F.size("limits"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", 256)
    return mine(rows.where(F.pmod("id", F.lit(50)) == 0), rows)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 3
"""
