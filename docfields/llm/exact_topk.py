"""Exact top-k inner products of integer vectors, by pivot-table elimination.

Each vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared length, and a query gets 0 there: then
|q - x|^2 = |q|^2 + M - 2 q.x, so the highest products are the nearest neighbours in a metric space. Distances to pivots are
precomputed; for a query, the largest |d(q,p) - d(x,p)| over the pivots bounds its distance to x from below, hence q.x from
above. Candidates are evaluated in the order of these bounds until the k-th best product is above every bound that is left;
equal bounds are evaluated, so ties are exact.

Queries and candidates are dealt into blocks of bounded size and each pair of blocks meets in one task; the k best of each
pair of blocks are then ranked for each query. Products are exact: whole numbers in floating point as long as their sums stay
below 2 ** 53, Python's whole numbers beyond.

Rows with null vectors, or with null, NaN or infinite components, take no part; neither do rows with a null id. Of vectors of
different lengths the shorter ones count as ending in zeros, so an empty one scores 0 with all. Components beyond a long's range are
taken as its ends, and so is a score. A query never finds itself: candidates with its id are left out. Rows that repeat an id are
candidates each; as queries their results are ranked together under the one id. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import table


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, finite vectors only."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(bad, F.lit(True)).alias("bad")).where(F.col("id").isNotNull() & ~F.col("bad")).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _squared(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))


def _dense(vectors: pd.Series, width: int) -> np.ndarray:
    """A row for each vector, zeros behind its end."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows: each time the one that is farthest from those already taken."""
    taken, far = [], np.full(len(rows), np.inf)
    for _ in range(min(n, len(rows))):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[taken[-1]]) ** 2).sum(axis=1))
    return rows[taken]


def _best(most: np.ndarray, ids: np.ndarray, product: Callable[[np.ndarray], np.ndarray], own: int, k: int, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best candidates of one query in a block, by falling upper bounds `most`, and how many were evaluated."""
    order = np.argsort(-most, kind="stable")
    best_id, best = np.empty(0, np.int64), product(order[:0])
    at = 0
    while at < len(order) and (len(best) < k or most[order[at]] >= best[-1]):
        some = order[at : at + step]
        at += len(some)
        some = some[ids[some] != own]
        best, best_id = np.concatenate([best, product(some)]), np.concatenate([best_id, ids[some]])
        keep = np.lexsort((best_id, ~best))[:k]  # ~ falls as best rises, without overflow
        best, best_id = best[keep], best_id[keep]
    return best_id, best, at


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int = 32, pivot_sample: int = 2048, query_block: int = 2048, candidate_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates (fewer if there are fewer) of each query, and how many candidates
    were evaluated for it. Pivots are taken far apart from a sample of `pivot_sample` candidates; any pivots give exact results.

    Both inputs have (id long, v array<long>). Memory of a task is one block of each; what is shuffled is each candidate once
    for each block of queries, each query once for each block of candidates, and k rows for each query and block of candidates.
    """
    facts = candidates.agg(F.max(_squared("v")).alias("top"), F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    asked = queries.agg(F.max(_squared("v")).alias("top"), F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts.n or not asked.n:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    top, width = float(facts.top), max(facts.width, asked.width, 1)
    exact = np.sqrt(top) * np.sqrt(asked.top) < 2.0**52  # bounds every partial sum
    slack = 1e-7 * np.sqrt(top + asked.top) + 1e-9  # more than the rounding of a distance
    sample = pd.Series([r.v for r in candidates.orderBy(F.xxhash64("id"), "id", "v").limit(pivot_sample).collect()])
    lifted = lambda x: np.hstack([x, np.sqrt(np.maximum(0, top - (x**2).sum(axis=1)))[:, None]])
    chosen = _far_apart(lifted(_dense(sample, width).astype(float)), pivots)
    nc, nq = -(-facts.n // candidate_block), -(-asked.n // query_block)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (chosen**2).sum(axis=1) - 2 * x @ chosen.T))

    ship()

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            whole_q, whole_x = _dense(left["v"], width), _dense(right["w"], width)
            q, x, ids = whole_q.astype(float), whole_x.astype(float), right["other"].to_numpy()
            xd, qd = distances(lifted(x)), distances(np.hstack([q, np.zeros((len(q), 1))]))
            for own, wq, vector, d in zip(left["id"].tolist(), whole_q, q, qd, strict=True):
                low = np.zeros(len(ids))
                for p in range(xd.shape[1]):
                    np.maximum(low, np.abs(xd[:, p] - d[p]), out=low)
                total = float((vector**2).sum()) + top
                most = (total - np.maximum(0, low - slack) ** 2) / 2 + 1e-9 * total + 1e-6
                product = (lambda some, v=vector: (x[some] @ v).astype(np.int64)) if exact else lambda some, v=wq: np.clip(whole_x[some].astype(object) @ v.astype(object), -(2**63), 2**63 - 1).astype(np.int64)
                found, scores, tried = _best(most, ids, product, own, k, 256)
                out.append((np.full(len(found), own), found, scores, np.r_[tried, np.zeros(len(found), np.int64)][: len(found)]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "evaluated"), columns, strict=True)))

    left = queries.withColumns({"qb": block(nq), "cb": F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))})
    right = candidates.select(F.col("id").alias("other"), F.col("v").alias("w"), block(nc).alias("ocb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("oqb"))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("oqb", "ocb")).applyInPandas(meet, "query_id long, vec_id long, score long, evaluated long")
    each = Window.partitionBy("query_id")
    ranked = found.withColumns({"rank": F.row_number().over(each.orderBy(F.desc("score"), "vec_id")), "evaluated": F.sum("evaluated").over(each)})
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return search(vectors.where(F.pmod("id", F.lit(50)) == 0), vectors).drop("evaluated")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
