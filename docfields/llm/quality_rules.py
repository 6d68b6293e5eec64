"""Quality rules, and an isolation forest on their statistics.

A document's statistics come from its words (stretches of characters other than space and the control characters 9 to 13).
Base rules, which look at length and repetition, reject it outright; the others are judged by an isolation forest on the two
statistics that the base rules leave alone, characters in a word and symbols in a word: trees that split random statistics at
random places, in which odd documents end after short paths. The forest is grown without labels; each tree draws its rows from all.
Labelled rows, all of them, only calibrate the threshold, so that at most `clean_loss` of the good ones are rejected.

Null text has no words: it fails the base rules. Rows repeated in full get the same verdict; texts of any length are counted whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, materialise, rows_of, table

#: The characters that count as symbols, and the blanks that part words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Thresholds are multiples of 1 / PLACES.
PLACES = 1 << 16


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    shifted = [words[k:] for k in range(WINDOW)]
    if len(set(zip(*shifted, strict=False))) == max(0, len(words) - WINDOW + 1):
        return 0
    counts = Counter(zip(*shifted, strict=False))
    covered = end = 0
    for at, window in enumerate(zip(*shifted, strict=False)):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS, and the ratios that the forest sees; symbols as a root, so that few differ from none."""
    raw = text.encode()
    words = raw.split()  # bytes split at just these blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    size = max(1, n)
    ratios = (chars / size, min(1.0, symbols / size) ** 0.5)
    return (n, chars, symbols, dup, repeats), ratios


def base_failed(counts: tuple[int, ...]) -> bool:
    n, *_, repeats = counts
    return n < 10 or 100 * repeats > 20 * n


@dataclass(frozen=True)
class Forest:
    """Trees in arrays: the feature split (-1 at a leaf), the place, the left child (the right one follows), the path length."""

    feature: np.ndarray
    place: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    norm: float
    height: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of rows, 0 to 1: 2 to the power of minus the mean path length over its expected value."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.height):
                f = self.feature[t][node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.place[t][node]
                node = np.where(inner, self.child[t][node] + right, node)
            total += self.depth[t][node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = 200, rows: int = 32, seed: int = 7) -> Forest:
    """A forest on an array: each tree draws `rows` of its rows."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    return grow_of([x[rng.choice(len(x), rows, replace=False)] for _ in range(trees)], rows, seed)


def grow_of(drawn: list[np.ndarray], rows: int, seed: int = 7) -> Forest:
    """A tree on each of the draws. Splits take a random column that still varies. Few rows a tree keep odd rows that are many from
    hiding one another."""
    rng = np.random.default_rng(seed)
    trees = len(drawn)
    height = int(np.ceil(np.log2(max(2, rows))))
    width = 2 ** (height + 1)
    feature, place, child, depth = np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width), dtype=np.int64), np.zeros((trees, width))
    for t in range(trees):
        todo, used = [(0, drawn[t], 0)], 1
        while todo:
            node, part, d = todo.pop()
            open_features = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and d < height else []
            if not len(open_features):
                depth[t, node] = d + _expected(len(part))
                continue
            f = int(rng.choice(open_features))
            low, high = part[:, f].min(), part[:, f].max()
            at = rng.uniform(low, high)
            at = high if at <= low else at
            right = part[:, f] >= at
            feature[t, node], place[t, node], child[t, node] = f, at, used
            todo += [(used, part[~right], d + 1), (used + 1, part[right], d + 1)]
            used += 2
    return Forest(feature, place, child, depth, max(_expected(rows), 1e-9), height)


@dataclass(frozen=True)
class Model:
    forest: Forest | None
    threshold: float


def _mixed(keys: np.ndarray, trees: int) -> np.ndarray:
    """A random-looking number for each tree and key, the same at every run."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[None, :] + np.arange(1, trees + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _drawn(measured: DataFrame, trees: int, rows: int) -> list[np.ndarray]:
    """For each tree the `rows` of all rows whose numbers are least: tasks keep their least, and the least of these are taken."""
    out = pa.schema([("tree", pa.int32()), ("place", pa.int64()), ("chars", pa.float64()), ("symbols", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, x = np.empty((trees, 0), dtype=np.int64), np.empty((trees, 0, 2))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys, ratios = part.column("key").to_numpy(), np.stack([part.column(c).to_numpy() for c in ("chars", "symbols")], axis=1)
                order = np.lexsort((ratios[:, 1], ratios[:, 0], keys))  # rows that tie are taken in one order
                keys, ratios = keys[order], ratios[order]
                place = np.concatenate([place, _mixed(keys, trees)], axis=1)
                x = np.concatenate([x, np.broadcast_to(ratios, (trees, *ratios.shape))], axis=1)
                least = np.argsort(place, axis=1, kind="stable")[:, :rows]
                place, x = np.take_along_axis(place, least, axis=1), np.take_along_axis(x, least[:, :, None], axis=1)
        if place.shape[1]:
            n = place.shape[1]
            yield batch_of(out, pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), pa.array(place.ravel()), pa.array(x[:, :, 0].ravel()), pa.array(x[:, :, 1].ravel()))

    best = Window.partitionBy("tree").orderBy("place", "chars", "symbols")
    drawn = measured.select("key", "chars", "symbols").mapInArrow(run, "tree int, place long, chars double, symbols double").withColumn("k", F.row_number().over(best)).where(F.col("k") <= rows)
    found: list[list] = [[] for _ in range(trees)]
    for r in sorted(tuple(r) for r in drawn.select("tree", "place", "chars", "symbols").collect()):
        found[r[0]].append(r[2:])
    return [np.array(f) for f in found] if found[0] else []


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", clean_loss: float = 0.002, trees: int = 200, rows: int = 32) -> Model:
    """The forest and its threshold. Each tree draws `rows` of all rows, as isolation forests do, and every labelled row calibrates;
    rows that fail the base rules do neither. The driver gathers what the trees drew and, of labelled rows, counts in at most PLACES
    ranges of scores. The threshold is the range's beginning with the best balanced accuracy among those that reject at most `clean_loss`
    of the rows labelled good; without labels it rejects none."""
    docs = docs.where(F.col(text_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([("id", id_type), ("key", pa.int64()), ("chars", pa.float64()), ("symbols", pa.float64())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in rows_of(batches, "id", "key", "text"):
            found = [(i, k, *r) for i, k, (c, r) in zip(ids, keys, map(statistics, texts), strict=True) if not base_failed(c)]
            yield batch_of(out, *(map(list, zip(*found, strict=True)) if found else [[], [], [], []]))

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    measured = materialise(given.mapInArrow(run, f"id {kind}, key long, chars double, symbols double"), "ratios")
    drawn = _drawn(measured, trees, rows)
    if not drawn or len(drawn[0]) < 2:
        return Model(None, 2.0)
    forest = grow_of(drawn, min(rows, len(drawn[0])))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(np.stack([batch.column(c).to_numpy() for c in ("chars", "symbols")], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.floor(score * PLACES).astype(np.int32))], names=["label", "at"])

    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    counts = measured.join(marked, "id").select("label", "chars", "symbols").mapInArrow(scored, "label int, at int").groupBy("label", "at").count()
    of = np.zeros((2, PLACES + 1), dtype=np.int64)
    for label, at, n in counts.collect():
        if label in (0, 1):
            of[label, at] += n
    bad, good = of
    if not good.sum() or not bad.sum():
        return Model(forest, 2.0)
    # What a threshold at the beginning of a range rejects is all from there on.
    lost, caught = (np.cumsum(n[::-1])[::-1] / n.sum() for n in (good, bad))
    gain = np.where(lost <= clean_loss, caught - lost, -1.0)
    best = int(np.argmax(gain))
    return Model(forest, best / PLACES if gain[best] > 0 else 2.0)


def judge(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, anomaly and kept. No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([(id_col, id_type), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches, "id", "text"):
            found = [statistics(t) for t in texts]
            anomaly = model.forest.score(np.array([r for _, r in found])) if model.forest else np.zeros(len(found))
            failed = [base_failed(c) for c, _ in found]
            yield batch_of(out, keys, *map(list, zip(*[c for c, _ in found], strict=True)), failed, anomaly.tolist(), [not f and a < model.threshold for f, a in zip(failed, anomaly.tolist(), strict=True)])

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
