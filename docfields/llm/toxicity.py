"""Toxicity scores from a weighted finite-state grammar over clauses.

Words are mapped to symbols (insult, threat, target, negation, report, other) by a lexicon: seed words, listed below, and
words that labelled rows show to be far more frequent in toxic texts, which count as insults if they are no seeds. A clause's symbols
run through deterministic transducers: first one, from the right, rewrites an insult or threat that stands shortly before a
target ("idiot, you") as directed; then the composition of three more, from the left, rewrites those that stand

* shortly after a target ("you ...") as directed,
* shortly after a negation as negated,
* after a reporting verb in the same clause as reported.

The rewritten symbols and the words' weights give the clause its score; a document's features are logarithms of the sum, the
maximum and the density of its clauses' scores, and a logistic model fitted on labelled rows maps them to 0..1. Only the text
enters a score. Clause positions are characters of the text itself.

Null and empty texts have no clause and get the score of a text without matches. Texts of any length are read whole; ties and
repeated rows score alike; an empty table gives an empty result.
The fit uses at most `max_labelled` labelled rows, chosen by a hash of the id, each distinct text once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, fold, rows_of, rows_where, sampled, table

# Symbols: other, insult, threat, target, negation, report; and what transducers make of insults and threats.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DIRECTED, NEGATED, REPORTED = "oitgnrdxq"

#: Seed words of each symbol.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid pathetic worthless scum trash loser losers clown clowns disgusting imbecile vermin filth",
    THREAT: "kill hurt destroy burn beat murder hang shoot",
    TARGET: "you your yourself u they them these those he she him her",
    NEGATION: "not no never neither nor without isn't aren't don't doesn't didn't won't",
    REPORT: "said says say claimed claims reported reports quoted wrote called alleged according",
}
#: What a rewritten symbol's weight is multiplied by.
FACTOR = {INSULT: 1.0, THREAT: 0.4, DIRECTED: 1.5, NEGATED: 0.5, REPORTED: 0.6}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: A run of marks before white space, looked at from its first mark alone, or a line break. Learning and scoring both cut here.
CLAUSE = r"(?<![.!?;\n])[.!?;\n]+(?:\s|$)|\n"
CLAUSE_END = re.compile(CLAUSE)


class Transducer:
    """Deterministic, one symbol out for each symbol in: (state, symbol) -> (state, symbol); missing arcs copy and stay."""

    def __init__(self, arcs: dict[tuple, tuple], start=0) -> None:
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what self writes, other reads."""
        symbols = {s for _, s in [*self.arcs, *other.arcs]} | {s for _, s in [*self.arcs.values(), *other.arcs.values()]}
        start, arcs, seen = (self.start, other.start), {}, set()
        todo = [start]
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in symbols:
                a, middle = self.step(state[0], symbol)
                b, out = other.step(state[1], middle)
                arcs[state, symbol] = ((a, b), out)
                todo.append((a, b))
        return Transducer(arcs, start)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


def _within(trigger: str, width: int, rewrite: dict[str, str]) -> Transducer:
    """Rewrites symbols that stand at most `width` places after a trigger."""
    symbols = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DIRECTED, NEGATED, REPORTED)
    arcs = {}
    for state in range(width + 1):
        for s in symbols:
            arcs[state, s] = (width, s) if s == trigger else (max(0, state - 1), rewrite.get(s, s) if state else s)
    return Transducer(arcs)


def before_target() -> Transducer:
    """To be run from the right: an insult or threat at most 2 places before a target."""
    return _within(TARGET, 2, {INSULT: DIRECTED, THREAT: DIRECTED})


def grammar() -> Transducer:
    directed = _within(TARGET, 4, {INSULT: DIRECTED, THREAT: DIRECTED})
    negated = _within(NEGATION, 2, {INSULT: NEGATED, THREAT: NEGATED, DIRECTED: NEGATED})
    reported = Transducer({(0, REPORT): (1, REPORT), **{(1, s): (1, REPORTED) for s in (INSULT, THREAT, DIRECTED)}})
    return directed.then(negated).then(reported)


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # insults and threats
    symbols: dict[str, str]

    @staticmethod
    def of(learned: dict[str, float]) -> Lexicon:
        symbols = {w: s for s, words in SEEDS.items() for w in words.split()}
        weights = {w: 1.0 for w, s in symbols.items() if s in (INSULT, THREAT)}
        for w, weight in learned.items():
            if symbols.get(w, INSULT) in (INSULT, THREAT):
                symbols[w], weights[w] = symbols.get(w, INSULT), max(1.0, weight)
        return Lexicon(weights, symbols)


class Scorer:
    """Features of a text: log of 1 + the clauses' sum, 1 + their maximum, and 1 + their sum for 100 words. Reads each text once with an
    automaton of the lexicon; only clauses in which it finds a word are taken apart."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.behind, self.grammar = lexicon, before_target(), grammar()
        self.words = ahocorasick.Automaton()
        for w in lexicon.weights:
            self.words.add_word(w, len(w))
        self.words.make_automaton()

    def score(self, clause: str) -> float:
        words = WORD.findall(clause)
        symbols = [self.lexicon.symbols.get(w, OTHER) for w in words]
        written = self.grammar.run(self.behind.run(symbols[::-1])[::-1])
        return sum(FACTOR[o] * self.lexicon.weights.get(w, 0.0) for w, o in zip(words, written, strict=True) if o in FACTOR)

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(first character, end, score) of each clause with a score."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals have a lower case of two characters
            low = "".join([w if len(w := c.lower()) == 1 else c for c in text])
        hits = [at + 1 - n for at, n in self.words.iter(low)]
        if not hits:
            return []
        out, ends, left = [], CLAUSE_END.finditer(low), 0
        right = next((m.start() for m in ends), len(low))
        for hit in sorted(hits):
            if hit < left:
                continue
            while hit >= right:
                left = right
                right = next((m.start() for m in ends if m.start() > left), len(low))
            score = self.score(low[left:right])
            if score:
                out.append((left, right, score))
            left = right  # one score for each clause
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        scores = [s for _, _, s in self.clauses(text)]
        if not scores:
            return 0.0, 0.0, 0.0
        total = sum(scores)
        return math.log1p(total), math.log1p(max(scores)), math.log1p(100 * total / (1 + text.count(" ")))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    bias: float
    slopes: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + features @ np.array(self.slopes), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Newton steps with a small ridge; slopes stay at 0 or above, so a match never lowers a score."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.full(z.shape[1], 0.05)
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), tuple(float(v) for v in w[1:])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_words: int = 500, least_gain: float = 30.0) -> Model:
    """Lexicon and logistic model from labelled rows. A word is learned if its log-likelihood ratio between clauses of toxic texts and
    others is at least `least_gain` (about one false word in 10 million) and the former have it 8 times as often. What the
    driver gathers is bounded: `max_words` words, and three numbers for each of `max_labelled` rows."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = sampled(marked, id_col, max_labelled, marked.count())
    # `some` has at most 1.2 * max_labelled rows of two numbers.
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(F.broadcast(some), id_col)
    rows = rows.groupBy(F.md5("text").alias("_key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).persist()
    try:
        sizes = {int(r.toxic): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            return Model(Lexicon.of({}), -3.0, (3.0, 1.0, 1.0))
        # A clause counts once, however many copies of a passage hold it, and as toxic only if all texts that hold it are.
        clauses = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), f"(?U){CLAUSE}"))).alias("clause"))
        clauses = clauses.groupBy("clause").agg(F.min("toxic").alias("toxic")).persist()
        sizes = {int(r.toxic): r.n for r in clauses.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        words = clauses.select("toxic", F.explode(F.array_distinct(F.split("clause", r"[^\p{L}']+"))).alias("word")).where("word <> ''")
        counts = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 5")
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        share = (a + b) / (n1 + n0)
        term = lambda k, n: F.when(k > 0, k * F.log(k / (share * n))).otherwise(0.0)
        ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        best = counts.select("word", (2 * (term(a, n1) + term(b, n0))).alias("gain"), ratio.alias("ratio")).where((F.col("gain") >= least_gain) & (F.col("ratio") >= 8)).orderBy(F.desc("gain"), "word").limit(max_words)
        learned = {r.word: min(2.0, math.log(r.ratio) / math.log(30)) for r in best.collect()}
        lexicon = Lexicon.of(learned)
        seen = _features(rows.select("toxic", "text"), lexicon, "toxic").collect()
        clauses.unpersist()
    finally:
        rows.unpersist()
    x, y = np.array([r[1:4] for r in seen], dtype=float), np.array([r[0] for r in seen], dtype=float)
    return Model(lexicon, *_logistic(x, y))


def _features(df: DataFrame, lexicon: Lexicon, label: str) -> DataFrame:
    out = pa.schema([(label, pa.int32()), ("total", pa.float64()), ("most", pa.float64()), ("density", pa.float64())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for keys, texts in rows_of(batches, label, "text"):
            yield batch_of(out, keys, *zip(*map(scorer.features, texts), strict=True))

    return df.mapInArrow(run, f"{label} int, total double, most double, density double")


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted, and the matched clauses as (first character, end, score). No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    clause = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    out = pa.schema([(id_col, id_type), ("score", pa.float64()), ("predicted", pa.int32()), ("clauses", pa.list_(clause))])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for keys, texts in rows_of(batches, "id", "text"):
            found = [scorer.clauses(t) for t in texts]
            features = np.array([scorer.features(t) if f else (0.0, 0.0, 0.0) for t, f in zip(texts, found, strict=True)]).reshape(-1, 3)
            p = model.score(features)
            yield batch_of(out, keys, p.tolist(), (p >= threshold).astype(int).tolist(), [[dict(zip(("start", "end", "score"), c, strict=True)) for c in f] for f in found])

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, clauses array<struct<start:int,end:int,score:double>>")


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df that score doesn't predict as toxic, with all columns, whatever their id."""

    def make():
        scorer = Scorer(model.lexicon)
        return lambda text: bool(model.score(np.array([scorer.features(text)]))[0] < threshold)

    return rows_where(df, text_col, make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))
