"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled documents. A text, lower-cased and
reduced to letters (Unicode category L) and single spaces, is compressed with each dictionary in chunks of a few kilobytes, whole
text, and the language with the smallest total wins; ties go to the language first in the alphabet. A text is rejected if the
second smallest total is nearer than `margin` of the smallest. Null texts and texts without a letter are `und`, score 0, rejected.
Rows repeated in full, and equal texts, are judged alike; an empty table gives an empty result.

Learning takes about `docs_per_language` distinct texts of a language, chosen by a hash of the text, and of each a passage of
`passage` characters that begins at a place which the hash chooses; so what the driver gathers is bounded by these two
and `max_languages` (the most frequent languages are learned). Rows with a null language teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, fold, rows_of, rows_where, table

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
CHUNK, LEVEL = 4096, 6


def letters(text: str) -> str:
    found = NOT_LETTERS.sub(" ", text)
    if not found.replace(" ", "").isalpha():  # word characters that are neither digits nor letters, such as fractions
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found.strip().lower()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 300, passage: int = 320, max_languages: int = 200) -> dict[str, bytes]:
    """Raw dictionary content of each language. Two passes: counts of each language's distinct texts, then the sample alone."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages).collect()
    if not counts:
        return {}
    grid = 1 << 30
    shares = docs.sparkSession.createDataFrame([(r.lang, int(grid * min(1.0, 1.2 * docs_per_language / r.n))) for r in counts], "lang string, share long")
    at = F.pmod("h", F.greatest(F.lit(1), F.length("text") - passage)).cast("int") + 1
    some = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("h", F.lit("language")), F.lit(grid)) < F.col("share"))
    once = some.groupBy("lang", "h").agg(F.first(F.substr("text", at, F.lit(passage))).alias("passage"))
    chosen = once.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "passage"))), 1, docs_per_language).alias("found")).collect()
    return {r.lang: " ".join(t for t in (letters(p.passage) for p in r.found) if t).encode() or b" " for r in sorted(chosen, key=lambda r: r.lang)}


def compressor(dictionary: bytes):
    import zstandard

    content = zstandard.ZstdCompressionDict(dictionary.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.compressors = [compressor(dictionaries[lang]) for lang in self.languages]

    def sizes(self, text: str) -> np.ndarray | None:
        """Compressed bytes by language, or None for a text without letters."""
        raw = letters(text).encode()
        if not raw:
            return None
        parts = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], dtype=float)

    def classify(self, text: str) -> tuple[str, float, float]:
        """Language, score and margin: the score is the smallest size's weight among all, the margin how far the second is."""
        total = self.sizes(text) if self.languages else None
        if total is None:
            return UNDETERMINED, 0.0, 0.0
        k = int(np.argmin(total))
        weights = np.exp(-40 * (total - total[k]) / total[k])
        second = min((s for i, s in enumerate(total) if i != k), default=2 * total[k])
        return self.languages[k], float(1 / weights.sum()), float((second - total[k]) / total[k])


def _rejected(found: tuple[str, float, float], margin: float) -> bool:
    return found[0] == UNDETERMINED or found[2] < margin


def confident(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = 0.005) -> DataFrame:
    """The rows of df that identify doesn't reject, with all columns, whatever their id."""

    def make():
        classifier = Classifier(dictionaries)
        return lambda text: not _rejected(classifier.classify(text), margin)

    return rows_where(df, text_col, make)


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = 0.005) -> DataFrame:
    """id, lang_pred, score, margin, rejected. No shuffle. Dictionaries have a fixed size for each language."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([(id_col, id_type), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for keys, texts in rows_of(batches, "id", "text"):
            found = [classifier.classify(t) for t in texts]
            yield batch_of(out, keys, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [_rejected(f, margin) for f in found])

    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")
