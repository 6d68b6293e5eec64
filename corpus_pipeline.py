"""From raw documents to packed sequences: language ID, toxicity, near-duplicate removal, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame that is written
and read again. All but the last keep the columns of documents. Nulls: a document with null text has no language and goes
in the first stage. The first two stages judge each row by its text, whatever its doc_id; rows with a null doc_id are no copies
of others to near_dedup, which keeps them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import language_id, near_dedup, packing, toxicity
from docfields.llm.common import fold, materialise, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is in doubt, or that have no letter."""
    return language_id.confident(docs, language_id.learn(docs.where(fold("doc_id", 3) != 1)))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity grammar predicts as toxic."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return toxicity.without_toxic(docs, toxicity.learn(docs.where(fold("doc_id", 4) != 2), labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class, once: of rows that share this id, the last in the order of text,
    then of the other columns (nulls first). Rows are reduced by id before they are dealt out, so no task gets all of an id. Rows with a null id stay."""
    keep = near_dedup.classes(docs).where("doc_id = class_id").select("doc_id")
    row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    once = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(row).alias("_row"))
    kept = once.join(keep, "doc_id", "left_semi").select(*[F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])
    return kept.union(docs.where("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [("language_id", by_language), ("toxicity", without_toxic), ("near_dedup", without_near_copies), ("packing", packed)]

#: Language models, learned lexicons, signatures and tokenizers can't be said in SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
