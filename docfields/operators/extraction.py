"""A run over a corpus: page analyses and model responses in, validated and located fields of new versions out.

The three inputs are dealt by document once, into tables with the same buckets. From there on no step needs an exchange: boxes
are flattened, responses parsed, versions numbered, texts matched and fields validated and summed up where their document lies. What is
written in between keeps the buckets. A document's pages, fields and boxes are handled by one task, one at a time, so this plan
is for corpora of documents; match_fields alone deals a document's texts out further."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.store import bucketed
from docfields.functions.text import HIGH, MEDIUM
from docfields.functions.validators import validate_fields
from docfields.operators import layout, matching, responses

#: What a plan over bucketed tables needs: joins on the document and something else count as dealt by the document, and a table
#: of many small files still has one task a bucket. Broadcasts would be fine, but hide in small tests what large inputs get.
#: A row of analyses is a page with all its boxes, so few rows are decoded at a time: 4096, Spark's default, take hundreds of MB a task.
SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "128", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.requireAllClusterKeysForDistribution": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def in_document(spark: SparkSession) -> Iterator[None]:
    """The settings, for plans that are made (and run) inside; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def extract(analyses: DataFrame, raw: DataFrame, extractions: DataFrame, buckets: int | None = None, dealt: bool = False) -> dict[str, DataFrame]:
    """analyses as layout.ANALYSIS has them, raw (document_id, response), extractions (document_id, version) that exist. Returns, as
    tables: `fields` of the documents with a good response (document_id, version, sort_order, key, value, type, confidence, key_bbox,
    value_bbox and what validation says), `extractions` (document_id, version, and counts over its fields) and `failures`
    (document_id, error). Documents without an analysis have fields without boxes; of several responses of a document the
    greatest counts. Rows with a null document_id take no part. `dealt` says that analyses come dealt by document_id into `buckets`
    partitions, such as those that are made of something smaller that was dealt; then they aren't dealt again."""
    spark = analyses.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = "document_id"
    known = lambda df: df.where(F.col(key).isNotNull())
    with in_document(spark):
        pages = bucketed(known(analyses).select(key, "page_number", "words", "lines"), "analyses", key, n, exchange=not dealt)  # all that fields are matched with
        once = bucketed(known(raw).groupBy(key).agg(F.max("response").alias("response")), "responses", key, n)
        last = bucketed(known(extractions).groupBy(key).agg(F.max("version").alias("last")), "versions", key, n)

        def keep(df: DataFrame, name: str) -> DataFrame:
            return bucketed(df, name, "extraction_id", n, exchange=False)

        parsed = responses.parse_responses(once)
        failures = parsed.where("NOT success").select(key, "error")
        fields = responses.explode_fields(parsed, key).withColumnRenamed(key, "extraction_id")
        boxes = {kind: layout.flatten_boxes(pages, (kind,)).withColumnRenamed(key, "extraction_id") for kind in ("line", "word")}
        located = validate_fields(matching.match_fields(keep(fields, "fields"), boxes, keep))
        version = (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version")
        numbered = located.withColumnRenamed("extraction_id", key).join(last, key, "left").select("*", version).drop("last")
        done = bucketed(numbered, "located", key, n, exchange=False)
        c = F.col("confidence")
        stats = done.groupBy(key, "version").agg(F.count("*").alias("total_fields"), F.avg(F.coalesce(c, F.lit(0.0))).alias("confidence_avg"), F.count_if(c >= HIGH).alias("high_fields"), F.count_if(c < MEDIUM).alias("low_fields"), F.count_if(~F.col("is_valid")).alias("invalid_fields"), F.count("value_bbox").alias("located_fields"))
    return {"fields": done, "extractions": stats, "failures": failures}
