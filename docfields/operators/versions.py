"""Versions, soft deletes and status changes: a snapshot and a change set give a new snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_versions(extractions: DataFrame, new: DataFrame) -> DataFrame:
    """Extractions with the new rows (id, document_id, created_at, ...) as their documents' next versions, in the order of arrival;
    only a document's last version is current. New rows of one document are numbered together; one writer for each batch."""
    last = extractions.groupBy("document_id").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("document_id").orderBy("created_at", "id")
    numbered = new.join(last, "document_id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("_last")
    both = extractions.drop("is_current").unionByName(numbered.drop("is_current"), allowMissingColumns=True)
    top = both.groupBy("document_id").agg(F.max("version").alias("_top"))
    return both.join(top, "document_id").withColumn("is_current", F.col("version") == F.col("_top")).drop("_top")


def current_versions(extractions: DataFrame) -> DataFrame:
    return extractions.where("is_current")


def version_history(extractions: DataFrame) -> DataFrame:
    """Every version with its place, newest first."""
    return extractions.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version"))))


def version_faults(extractions: DataFrame) -> DataFrame:
    """Documents that break a rule: a version number used twice, or not exactly one current version."""
    twice = extractions.groupBy("document_id", "version").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.max("n").alias("most"))
    current = extractions.groupBy("document_id").agg(F.count_if("is_current").alias("current"))
    return twice.join(current, "document_id").where("most > 1 or current <> 1")


def soft_delete(documents: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    out = documents.join(marked, "id", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return out.withColumns({"is_deleted": F.col("is_deleted") | gone, "deleted_at": F.when(gone & ~F.col("is_deleted"), F.lit(now))}).drop("_gone")


def apply_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, new_status, new_form_type, new_language; form type and language change only if given and not empty."""
    out = documents.join(changes.select("id", "new_status", "new_form_type", "new_language"), "id", "left")
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return out.withColumns({"status": F.coalesce("new_status", "status"), "form_type": F.coalesce(given("new_form_type"), "form_type"), "language": F.coalesce(given("new_language"), "language")}).drop("new_status", "new_form_type", "new_language")


def finalize(extractions: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_final", F.lit(True))
    final = F.coalesce("_final", F.lit(False))
    return extractions.join(marked, "id", "left").withColumns({"finalized_at": F.when(final, F.lit(now)).otherwise(F.col("finalized_at")), "is_finalized": F.col("is_finalized") | final, "status": F.when(final, "completed").otherwise(F.col("status"))}).drop("_final")


def count_usage(templates: DataFrame, uses: DataFrame) -> DataFrame:
    """uses: a row (template_name) for each use."""
    n = uses.groupBy(F.col("template_name").alias("name")).agg(F.count("*").alias("_n"))
    return templates.join(n, "name", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def append_logs(logs: DataFrame, new: DataFrame) -> DataFrame:
    return logs.unionByName(new, allowMissingColumns=True)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Removes documents (ids in `deleted`) with their extractions, fields, edits and logs; templates lose their sample document.
    Null keys stay: they belong to no parent."""
    ids = deleted.select("id").distinct()
    out = dict(tables)
    out["documents"] = tables["documents"].join(ids, "id", "left_anti")
    gone = tables["extractions"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("extraction_id"))
    out["extractions"] = tables["extractions"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    for t in ("fields", "edits"):
        if t in tables:
            out[t] = tables[t].join(gone, "extraction_id", "left_anti")
    if "logs" in tables:
        out["logs"] = tables["logs"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    if "templates" in tables:
        lost = ids.select(F.col("id").alias("sample_document_id"), F.lit(True).alias("_lost"))
        out["templates"] = tables["templates"].join(lost, "sample_document_id", "left").withColumn("sample_document_id", F.when(F.col("_lost").isNull(), F.col("sample_document_id"))).drop("_lost")
    return out
