"""Human edits as merges with an audit trail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_edits(fields: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: id, field_id, new_value, created_at, ... Several edits of a field are taken in the order of (created_at, id).
    Returns the fields with the last value, marked as edited, `original_value` being the value before the first edit ever; and an
    audit row for each edit with the value before and after. Edits of unknown fields leave no trace."""
    base = fields.select(F.col("id").alias("field_id"), F.col("field_value").alias("_base"))
    order = Window.partitionBy("field_id").orderBy("created_at", "id")
    before = F.lag("new_value").over(order)
    first = F.row_number().over(order) == 1
    audit = changes.join(base, "field_id").withColumn("old_value", F.when(first, F.col("_base")).otherwise(before)).drop("_base")
    last = changes.groupBy("field_id").agg(F.max_by("new_value", F.struct("created_at", "id")).alias("_new"))
    joined = fields.join(last.withColumnRenamed("field_id", "id").withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    out = joined.withColumns({"original_value": F.when(hit & ~F.coalesce("is_edited", F.lit(False)), F.col("field_value")).otherwise(F.col("original_value")), "field_value": F.when(hit, F.col("_new")).otherwise(F.col("field_value")), "is_edited": hit | F.coalesce("is_edited", F.lit(False))})
    return out.drop("_new", "_hit"), audit


def bulk_update(fields: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: id, field_id, created_at, field_value, field_type; a value goes through apply_edits, the type is set plainly."""
    values = changes.where(F.col("field_value").isNotNull()).select("id", "field_id", F.col("field_value").alias("new_value"), "created_at")
    out, audit = apply_edits(fields, values)
    types = changes.where(F.col("field_type").isNotNull()).groupBy(F.col("field_id").alias("id")).agg(F.max_by("field_type", F.struct("created_at", "id")).alias("_type"))
    return out.join(types, "id", "left").withColumn("field_type", F.coalesce("_type", "field_type")).drop("_type"), audit


def value_as_of(fields: DataFrame, edits: DataFrame, at: datetime) -> DataFrame:
    """Each field's value at a time: its last edit by then, else its value before any edit."""
    past = edits.where(F.col("created_at") <= F.lit(at)).groupBy(F.col("field_id").alias("id")).agg(F.max_by("new_value", F.struct("created_at", "id")).alias("_v"))
    start = F.when(F.col("is_edited"), F.col("original_value")).otherwise(F.col("field_value"))
    return fields.join(past, "id", "left").select("id", F.coalesce("_v", start).alias("value"))


def roll_back(fields: DataFrame) -> DataFrame:
    e = F.col("is_edited")
    return fields.withColumns({"field_value": F.when(e, F.col("original_value")).otherwise(F.col("field_value")), "is_edited": F.lit(False)})


def edit_history(edits: DataFrame, key: str = "field_id") -> DataFrame:
    return edits.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))))


def guarded(changes: DataFrame, fields: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """changes (id, field_id, extraction_id) with the reason why each may not be applied, null if it may."""
    f = fields.select(F.col("id").alias("field_id"), F.col("extraction_id").alias("_owner"))
    e = extractions.select(F.col("id").alias("extraction_id"), F.col("document_id").alias("_document"), "is_finalized")
    d = documents.select(F.col("id").alias("_document"), "is_deleted")
    joined = changes.join(f, "field_id", "left").join(e, "extraction_id", "left").join(d, "_document", "left")
    reason = (
        F.when(F.col("is_finalized").isNull(), "extraction not found")
        .when(F.coalesce("is_deleted", F.lit(True)), "document not found")
        .when(F.col("is_finalized"), "extraction is finalized")
        .when(~F.col("_owner").eqNullSafe(F.col("extraction_id")), "field of another extraction")
    )
    return joined.select(*changes.columns, reason.alias("reason"))


def edited_fields(fields: DataFrame) -> DataFrame:
    return fields.where("is_edited").orderBy("extraction_id", "sort_order")


def low_confidence(fields: DataFrame, threshold: float = 0.6) -> DataFrame:
    return fields.where(F.col("confidence") < threshold).orderBy("confidence", "id")
