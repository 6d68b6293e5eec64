"""Lookups, listings and joins over documents, extractions and fields."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def page(df: DataFrame, order_by: str = "created_at", descending: bool = True, skip: int = 0, limit: int = 100, tie: str = "id") -> DataFrame:
    """A page in the order of a column (created_at if there is none of that name); Spark keeps skip + limit rows a partition."""
    key = order_by if order_by in df.columns else "created_at"
    return df.orderBy(F.desc(key) if descending else F.asc(key), F.col(tie)).offset(skip).limit(limit)


def active(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("is_deleted"))


def by_status(documents: DataFrame, status: str, limit: int | None = 100) -> DataFrame:
    """The newest documents of a status; all of them if limit is None."""
    found = active(documents).where(F.col("status") == status)
    return found if limit is None else page(found, limit=limit)


def search(documents: DataFrame, query: str | None = None, status: str | None = None, form_type: str | None = None, date_from: datetime | None = None, date_to: datetime | None = None) -> DataFrame:
    """Documents whose name or form type holds the text in any case (`%` and `_` are wild cards), with equal status and form type
    and created in the range, as far as these are given."""
    out = active(documents)
    if query is not None:
        like = f"%{query}%"
        out = out.where(F.col("filename").ilike(like) | F.col("original_filename").ilike(like) | F.coalesce(F.col("form_type").ilike(like), F.lit(False)))
    for column, value in (("status", status), ("form_type", form_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if date_from is not None:
        out = out.where(F.col("created_at") >= F.lit(date_from))
    return out if date_to is None else out.where(F.col("created_at") <= F.lit(date_to))


def response_defaults(fields: DataFrame) -> DataFrame:
    return fields.withColumns({"field_type": F.coalesce("field_type", F.lit("text")), "confidence": F.coalesce("confidence", F.lit(0.0)), "is_valid": F.coalesce("is_valid", F.lit(True)), "is_edited": F.coalesce("is_edited", F.lit(False)), "page_number": F.coalesce("page_number", F.lit(1))})


def with_extractions(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """A row for each document and extraction; documents without any once."""
    e = extractions.select(F.col("document_id").alias("id"), F.col("id").alias("extraction_id"), "version", F.col("status").alias("extraction_status"))
    return documents.join(e, "id", "left")


def with_fields(extractions: DataFrame, fields: DataFrame) -> DataFrame:
    f = fields.select(F.col("extraction_id").alias("id"), F.col("id").alias("field_id"), "field_key", "field_value", "sort_order")
    return extractions.join(f, "id", "left")


def document_detail(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    s = extractions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_extractions"), F.max(F.when(F.col("is_current"), F.col("id"))).alias("current_extraction_id"))
    return active(documents).join(s, "id", "left").withColumn("n_extractions", F.coalesce("n_extractions", F.lit(0)))


def finalized(extractions: DataFrame, documents: DataFrame, skip: int = 0, limit: int | None = 100) -> DataFrame:
    """Finalised extractions with their document's file name, a page of the last finalised; all of them if limit is None."""
    done = extractions.where("is_finalized")
    if limit is not None:
        done = page(done, "finalized_at", skip=skip, limit=limit)
    d = documents.select(F.col("id").alias("document_id"), "original_filename")
    return done.join(d, "document_id").orderBy(F.desc("finalized_at"), "id")


def recent_edits(edits: DataFrame, fields: DataFrame, k: int = 50) -> DataFrame:
    """The newest k edits with their fields; k rows are cheap to broadcast."""
    newest = edits.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
    f = fields.select(F.col("id").alias("field_id"), "field_value")
    return f.join(F.broadcast(newest), "field_id", "right")


def active_templates(templates: DataFrame) -> DataFrame:
    return templates.where("is_active").orderBy(F.desc("usage_count"), "name")


def money(c: Column, symbol: str = "$") -> Column:
    return F.concat(F.lit(symbol), F.format_number(c, 2))


def shown_date(c: Column) -> Column:
    """Texts that are dates as `dd MMM yyyy`; others as they are."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "dd MMM yyyy"), c)


def in_display_order(fields: DataFrame) -> DataFrame:
    """Each extraction's fields as they are shown; ties by id."""
    return fields.orderBy("extraction_id", "sort_order", "id")


def document_log(logs: DataFrame, document_id: int | None = None) -> DataFrame:
    """Log rows with their place in their document, oldest first; of one document if its id is given."""
    rows = logs if document_id is None else logs.where(F.col("document_id") == document_id)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id")))
