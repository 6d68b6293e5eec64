"""Flat and nested exports, reports and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.text import HIGH, MEDIUM, percent


def _pct(c: Column) -> Column:
    return F.concat(percent(F.coalesce(c, F.lit(0.0))).cast("string"), F.lit("%"))


def export_frame(documents: DataFrame, extractions: DataFrame, fields: DataFrame, ids: DataFrame | None = None, min_confidence: float | None = None) -> DataFrame:
    """Fields with their extraction and document. `ids` (field ids) and `min_confidence` restrict the fields. Extractions meet their
    documents first: fields are then dealt once, by extraction, as their groups need them."""
    f = fields if ids is None else fields.join(ids.select("id").distinct(), "id", "left_semi")
    if min_confidence is not None:
        f = f.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    e = extractions.select(F.col("id").alias("extraction_id"), "document_id", "version", "is_finalized")
    d = documents.select(F.col("id").alias("document_id"), "original_filename", F.col("form_type").alias("document_form_type"), "language", "page_count")
    columns = ["document_id", "extraction_id", *[c for c in f.columns if c != "extraction_id"], *[c for c in e.columns + d.columns if c not in ("extraction_id", "document_id")]]
    return f.join(e.join(d, "document_id"), "extraction_id").select(*columns)


def to_flat(frame: DataFrame, with_confidence: bool = True, with_document: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV rows: Field Name, Value, Type and, if wanted, Confidence, Is Edited; `with_document` puts the file name first. `columns`, if
    given, says which of all these to show, in which order."""
    edited = F.when(F.coalesce("is_edited", F.lit(False)), "Yes").otherwise("No")
    out = [F.col("field_key").alias("Field Name"), F.coalesce("field_value", F.lit("")).alias("Value"), F.col("field_type").alias("Type")]
    out += [_pct(F.col("confidence")).alias("Confidence"), edited.alias("Is Edited")] if with_confidence else []
    shown = frame.select("extraction_id", "sort_order", *[F.col("original_filename").alias("Document")] * (with_document or columns is not None), *out)
    return shown if columns is None else shown.select("extraction_id", "sort_order", *columns)


def report_rows(frame: DataFrame) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.0))
    status = F.when(c >= HIGH, "Valid").when(c >= MEDIUM, "Review").otherwise("Low Confidence")
    return frame.withColumn("status_text", status)


def to_nested(frame: DataFrame, with_metadata: bool = True, with_confidence: bool = True) -> DataFrame:
    """A row for each extraction: document, extraction, fields in display order. Null parts don't appear in the JSON."""
    c = F.coalesce("confidence", F.lit(0.0))
    parts = [F.col("sort_order"), F.col("field_key").alias("key"), F.col("field_value").alias("value"), F.col("field_type").alias("type")]
    parts += [c.alias("confidence"), percent(c).alias("confidence_percent")] if with_confidence else []
    parts += [F.coalesce("is_edited", F.lit(False)).alias("is_edited"), F.col("page_number").alias("page")]
    names = [n for n in ("key", "value", "type", *(("confidence", "confidence_percent") if with_confidence else ()), "is_edited", "page")]
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*parts))), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    meta = {
        "document": F.struct(F.col("document_id").alias("id"), F.col("original_filename").alias("filename"), F.col("document_form_type").alias("form_type"), "language", "page_count"),
        "extraction": F.struct(F.col("extraction_id").alias("id"), "version"),
    }
    heads = [F.any_value(v).alias(k) for k, v in meta.items()] if with_metadata else []
    return frame.groupBy("extraction_id").agg(*heads, F.count("*").alias("total_fields"), listed.alias("fields"))


def bulk_export(frame: DataFrame, exported_at: str) -> DataFrame:
    """Lines of one JSON export of many extractions: (place 0) the header with format, date, and totals; (place 1) an object for
    each extraction with its file name, form type and fields. Written in the order of place and extraction_id."""
    fields = F.transform(F.sort_array(F.collect_list(F.struct("sort_order", F.struct(F.col("field_key").alias("key"), F.col("field_value").alias("value"), F.col("field_type").alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).alias("f")))), lambda x: x["f"])
    each = frame.groupBy("extraction_id").agg(F.struct(F.any_value("original_filename").alias("filename"), F.any_value("document_form_type").alias("form_type")).alias("document"), fields.alias("fields"))
    lines = each.select(F.lit(1).alias("place"), "extraction_id", F.to_json(F.struct("extraction_id", "document", "fields"), {"ignoreNullFields": "false"}).alias("line"))
    totals = frame.agg(F.count_distinct("extraction_id").alias("total_extractions"), F.count("*").alias("total_fields"))
    head = totals.select(F.lit(0).alias("place"), F.lit(None).cast("long").alias("extraction_id"), F.to_json(F.struct(F.lit("json").alias("format"), F.lit(exported_at).alias("export_date"), "total_extractions", "total_fields")).alias("line"))
    return head.unionByName(lines)


def document_info(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """The 13 label and value rows of each extraction; stats has extraction_id, document_id, version, total_fields, edited_fields,
    confidence_avg, and exported_at as text."""
    d = documents.select(F.col("id").alias("document_id"), "original_filename", "form_type", "language", "page_count", "created_at")
    rows = stats.drop("form_type").join(d, "document_id")
    s = lambda c: F.col(c).cast("string")
    pairs = [("Document ID", s("document_id")), ("Filename", s("original_filename")), ("Form Type", F.coalesce("form_type", F.lit("Unknown"))), ("Language", F.coalesce("language", F.lit("en"))), ("Page Count", s("page_count")), ("Upload Date", F.date_format("created_at", "yyyy-MM-dd HH:mm")), ("", F.lit("")), ("Extraction ID", s("extraction_id")), ("Version", s("version")), ("Total Fields", s("total_fields")), ("Edited Fields", s("edited_fields")), ("Average Confidence", _pct(F.col("confidence_avg"))), ("Export Date", s("exported_at"))]
    return rows.select("extraction_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs])).alias("row_no", "x")).select("extraction_id", "row_no", "x.*")


def export_summary(stats: DataFrame) -> DataFrame:
    """Totals over extractions: their number, fields, and the mean of their mean confidences (null as 0) as `NN%`."""
    return stats.agg(F.count("*").alias("extractions"), F.coalesce(F.sum("total_fields"), F.lit(0)).alias("fields"), _pct(F.avg(F.coalesce("confidence_avg", F.lit(0.0)))).alias("confidence"))


def summary_by_type(frame: DataFrame) -> DataFrame:
    return frame.groupBy("document_form_type", "language").agg(F.count_distinct("extraction_id").alias("extractions"), F.count("*").alias("fields"), F.count_if("is_edited").alias("edited"))


def missing_ids(ids: DataFrame, extractions: DataFrame) -> DataFrame:
    return ids.join(extractions.select("id"), "id", "left_anti")


def write_export(df: DataFrame, path: str, fmt: str = "csv", by: str | None = None) -> None:
    """CSV with a header, or JSON with a line for each row, in a folder for each value of `by` if given."""
    if fmt not in ("csv", "json"):
        raise ValueError("fmt is csv or json")
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
