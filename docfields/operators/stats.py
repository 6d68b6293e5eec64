"""Dashboard and report aggregates: one conditional aggregate for each table, no matter how many figures are asked for."""

from __future__ import annotations

from datetime import datetime, timedelta

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.text import HIGH, MEDIUM

PERIODS = {"week": 7, "month": 30, "year": 365}


def period_bounds(period: str, now: datetime) -> tuple[datetime, datetime]:
    """today: since midnight (UTC); week, month, year: the last 7, 30, 365 days; anything else is today."""
    days = PERIODS.get(period)
    return (now - timedelta(days=days) if days else now.replace(hour=0, minute=0, second=0, microsecond=0)), now


def _counted(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def document_status_counts(documents: DataFrame) -> DataFrame:
    return _counted(documents.where(~F.col("is_deleted")), "status")


def top_form_types(documents: DataFrame, k: int = 10) -> DataFrame:
    return _counted(documents.where(~F.col("is_deleted") & F.col("form_type").isNotNull()), "form_type").orderBy(F.desc("n"), "form_type").limit(k)


def _since(t: datetime) -> Column:
    return F.col("created_at") >= F.lit(t)


def dashboard_documents(documents: DataFrame, period: str, now: datetime) -> DataFrame:
    start, _ = period_bounds(period, now)
    today, _ = period_bounds("today", now)
    return documents.where(~F.col("is_deleted")).agg(F.count("*").alias("total"), F.count_if(_since(start)).alias("in_period"), F.count_if(_since(today)).alias("today"))


def dashboard_extractions(extractions: DataFrame, current_only: bool = False) -> DataFrame:
    rows = extractions.where("is_current") if current_only else extractions
    done = F.col("status") == "completed"
    total, completed = F.count("*"), F.count_if(done)
    return rows.agg(
        total.alias("total"),
        completed.alias("completed"),
        F.count_if("is_finalized").alias("finalized"),
        F.when(total > 0, completed / total * 100).otherwise(0.0).alias("success_rate"),
        F.coalesce(F.avg(F.when(done, F.col("confidence_avg"))) * 100, F.lit(0.0)).alias("confidence_pct"),
        F.avg("processing_time_ms").alias("avg_total_ms"),
        F.avg("ocr_time_ms").alias("avg_ocr_ms"),
        F.avg("llm_time_ms").alias("avg_llm_ms"),
    )


def dashboard_fields(fields: DataFrame) -> DataFrame:
    edited = F.count_if("is_edited")
    return fields.agg(F.count("*").alias("total"), edited.alias("edited"), (edited / F.greatest(F.count("*"), F.lit(1)) * 100).alias("edit_rate"))


def document_stats(documents: DataFrame, extractions: DataFrame, now: datetime) -> DataFrame:
    today, _ = period_bounds("today", now)
    week, _ = period_bounds("week", now)
    one = documents.where(~F.col("is_deleted")).agg(F.count("*").alias("total"), F.count_if(_since(today)).alias("today"), F.count_if(_since(week)).alias("last_week"), F.sum("page_count").alias("pages"))
    return one.crossJoin(extractions.agg(F.avg("processing_time_ms").alias("avg_ms")))  # two single rows


def extraction_stats(extractions: DataFrame, fields: DataFrame) -> DataFrame:
    c = F.col("confidence_avg")
    one = extractions.agg(F.count("*").alias("total"), F.count_if("is_finalized").alias("finalized"), F.count_if(c >= HIGH).alias("high"), F.count_if((c >= MEDIUM) & (c < HIGH)).alias("medium"), F.count_if(c < MEDIUM).alias("low"), F.avg(c).alias("avg_confidence"))
    per = fields.agg((F.count("*") / F.greatest(F.count_distinct("extraction_id"), F.lit(1))).alias("fields_per_extraction"))
    return one.crossJoin(per)  # two single rows


def extraction_status_counts(extractions: DataFrame) -> DataFrame:
    return _counted(extractions.withColumn("status", F.coalesce("status", F.lit("unknown"))), "status")


def processing_times(extractions: DataFrame) -> DataFrame:
    t = F.col("processing_time_ms")
    return extractions.where(t.isNotNull()).agg(F.avg(t).alias("avg_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"), F.avg("ocr_time_ms").alias("avg_ocr_ms"), F.avg("llm_time_ms").alias("avg_llm_ms"))


def step_status(logs: DataFrame) -> DataFrame:
    return logs.groupBy("step", "status").agg(F.count("*").alias("n"))


def step_status_pivot(logs: DataFrame, statuses: tuple[str, ...] = ("started", "in_progress", "completed", "failed", "skipped")) -> DataFrame:
    return logs.groupBy("step").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def recent_failures(logs: DataFrame, n: int = 50, show: int = 10) -> DataFrame:
    """The newest `show` failed steps, and how many of the newest n there are."""
    newest = logs.where("status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.orderBy(F.desc("created_at"), F.desc("id")).limit(show).crossJoin(newest.agg(F.count("*").alias("n_failures")))


def system_overview(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    s = F.col("status")
    one = documents.where(~F.col("is_deleted")).agg(F.count("*").alias("documents"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "processing").alias("processing"), F.count_if(s == "failed").alias("failed"))
    return one.crossJoin(extractions.agg(F.count("*").alias("extractions")))


def extraction_field_stats(extractions: DataFrame, fields: DataFrame) -> DataFrame:
    """Field count, edited count, mean confidence (null as 0, no fields 0), high and low counts, for every extraction."""
    c = F.col("confidence")
    s = fields.groupBy("extraction_id").agg(F.count("*").alias("total_fields"), F.count_if("is_edited").alias("edited_fields"), F.avg(F.coalesce(c, F.lit(0.0))).alias("confidence_avg"), F.count_if(c >= HIGH).alias("high_fields"), F.count_if(c < MEDIUM).alias("low_fields"))
    return extractions.select(F.col("id").alias("extraction_id"), "document_id", "form_type").join(s, "extraction_id", "left").fillna({"total_fields": 0, "edited_fields": 0, "confidence_avg": 0.0, "high_fields": 0, "low_fields": 0})


def form_type_summary(extractions: DataFrame, fields: DataFrame) -> DataFrame:
    """Per form type: extractions, fields, edited fields, mean of the extractions' mean confidence."""
    s = extraction_field_stats(extractions, fields)
    return s.groupBy("form_type").agg(F.count("*").alias("extractions"), F.sum("total_fields").alias("fields"), F.sum("edited_fields").alias("edited"), F.sum("high_fields").alias("high"), F.sum("low_fields").alias("low"), F.avg("confidence_avg").alias("confidence"))


def page_info(total: Column, page: Column, size: Column) -> Column:
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("long")
    return F.struct(pages.alias("pages"), (page < pages).alias("has_next"), (page > 1).alias("has_previous"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
