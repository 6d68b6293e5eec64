"""Validation of typed field values as columns: one struct for each rule, dispatched by type in a single `when` chain, so a row
evaluates only its own type's rule. What rules share (stripped text, number of digits) and the finding itself are columns of
projections of their own, so that each is computed once. Register further types by passing another registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.text import HIGH, MEDIUM, confidence_level, strip

# Patterns, date formats in the order tried, and check box values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONES = (r"^\+?1?\s*\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$", r"^\+91[\s-]?[6-9][0-9]{9}$", r"^\+?[\d\s\-\(\)\.]{7,20}$")
DATES = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/M/d")
CURRENCY = r"^[\$\£\€\₹\¥]?\s*[\d,]+\.?\d*$|^[\d,]+\.?\d*\s*[\$\£\€\₹\¥]?$"
NUMBER = r"^-?[\d,]+\.?\d*$"
NAME = r"^[a-zA-Z\s\.\-\']+$"
CHECKBOX = ("yes", "true", "checked", "1", "on", "x", "✓", "✔", "y", "no", "false", "unchecked", "0", "off", "", "n")

@dataclass(frozen=True)
class Value:
    """What a rule sees: the value (null as empty), the same without blanks around it, how many digits that has, the confidence."""

    raw: Column
    text: Column
    digits: Column
    confidence: Column


Rule = Callable[[Value], Column]

# Fixed texts: the messages that rules give.


def _finding(valid: bool, message: str | Column, severity: str = "info", review: bool | Column = False, corrected: Column | None = None) -> Column:
    return F.struct(
        F.lit(valid).alias("is_valid"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(severity).alias("severity"),
        (corrected if corrected is not None else F.lit(None).cast("string")).alias("corrected_value"),
        (F.lit(review) if isinstance(review, bool) else review).alias("needs_review"),
    )


def _number(c: Column) -> Column:
    return c.rlike(NUMBER) & F.replace(c, F.lit(","), F.lit("")).try_cast("double").isNotNull()


def email(v: Value) -> Column:
    low = F.lower(v.text)
    joined = F.replace(low, F.lit(" "), F.lit(""))
    return (
        F.when(v.text == "", _finding(False, "Email field is empty", "error"))
        .when(low.rlike(EMAIL), _finding(True, "Valid email format"))
        .when(low.contains(" ") & joined.rlike(EMAIL), _finding(False, F.concat(F.lit("Email contains spaces - did you mean: "), joined), "warning", corrected=joined))
        .otherwise(_finding(False, "Invalid email format", "error"))
    )


def phone(v: Value) -> Column:
    text, digits = v.text, v.digits
    known = F.lit(False)
    for p in PHONES:
        known = known | text.rlike(p)
    message = F.concat(F.lit("Invalid phone number (found "), digits.cast("string"), F.lit(" digits, expected 7-15)"))
    return (
        F.when(v.text == "", _finding(False, "Phone number is empty", "error"))
        .when(known, _finding(True, "Valid phone format"))
        .when(digits.between(7, 15), _finding(True, "Phone number has valid digit count", review=v.confidence < HIGH))
        .otherwise(_finding(False, message, "error"))
    )


def _parsed(text: Column, fmt: str) -> Column:
    """The date in this format; texts that don't have its outline are not tried, since a failed attempt is costly."""
    outline = re.sub("y+|M+|d+", lambda m: r"\d{4,}" if m[0][0] == "y" else r"\d{1,2}" if len(m[0]) < 3 else r"\p{L}+", fmt)
    return F.when(text.rlike(f"^{outline}$"), F.try_to_date(text, fmt))


def date(v: Value) -> Column:
    text = F.regexp_replace(v.text, r"(?U)\s+", " ")
    iso = F.date_format(F.coalesce(*[_parsed(text, f) for f in DATES]), "yyyy-MM-dd")
    return (
        F.when(v.text == "", _finding(False, "Date field is empty", "error"))
        .when(iso.isNotNull(), _finding(True, F.concat(F.lit("Valid date: "), iso), corrected=F.when(iso != v.text, iso)))
        .when(text.rlike(r"\d+[\/\-\.]\d+[\/\-\.]\d+"), _finding(False, "Date format not recognized - please verify", "warning", True))
        .otherwise(_finding(False, "Invalid date format", "error"))
    )


def number(v: Value) -> Column:
    text = F.regexp_replace(v.text, "[, ]", "")
    share = v.digits / F.greatest(F.length(text), F.lit(1))
    return (
        F.when(v.text == "", _finding(False, "Number field is empty", "error"))
        .when(_number(text), _finding(True, "Valid number"))
        .when(share > 0.8, _finding(False, "Value appears to be a number but has invalid characters", "warning", True))
        .otherwise(_finding(False, "Invalid number format", "error"))
    )


def currency(v: Value) -> Column:
    text = v.text
    amount = F.regexp_replace(text, r"[^\d.,]", "")
    return (
        F.when(v.text == "", _finding(False, "Currency field is empty", "error"))
        .when(text.rlike(CURRENCY), _finding(True, "Valid currency format"))
        .when((amount != "") & F.replace(amount, F.lit(","), F.lit("")).rlike(NUMBER), _finding(True, "Currency value extracted", corrected=amount))
        .otherwise(_finding(False, "Invalid currency format", "error"))
    )


def checkbox(v: Value) -> Column:
    message = F.concat(F.lit("Unrecognized checkbox value: '"), v.raw, F.lit("' (expected yes/no, true/false, etc.)"))
    return F.when(F.lower(v.text).isin(*CHECKBOX), _finding(True, "Valid checkbox value")).otherwise(_finding(False, message, "warning", True))


def name(v: Value) -> Column:
    text = v.text
    return (
        F.when(v.text == "", _finding(False, "Name field is empty", "error"))
        .when(F.length(text) < 2, _finding(False, "Name too short", "error"))
        .when(text.rlike(r"(?U)\d"), _finding(False, "Name contains numbers", "warning", True))
        .when(text.rlike(NAME), _finding(True, "Valid name format"))
        .otherwise(_finding(True, "Name contains special characters - please verify", review=v.confidence < HIGH))
    )


def address(v: Value) -> Column:
    return (
        F.when(v.text == "", _finding(False, "Address field is empty", "error"))
        .when(F.length(v.text) < 10, _finding(False, "Address seems too short", "warning", True))
        .otherwise(_finding(True, "Address format accepted", review=v.confidence < MEDIUM))
    )


def text(v: Value) -> Column:
    return F.when(v.text == "", _finding(True, "Text field is empty", review=v.confidence < HIGH)).otherwise(_finding(True, "Text field accepted", review=v.confidence < MEDIUM))


def signature(v: Value) -> Column:
    return F.when(v.text == "", _finding(False, "Signature not detected", "warning", True)).otherwise(_finding(True, "Signature detected", review=v.confidence < MEDIUM))


def table(v: Value) -> Column:
    return F.when(v.text == "", _finding(False, "Table data is empty", "warning", True)).otherwise(_finding(True, "Table data present", review=True))


def unknown(v: Value) -> Column:
    return _finding(True, "Field type unknown - please review", review=True)


VALIDATORS: Mapping[str, Rule] = {f.__name__: f for f in (email, phone, date, number, currency, checkbox, name, address, text, signature, table, unknown)}


def finding(value: Value, kind: Column, registry: Mapping[str, Rule] = VALIDATORS) -> Column:
    """The rule of the type, `unknown` for types that the registry lacks."""
    found = None
    for t, rule in registry.items():
        if t != "unknown":
            found = (found if found is not None else F).when(kind == t, rule(value))
    rest = registry.get("unknown", unknown)(value)
    return found.otherwise(rest) if found is not None else rest


def validate_fields(fields: DataFrame, registry: Mapping[str, Rule] = VALIDATORS) -> DataFrame:
    """fields with the columns of the finding, and the overlay for low confidence. Null values are empty; null or zero confidence
    counts as 0.85, a null type as text."""
    c = F.col("confidence")
    given = fields.withColumns({"_raw": F.coalesce("field_value", F.lit("")), "_c": F.when(c.isNull() | (c == 0), HIGH).otherwise(c), "_kind": F.lower(F.coalesce("field_type", F.lit("text")))})
    given = given.withColumn("_text", strip(F.col("_raw"))).withColumn("_digits", F.length(F.regexp_replace("_text", r"(?U)\D", "")))
    found = given.withColumn("_f", finding(Value(F.col("_raw"), F.col("_text"), F.col("_digits"), F.col("_c")), F.col("_kind"), registry))
    c, low = F.col("_c"), F.col("_c") < MEDIUM
    return found.select(
        *[F.col(x) for x in fields.columns if x != "is_valid"],
        F.col("_f.is_valid").alias("is_valid"),
        F.when(low, F.concat("_f.message", F.lit(" (low confidence - needs review)"))).otherwise(F.col("_f.message")).alias("message"),
        F.col("_f.severity").alias("severity"),
        F.col("_f.corrected_value").alias("corrected_value"),
        confidence_level(c).alias("confidence_level"),
        (F.col("_f.needs_review") | low).alias("needs_review"),
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    """Counts and the rate of valid fields in percent, for each extraction."""
    return validated.groupBy("extraction_id").agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if("needs_review").alias("reviews"),
        F.bround(F.count_if("is_valid") / F.count("*") * 100, 2).alias("valid_rate"),
    )


def finalization_gate(validated: DataFrame) -> DataFrame:
    """Whether an extraction may be finalised, and the messages that stand against it, in display order."""
    bad = F.sort_array(F.collect_list(F.when(~F.col("is_valid"), F.struct("sort_order", F.concat_ws(": ", "field_key", "message").alias("m")))))
    return validated.groupBy("extraction_id").agg((F.count_if(~F.col("is_valid")) == 0).alias("may_finalise"), F.array_join(F.transform(bad, lambda x: x["m"]), "; ").alias("errors"))


def apply_validation(fields: DataFrame, validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields with verdict and message written back, and a log row for each extraction."""
    marks = validated.select("id", F.col("is_valid").alias("_ok"), F.col("message").alias("validation_message"))
    new = fields.join(marks, "id", "left").withColumn("is_valid", F.coalesce("_ok", "is_valid")).drop("_ok")
    s = validation_summary(validated)
    text_ = F.format_string("Validated %d fields: %d valid, %d invalid, %d need review", "total", "valid", "invalid", "reviews")
    return new, s.select("extraction_id", F.lit("validation").alias("step"), F.lit("completed").alias("status"), text_.alias("message"))
