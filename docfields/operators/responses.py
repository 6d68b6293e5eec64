"""Both sides of a language model's batch run: prompts out, typed fields in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.text import blank

RESPONSE = "form_type string, language string, fields array<struct<field_key:string,field_value:string,field_type:string,confidence:double>>"
DEFAULT_CONFIDENCE = 0.85
#: The field types that stay as they are.
FIELD_TYPES = ("text", "number", "date", "email", "phone", "checkbox", "table", "signature", "address", "name", "currency")
RULE = "=" * 60
#: Fixed text: the shape that a retry asks for.
SHAPE = """
{
    "form_type": "string (e.g., 'Invoice', 'Application Form')",
    "language": "string (e.g., 'en', 'hi')",
    "fields": [
        {
            "field_key": "string (the field label)",
            "field_value": "string (the extracted value)",
            "field_type": "text|number|date|email|phone|address|name|currency|unknown",
            "confidence": 0.0 to 1.0
        }
    ]
}
"""


# Fixed texts: the parts of prompts.
CUSTOM, EXPECTED, TEMPLATE = "Additional Instructions:\n", "Expected fields to look for: ", "Template Instructions:\n"
TEXT = "DOCUMENT TEXT (OCR OUTPUT):"
TASK = ("\nExtract all key-value pairs from the document above.", "Return the results as a JSON object with 'form_type', 'language', and 'fields' array.")
WARNING = "⚠️ IMPORTANT: YOUR PREVIOUS RESPONSE HAD AN ERROR"
AGAIN = "Please correct your response and ensure you return VALID JSON with this EXACT structure:"


def build_prompts(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """docs: document_id, text, custom_prompt, template_name -> prompt. Parts that are null or empty are left out. Templates are
    joined by name; Spark broadcasts them if they are small. An expected field is shown by its `key` or, where that is null or lacks,
    by its `name`."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c, F.lit("\n")))
    rows = docs
    keys, instructions = F.lit(None).cast("string"), F.lit(None).cast("string")
    if templates is not None:
        t = templates.select(F.col("name").alias("template_name"), "expected_fields", "extraction_prompt")
        rows = docs.join(t, "template_name", "left")
        parts = [n for n in ("key", "name") if n in templates.schema["expected_fields"].dataType.elementType.names]
        keys = F.array_join(F.transform("expected_fields", lambda f: F.coalesce(*[f[n] for n in parts], F.lit(""))), ", ")
        instructions = F.col("extraction_prompt")
    prompt = F.concat_ws(
        "\n",
        part(CUSTOM, F.col("custom_prompt")),
        part(EXPECTED, keys),
        part(TEMPLATE, instructions),
        F.lit(RULE),
        F.lit(TEXT),
        F.lit(RULE),
        F.coalesce("text", F.lit("")),
        F.lit(RULE),
        *map(F.lit, TASK),
    )
    return rows.select("document_id", prompt.alias("prompt"))


def build_retry_prompts(failed: DataFrame) -> DataFrame:
    """failed: document_id, error, prompt -> the prompt again behind the error and the wanted shape."""
    head = [F.lit(RULE), F.lit(WARNING), F.lit(RULE), F.concat(F.lit("Error: "), F.coalesce("error", F.lit("None"))), F.lit("")]
    wanted = [F.lit(AGAIN), F.lit(SHAPE), F.lit(RULE), F.lit("")]
    return failed.select("document_id", F.concat_ws("\n", *head, *wanted, F.col("prompt")).alias("prompt"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def parse_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """df with success, error, form_type, language and fields. Errors in this order: empty, invalid JSON, no object, no `fields`."""
    raw = F.col(column)
    once = df.withColumns({"_tree": F.try_parse_json(raw), "_parsed": F.from_json(raw, RESPONSE)})
    tree, parsed, kind = F.col("_tree"), F.col("_parsed"), F.schema_of_variant("_tree")
    has = F.try_variant_get(tree, "$.fields", "variant").isNotNull()
    error = F.when(blank(raw), "Empty response").when(tree.isNull(), "Invalid JSON").when(~kind.startswith("OBJECT"), "Response is not a JSON object").when(~has, "Response missing 'fields' array")
    ok = error.isNull()
    return once.withColumns({"success": ok, "error": error, "form_type": F.when(ok, F.coalesce(parsed["form_type"], F.lit("Unknown"))), "language": F.when(ok, F.coalesce(parsed["language"], F.lit("en"))), "fields": F.when(ok, F.coalesce(parsed["fields"], F.array().cast(parsed_fields_type())))}).drop("_tree", "_parsed")


def parsed_fields_type() -> str:
    return RESPONSE.split("fields ", 1)[1]


def map_field_type(c: Column) -> Column:
    return F.when(F.lower(c).isin(*FIELD_TYPES), F.lower(c)).otherwise("unknown")


def explode_fields(parsed: DataFrame, key: str) -> DataFrame:
    """A row for each field: key `field_{i}`, value empty and confidence 0.85 where they lack; null counts as lacking."""
    f = parsed.where("success").select(key, F.posexplode("fields").alias("sort_order", "f"))
    return f.select(key, "sort_order", F.coalesce("f.field_key", F.concat(F.lit("field_"), F.col("sort_order").cast("string"))).alias("field_key"), F.coalesce("f.field_value", F.lit("")).alias("field_value"), map_field_type(F.coalesce("f.field_type", F.lit("text"))).alias("field_type"), F.coalesce("f.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def mean_confidence(fields: Column) -> Column:
    total = F.aggregate(fields, F.lit(0.0), lambda a, f: a + F.coalesce(f["confidence"], F.lit(DEFAULT_CONFIDENCE)))
    return F.when(fields.isNotNull(), F.when(F.size(fields) > 0, total / F.size(fields)).otherwise(0.0))


def run_outcome(runs: DataFrame) -> DataFrame:
    """runs: document_id, ocr_success, ocr_error, llm_success, llm_error, extraction_id -> status, error and the log rows that
    follow (step, log_status, message)."""
    ocr, llm, saved = F.coalesce("ocr_success", F.lit(False)), F.coalesce("llm_success", F.lit(False)), F.col("extraction_id").isNotNull()
    error = F.when(~ocr, F.concat(F.lit("OCR failed: "), F.coalesce("ocr_error", F.lit("None")))).when(~llm, F.concat(F.lit("Extraction failed: "), F.coalesce("llm_error", F.lit("None")))).when(~saved, "Failed to save extraction to database")
    row = lambda step, status, message: F.struct(F.lit(step).alias("step"), F.lit(status).alias("log_status"), message.alias("message"))
    logs = (
        F.when(~ocr, F.array(row("ocr", "failed", F.coalesce("ocr_error", F.lit("OCR processing failed")))))
        .when(~llm, F.array(row("llm_extraction", "failed", F.coalesce("llm_error", F.lit("LLM extraction failed")))))
        .when(saved, F.array(row("finalization", "completed", F.lit("Extraction saved to database")), row("validation", "started", F.lit("Starting field validation"))))
    )
    return runs.select("document_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), logs.alias("logs"))
