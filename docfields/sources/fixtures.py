"""The domain tables, derived from the driver's tables. Each is one SELECT that Spark and the checking engine both read, so the
two sides of a check start from the same rows; only what differs between the engines is filled in by a dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docfields.functions.ship import ship

NOW = "2024-03-01 12:00:00"
SPARK = {"days": "make_interval(0, 0, 0, CAST({} AS INT))", "json_k": "get_json_object(props, '$.k')", "lpad": "date_format(l_shipdate, '{}')", "iso": "yyyy-MM-dd", "dmy": "dd/MM/yyyy", "tab": "concat(chr(9), chr(10))"}
DUCK = {"days": "to_days(CAST({} AS INTEGER))", "json_k": "json_extract_string(props, '$.k')", "lpad": "strftime(l_shipdate, '{}')", "iso": "%Y-%m-%d", "dmy": "%d/%m/%Y", "tab": "concat(chr(9), chr(10))"}
#: The field types in the order of their numbers.
TYPES = ("email", "phone", "date", "number", "currency", "checkbox", "name", "address", "text", "signature", "table", "unknown")
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


def _values(d: dict) -> str:
    iso, dmy = (d["lpad"].format(d[k]) for k in ("iso", "dmy"))
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = {
        "email": (q("user7@example.com"), q("user 7@example.com"), q("not-an-email"), "''"),
        "phone": (q("+91 9876543210"), q("(555) 123-4567"), q("ext 12345678"), q("12")),
        "date": (iso, dmy, q("99/99/2024"), q("unknown")),
        "number": (q("1,234"), q("-12.5"), q("12a45678901"), q("abc")),
        "currency": (q("$1,234.50"), q("1234₹"), q("USD 99"), q("free")),
        "checkbox": (q("Yes"), q("✓"), q("maybe"), "''"),
        "name": (q("John Smith"), q("J"), q("R2D2"), q("José Núñez")),
        "address": (q("12 Main Street"), q("short"), "''", q("4 Elm Road, Leeds")),
        "text": (q("some text"), "''", d["tab"], q("x")),
        "signature": (q("signed"), "''", q("J. S."), q("   ")),
        "table": (q("a;b;c"), "''", q("1"), q("x;y")),
        "unknown": (q("?"), "''", q("abc"), q("1")),
    }
    cases = []
    for k, t in enumerate(TYPES):
        inner = " ".join(f"WHEN {v} THEN {x}" for v, x in enumerate(table[t]))
        cases.append(f"WHEN {k} THEN CASE CAST(floor(l_quantity) AS INT) % 4 {inner} END")
    return "CASE CAST(l_partkey % 12 AS INT) " + " ".join(cases) + " END"


def sql(name: str, d: dict) -> str:
    """The SELECT of a domain table; names of driver tables stand in braces."""
    days = d["days"].format
    types = "CASE CAST(l_partkey % 12 AS INT) " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
    k = f"CAST({d['json_k']} AS INT)"
    return {
        "documents": f"""SELECT c_custkey AS id, concat(c_name, '.pdf') AS original_filename, concat('doc_', CAST(c_custkey AS STRING), '.pdf') AS filename,
            CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS form_type,
            CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'uploading' WHEN 2 THEN 'processing' WHEN 3 THEN 'completed' ELSE 'failed' END AS status,
            TIMESTAMP '2024-01-01 00:00:00' + {days('c_custkey % 61')} AS created_at, c_custkey % 13 = 0 AS is_deleted,
            1 + CAST(c_custkey % 4 AS INT) AS page_count, CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS file_size_bytes, 'en' AS language FROM {{customer}}""",
        "extractions": f"""SELECT o_orderkey AS id, o_custkey AS document_id, o_orderdate AS created_at,
            CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current,
            CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status, o_orderpriority AS form_type,
            CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS processing_time_ms,
            CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 200) AS BIGINT) END AS ocr_time_ms,
            CAST(floor(o_totalprice / 400) AS BIGINT) AS llm_time_ms, o_orderpriority = '1-URGENT' AS is_finalized,
            CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS confidence_avg,
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + {days('1')} END AS finalized_at FROM {{orders}}""",
        "fields": f"""SELECT l_orderkey * 1000 + sort_order AS id, l_orderkey AS extraction_id, CAST(sort_order AS INT) AS sort_order,
            concat('key_', CAST(l_partkey % 12 AS STRING)) AS field_key, {_values(d)} AS field_value, {types} AS field_type,
            CASE WHEN l_linenumber = 7 THEN NULL ELSE (100 - 5 * floor(l_discount * 100 + 0.5)) / CAST(100 AS DOUBLE) END AS confidence,
            l_returnflag = 'R' AS is_edited, 1 + CAST(l_suppkey % 3 AS INT) AS page_number, l_linestatus = 'O' AS is_valid
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS sort_order FROM {{lineitem}}) AS numbered""",
        "edits": f"""SELECT event_id AS id, user_id AS field_id, user_id % 50 AS extraction_id, CAST({k} AS STRING) AS new_value, ts AS created_at,
            CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'suggestion_accepted' WHEN 'purchase' THEN 'auto_correction' ELSE 'validation_fix' END AS edit_type FROM {{events}}""",
        "edited_fields": """SELECT DISTINCT user_id AS id, user_id % 50 AS extraction_id, '0' AS field_value, user_id % 2 = 1 AS is_edited,
            CASE WHEN user_id % 2 = 1 THEN 'orig' END AS original_value FROM {events}""",
        "logs": f"""SELECT event_id AS id, user_id AS document_id, CASE WHEN {k} % 10 = 0 THEN NULL ELSE event_id END AS extraction_id,
            CASE event_type WHEN 'click' THEN 'upload' WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'llm_extraction' WHEN 'purchase' THEN 'validation' ELSE 'finalization' END AS step,
            CASE WHEN {k} < 50 THEN 'completed' WHEN {k} < 70 THEN 'started' WHEN {k} < 85 THEN 'failed' ELSE 'skipped' END AS status,
            CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts AS created_at FROM {{events}}""",
        "pages": """SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS markdown,
            turn % 7 <> 6 AS success, 100 + turn AS processing_time_ms FROM {conversations}""",
        "files": """SELECT page_id AS id, concat('page_', CAST(page_id AS STRING), CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.exe' ELSE '' END) AS filename,
            CAST(length(html) AS BIGINT) * CASE WHEN page_id % 3 = 0 THEN 10000 ELSE 1 END AS size, html FROM {pages}""",
    }[name]


SOURCE = {"documents": "customer", "extractions": "orders", "fields": "lineitem", "edits": "events", "edited_fields": "events", "logs": "events", "pages": "conversations", "files": "pages"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    source = SOURCE[name]
    return spark.sql(sql(name, SPARK), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def duck(name: str) -> str:
    """The same table as a subquery for the checking engine."""
    return "(" + sql(name, DUCK).replace("{" + SOURCE[name] + "}", SOURCE[name]) + ")"
