"""Uploaded files, the domain tables' storage, and the starter templates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions and their MIME types.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "pdf": "application/pdf"}
MAX_MB = 20


def extension(name: Column) -> Column:
    """The lower-cased text behind the last dot of a path's last part, empty without one or if nothing stands before it."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)/*$", 1))


def check_upload(name: Column, size: Column, max_mb: int = MAX_MB) -> Column:
    """struct<ok, message>: the extension's message wins over the size's. A null name has no extension."""
    ext = extension(F.coalesce(name, F.lit("")))
    large = F.format_string(f"File too large (%.1fMB). Maximum: {max_mb}MB", F.bround(size / (1024 * 1024), 1))
    bad = F.concat(F.lit("File type '"), ext, F.lit("' not allowed. Allowed: " + ", ".join(sorted(MIME))))
    message = F.when(~ext.isin(*MIME), bad).when(size > max_mb * 1024 * 1024, large)
    return F.struct(message.isNull().alias("ok"), message.alias("message"))


def mime_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("application/octet-stream"))


def sanitize(name: Column) -> Column:
    """The last part of a path: unsafe characters of its stem become `_`, the stem is cut at 100; `file` stands for an empty one."""
    last = F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1)
    stem = F.substring(F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), r"[^a-zA-Z0-9._-]", "_"), 1, 100)
    return F.concat(F.when(stem == "", "file").otherwise(stem), F.lit("."), extension(name))


def stored_name(name: Column, uploaded_at: Column, row_id: Column, prefix: str = "doc") -> Column:
    """{prefix}_{time}_{8 hex digits}.{extension}; the digits come from the id, so reruns agree."""
    safe = F.substring(F.regexp_replace(F.lit(prefix), r"(?U)[^\p{Alpha}\p{N}_-]", ""), 1, 20)
    return F.concat_ws("_", safe, F.date_format(uploaded_at, "yyyyMMdd_HHmmss"), F.concat(F.substring(F.md5(row_id.cast("string")), 1, 8), F.lit("."), extension(name)))


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[algorithm](content)


def repeated_uploads(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Hashes that several files share, with the first file's id; contents are dropped before the shuffle."""
    return files.select("id", content_hash(F.col("content"), algorithm).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def scan_uploads(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The files of a dated tree (YYYY/MM/file) with contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def read_layouts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def raw_layouts(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Stored analyses as they are: file, raw (VARIANT; null if the text is no JSON). A line is an analysis or a list of them; with
    `whole` a file is. Blank lines are left out."""
    return raw_texts(spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), "value"))


def raw_texts(texts: DataFrame) -> DataFrame:
    """raw_layouts of texts (file, value) from anywhere."""
    raw = texts.where(F.col("value").rlike(r"\S")).select("file", F.try_parse_json("value").alias("raw"))
    pages = F.coalesce(F.try_variant_get("raw", "$", "array<variant>"), F.array("raw"))
    return raw.select("file", F.explode(pages).alias("raw"))


def declared(raw: DataFrame, schema: str, required: tuple[str, ...] = ("document_id", "page_number")) -> tuple[DataFrame, DataFrame]:
    """Analyses with the declared columns, and those set aside: file, reason, raw. A declared path that is there must have its type,
    and the required ones must be there; paths that aren't declared are left alone."""
    kinds = {f.name: f.dataType.simpleString() for f in raw.sparkSession.createDataFrame([], schema).schema}
    # All paths are taken in one go; whether one that gave nothing was there is looked up only then.
    struct = f"struct<{','.join(f'{n}:{t}' for n, t in kinds.items())}>"
    whole = raw.select("file", "raw", F.explode(F.array(F.try_variant_get("raw", "$", struct))).alias("whole"))
    at = {n: F.try_variant_get("raw", f"$.{n}", "variant") for n in kinds}
    value = F.struct(*[F.col("whole")[n].alias(n) for n in kinds]).alias("value")
    there = F.struct(*[F.when(F.col("whole")[n].isNotNull(), True).otherwise(v.isNotNull() & ~F.is_variant_null(v)).alias(n) for n, v in at.items()]).alias("there")
    # Exploded, so that values are taken once, not once more by each filter on the reason.
    found = whole.select("file", "raw", F.explode(F.array(F.struct(value, there))).alias("x")).select("file", "raw", "x.value.*", F.col("x.there").alias("there"))
    there = {n: F.col("there")[n] for n in kinds}
    faults = [F.when(there[n] & F.col(n).isNull(), f"{n} is no {'list' if t.startswith('array') else t}") for n, t in kinds.items()]
    absent = [F.when(~there[n], f"no {n}") for n in required]
    judged = found.withColumn("reason", F.when(F.col("raw").isNull(), "no JSON").otherwise(F.coalesce(*absent, *faults)))
    return judged.where("reason IS NULL").select(*kinds), judged.where("reason IS NOT NULL").select("file", "reason", "raw")


def _ts(day: date) -> str:
    return f"{{ts '{day} 00:00:00'}}"


def balanced_days(spark: SparkSession, url: str, table: str, parts: int, column: str = "created_at", properties: dict[str, str] | None = None) -> list[date]:
    """Days that cut a table into about `parts` ranges of equal numbers of rows: the database counts the rows of each day, so what
    comes back is bounded by the days of its history."""
    counted = f"(SELECT CAST({column} AS DATE) AS d, COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY CAST({column} AS DATE)) counted"
    days = sorted(tuple(r) for r in spark.read.jdbc(url, counted, properties=properties or {}).collect())
    total, seen, cuts = sum(n for _, n in days), 0, []
    for day, n in days:
        if cuts and seen * parts >= len(cuts) * total or not cuts:
            cuts.append(day)
        seen += n
    return [*cuts, days[-1][0] + timedelta(days=1)] if days else []


def read_jdbc(spark: SparkSession, url: str, table: str, first: date | None = None, last: date | None = None, days: int = 30, column: str = "created_at", properties: dict[str, str] | None = None, edges: list[date] | None = None) -> DataFrame:
    """A table in ranges of a time column, a task for each: `edges`, such as balanced_days gives, or steps of `days` from first to last.
    Rows outside them and without a time have a range of their own."""
    if edges is None:
        edges = [first + timedelta(days=k) for k in range(0, max(1, (last - first).days), days)] + [last]
    ranges = [f"{column} >= {_ts(a)} AND {column} < {_ts(b)}" for a, b in zip(edges, edges[1:], strict=False)]
    rest = f"{column} < {_ts(edges[0])} OR {column} >= {_ts(edges[-1])} OR {column} IS NULL" if edges else "1 = 1"
    return spark.read.jdbc(url, table, predicates=[*ranges, rest], properties=properties or {})


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})


def load_jdbc(df: DataFrame, url: str, table: str, key: str, properties: dict[str, str] | None = None) -> None:
    """Adds the rows whose key the table lacks, once, whatever tasks or whole loads are tried again: tasks fill a staging table, then
    one statement of the database moves its distinct rows. Rows of one key should be equal; columns must be comparable there (no
    large objects: name their types in the property createTableColumnTypes)."""
    staging, properties = f"{table}_load", properties or {}
    df.write.jdbc(url, staging, mode="overwrite", properties=properties)
    names = ", ".join(f's."{c}"' for c in df.columns)
    plain = ", ".join(f'"{c}"' for c in df.columns)
    jvm = df.sparkSession.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    link = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        link.setAutoCommit(False)
        link.createStatement().executeUpdate(f'INSERT INTO {table} ({plain}) SELECT DISTINCT {names} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t."{key}" = s."{key}")')
        link.createStatement().executeUpdate(f"DROP TABLE {staging}")
        link.commit()
    finally:
        link.rollback()
        link.close()


def starter_templates(spark: SparkSession) -> DataFrame:
    """Three templates."""
    rows = [
        ("General Form", "Generic form extraction template", [("Name", "name", False), ("Date", "date", False), ("Email", "email", False), ("Phone", "phone", False)]),
        ("Invoice", "Invoice and billing document template", [("Invoice Number", "text", False), ("Date", "date", False), ("Total Amount", "currency", False), ("Vendor Name", "name", False)]),
        ("Application Form", "Job or general application template", [("Full Name", "name", False), ("Email", "email", False), ("Phone", "phone", False), ("Address", "address", False), ("Date of Birth", "date", False)]),
    ]
    schema = "name string, description string, expected_fields array<struct<key:string,type:string,required:boolean>>"
    return spark.createDataFrame(rows, schema).withColumns({"extraction_prompt": F.lit(None).cast("string"), "sample_document_id": F.lit(None).cast("long"), "is_active": F.lit(True), "usage_count": F.lit(0).cast("long")})
