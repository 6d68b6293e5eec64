"""Merkle fixity audit of WARC replicas.

Records are laid out one after another in the order of their keys inside files of bounded size, each with its header block and
payload. Leaves are the records' SHA-256; a node of level 1 hashes the leaves whose offsets fall into one range of bytes of
the file, in the order of their offsets, and a node of level l + 1 the nodes of level l in a range `fanout` times as long, up
to one root for each file. Two replicas are compared from their roots down: a level's nodes are looked at only below nodes
that differ, so intact branches are never opened, and what is left at the end are the records that differ:

* corrupt: at the same offset with another content;
* missing: only in the first replica; extra: only in the second (a record whose length changed moves all that follow in its
  file: these are missing at their offsets and extra at others, with equal digests, and are reported as `moved`).

Null keys: such records are sorted first and named "". Null payloads count as empty, and so do null urls. Rows repeated in
full are records of their own, in any order. Records are never gathered: a group holds the hashes below one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.llm.common import materialise, table

#: Bytes in one range of level 1; ranges of a level above are FANOUT times as long.
RANGE, FANOUT, LEVELS = 65_536, 8, 3
FILE_BYTES = 8 << 20


def record(url: Column, key: Column, payload: Column) -> Column:
    """One WARC resource record."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, files: int) -> DataFrame:
    """records (key, data string) -> (file, key, start, length, digest): the layout of one replica. Files take records by a hash
    of the key, so a file's size has a bound if `files` follows the bytes; offsets are running sums inside a file. Only
    digests and lengths are shuffled."""
    slim = records.select("key", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"), F.pmod(F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), F.lit(files)).cast("int").alias("file"))
    order = Window.partitionBy("file").orderBy("key", "digest")
    return slim.withColumn("start", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def _node(level: int) -> Column:
    return F.floor(F.col("start") / (RANGE * FANOUT**level)).cast("long")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels 1 to LEVELS and the root: (file, node, hash) each, written, so that every comparison's plan is short."""
    joined = lambda a, b: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a, b))), lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), ","), 256)
    out = [materialise(leaf.groupBy("file", _node(0).alias("node")).agg(joined("start", "digest").alias("hash")), "level0")]
    for _ in range(1, LEVELS):
        below = out[-1].select("file", F.col("node").alias("child"), F.floor(F.col("node") / FANOUT).cast("long").alias("node"), "hash")
        out.append(materialise(below.groupBy("file", "node").agg(joined("child", "hash").alias("hash")), f"level{len(out)}"))
    root = out[-1].select("file", F.col("node").alias("child"), F.lit(0).cast("long").alias("node"), "hash")
    return [*out, materialise(root.groupBy("file", "node").agg(joined("child", "hash").alias("hash")), "root")]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """The records that differ between two replicas given as leaves: file, start, key, length, expected, found, finding."""
    a, b = tree(first), tree(second)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), ["file", "node"], "full")
        return materialise(both.where(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select("file", "node"), "differing")

    def below(level: DataFrame, bad: DataFrame, parent: Column) -> DataFrame:
        return level.withColumn("parent", parent).join(bad.withColumnRenamed("node", "parent"), ["file", "parent"], "left_semi").drop("parent")

    bad = differing(a[-1], b[-1])
    for k in range(LEVELS - 1, -1, -1):
        parent = F.lit(0).cast("long") if k == LEVELS - 1 else F.floor(F.col("node") / FANOUT).cast("long")
        bad = differing(below(a[k], bad, parent), below(b[k], bad, parent))
    in_bad = [x.withColumn("node", _node(0)).join(bad, ["file", "node"], "left_semi") for x in (first, second)]
    left, right = (d.groupBy("file", "start", "key", "length", "digest").agg(F.count("*").alias("copies")) for d in in_bad)
    at = ["file", "start"]
    diff = left.alias("l").join(right.alias("r"), at, "full").where(~(F.col("l.digest").eqNullSafe(F.col("r.digest")) & F.col("l.copies").eqNullSafe(F.col("r.copies"))))
    # A record of the first replica that the second holds elsewhere in the file has moved.
    moved = right.select("file", F.col("digest").alias("elsewhere")).distinct()
    rows = diff.select("file", "start", F.coalesce("l.key", "r.key").alias("key"), F.coalesce("l.length", "r.length").alias("length"), F.col("l.digest").alias("expected"), F.col("r.digest").alias("found"))
    marked = rows.join(moved, (rows["file"] == moved["file"]) & (rows["expected"] == moved["elsewhere"]), "left").drop(moved["file"])
    return marked.withColumn("finding", F.when(F.col("elsewhere").isNotNull(), "moved").when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("corrupt")).drop("elsewhere")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the WARC records of all pages against a replica in which about one payload in 67 has its second half's letters
    `a` turned into `e`, as a fault of the storage would, with its length unchanged."""
    pages = table(spark, sf_dir, "pages")
    faulty = (F.pmod(F.col("page_id"), F.lit(67)) == 5) & F.col("html").isNotNull()
    half = F.floor(F.length("html") / 2).cast("int")
    damaged = F.when(faulty, F.concat(F.substring("html", F.lit(1), half), F.translate(F.substr("html", half + 1, F.length("html")), "a", "e"))).otherwise(F.col("html"))
    total = pages.agg(F.sum(F.octet_length("html") + 200)).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    replicas = [materialise(leaves(pages.select(F.col("page_id").alias("key"), record(F.col("url"), F.col("page_id"), p).alias("data")), files), f"replica{i}") for i, p in enumerate((F.col("html"), damaged))]
    return audit(*replicas).select(F.col("key").alias("page_id"), "length", "expected", "found", "finding")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CASE WHEN page_id % 67 = 5 AND html IS NOT NULL
      THEN substr(html, 1, CAST(length(html) // 2 AS BIGINT)) || translate(substr(html, CAST(length(html) // 2 + 1 AS BIGINT)), 'a', 'e')
      ELSE coalesce(html, '') END AS damaged
  FROM pages
), r AS (
  SELECT page_id, strlen(html) AS n, html, damaged,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) AS head
  FROM p WHERE html <> damaged
)
SELECT page_id, CAST(strlen(head) + n + 4 AS BIGINT) AS length,
  sha256(head || html || chr(13) || chr(10) || chr(13) || chr(10)) AS expected,
  sha256(head || damaged || chr(13) || chr(10) || chr(13) || chr(10)) AS found, 'corrupt' AS finding
FROM r
"""
