"""The trie of conversation prefixes, with totals of subtrees by time-forward processing.

A node is a distinct sequence of first turns; conversations that start with it are its members. Its key is two hashes of 64 bits,
each the exclusive or of hashes of (place, role, text) along the path; they are taken as equal only where paths are. A conversation
longer than BLOCK turns is hashed in blocks, so no task gets all of it.

Nodes with the same smallest member and the same number of members lie on one path below each other: a run. Only the last node of a
run has several children or ends, so the trie of runs has at most two runs for each distinct conversation. Its totals are passed
upwards in time-forward order: runs are sorted by falling depth of their last node, each takes the messages that wait for it in a
priority queue and sends one to its parent. The queue spills sorted stretches to disk, and the sort is Spark's external one.

Shards: runs with more than T members are the top, with T chosen so that at most `top` nodes have so many. What hangs below
the top are subtrees of at most T conversations each; they are dealt to tasks by their root and processed at once. The totals of their roots,
added up for each run of the top, go through the same processing once more, in one task of at most `top` runs.

Rows with a null conversation id take no part. Rows are ordered by turn (null first), then role, then text (null as empty), so rows
repeated in full are neighbours and each a turn of its own. A conversation may have any share of all rows, be of one row, or lose all of
its turns when rebuilt. An empty table gives no node, not even the root. Columns beside the four are not looked at. Texts of any length are
only hashed and their words counted.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import materialise, table

#: Turns of one conversation that a task gets at once.
BLOCK = 4096
KEY = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"


def placed_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, pos (from 1), x1 and x2 (120 bits of a hash of role and text), words. Rows are sorted over all tasks, and a turn's place is
    counted from the first row of its conversation in its task and the rows of it in tasks before."""
    given = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], F.monotonically_increasing_id().alias("tie"))
    order = ["conv", "turn", "role", "text", "tie"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    lane = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = given.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at"))
    turns = materialise(rows.select("conv", lane(1).alias("x1"), lane(16).alias("x2"), "words", "at", F.shiftright("at", 33).alias("task")), "turns")
    here = turns.groupBy("conv", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    here = here.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("task")) - F.col("n")).drop("n")
    return turns.join(here, ["conv", "task"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "x1", "x2", "words")


def rebuilt(placed: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv, depth, x1, x2, words: the first h turns of conversation c - c % group, then c's own behind its first h, h being crc32 of c
    modulo `most`; and a row of depth 0 for each conversation."""
    convs = placed.where("pos = 1").select("conv", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    # At most `most` - 1 rows of a conversation, for at most 2 * group - 1 others.
    heads = placed.where((F.col("pos") < most) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "x1", "x2", "words")
    lent = convs.join(heads, "base").where("depth <= h").select("conv", "depth", "x1", "x2", "words")
    # A conversation's own turns move up by what its base lacks of h turns: at most `most` - 1 candidates, so each row carries its
    # place and a block of the conversation, and the few facts are repeated for each block.
    taken = convs.join(lent.groupBy("conv").agg(F.count("*").alias("taken")), "conv", "left").select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    blocks = placed.select("conv", block).distinct().join(taken, "conv")
    own = placed.select("*", block).join(blocks, ["conv", "block"]).where("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "x1", "x2", "words")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "words")])
    return roots.unionByName(lent).unionByName(own)


def members(turns: DataFrame) -> DataFrame:
    """conv, depth, k1, k2, p1, p2 (the parent's key), words of each conversation's prefixes; turns have depth 0 for the root."""
    mixed = lambda *c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*c))
    rows = turns.select("conv", "depth", "words", mixed("depth", "x1", "x2").alias("y1"), mixed("x2", F.lit("second"), "x1", "depth").alias("y2"), F.floor(F.col("depth") / BLOCK).alias("block"))
    rows = materialise(rows, "turns")
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv", "block").agg(F.bit_xor("y1").alias("c1"), F.bit_xor("y2").alias("c2")).select("conv", "block", F.bit_xor("c1").over(ahead).alias("c1"), F.bit_xor("c2").over(ahead).alias("c2"))
    here = Window.partitionBy("conv", "block").orderBy("depth")
    own = rows.select("*", F.bit_xor("y1").over(here).alias("o1"), F.bit_xor("y2").over(here).alias("o2")).join(carried, ["conv", "block"])
    key = lambda k: F.col(f"o{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("long")))
    return own.select("conv", "depth", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("y1")).alias("p1"), key(2).bitwiseXOR(F.col("y2")).alias("p2"), "words")


class Inbox:
    """Messages (key, leaves, saved) in the order of their keys. At most `most` are held in memory; sorted stretches of them go
    to a file of the task's own, which ends with it."""

    def __init__(self, most: int) -> None:
        self.most, self.heap, self.files = most, [], []

    def put(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.most:
            stretch = self._spilled(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.files, (next(stretch), len(self.files), stretch))

    @staticmethod
    def _spilled(messages: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for at in range(0, len(messages), 1024):
            pickle.dump(messages[at : at + 1024], file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(0, n, 1024):
                    yield from pickle.load(file)

        n = len(messages)
        return read()

    def take(self, key: tuple) -> Iterator[tuple]:
        """All messages for this key, which must not lie behind one that still waits."""
        while self.heap or self.files:
            from_file = self.files and (not self.heap or self.files[0][0] < self.heap[0])
            first = self.files[0][0] if from_file else self.heap[0]
            if first[0] > key:
                return
            if first[0] < key:
                raise ValueError("a message for a run that is not here")
            if not from_file:
                heapq.heappop(self.heap)
            elif (following := next(self.files[0][2], None)) is None:
                heapq.heappop(self.files)
            else:
                heapq.heapreplace(self.files, (following, *self.files[0][1:]))
            yield first


RUN = "rep long, n long, top long, bottom long, p1 long, p2 long, b1 long, b2 long, weight long, outer boolean, children long, leaves long, below long"
TOTAL = "rep long, n long, top long, bottom long, p1 long, p2 long, outer boolean, children long, leaves long, below long, saved long"


def time_forward(runs: DataFrame, most: int = 200_000) -> DataFrame:
    """Totals of runs, which each task holds in the order of (bottom descending, b1, b2). A run whose parent isn't in the task is
    `outer` and sends nothing. `children`, `leaves` and `below` come with what was received from elsewhere."""
    names = [c.split()[0] for c in TOTAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox = Inbox(most)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for _, leaves, saved in inbox.take((-r["bottom"], r["b1"], r["b2"])):
                    r["children"] += 1
                    r["leaves"] += leaves
                    r["below"] += saved
                r["leaves"] = r["leaves"] or 1
                r["saved"] = r["below"] + r["weight"]
                if not r["outer"]:
                    inbox.put(((1 - r["top"], r["p1"], r["p2"]), r["leaves"], r["saved"]))
                out.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.bool_() if c == "outer" else pa.int64()) for c in names], names=names)

    ship()
    order = [F.desc("bottom"), "b1", "b2"]
    return runs.sortWithinPartitions(*order).select(*[c.split()[0] for c in RUN.split(", ")]).mapInArrow(run, TOTAL)


def totals(nodes: DataFrame, paths: DataFrame, top: int = 50_000, least: int = 64) -> DataFrame:
    """rep, n, top, bottom (depths of the first and last node), children, leaves, below (saved below the last node) and parent_rep of
    each run. `nodes` and `paths` (members) are tables that can be read again."""
    size = nodes.agg(F.sum("n")).first()[0] or 0
    light = max(least, -(-size // top))
    runs = nodes.groupBy("rep", "n").agg(F.min(F.struct("depth", "p1", "p2")).alias("t"), F.max(F.struct("depth", "k1", "k2")).alias("b"), F.sum((F.col("n") - 1) * F.col("words")).alias("weight"))
    flat = runs.select("rep", "n", F.col("t.depth").alias("top"), F.col("b.depth").alias("bottom"), "t.p1", "t.p2", F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2"), "weight", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "below")])
    flat = materialise(flat, "runs")
    # More than `light` members each and `size` in all: at most `top` nodes, of three numbers.
    large = nodes.where(F.col("n") > light).select(*KEY)
    roots = paths.join(F.broadcast(large), KEY, "left_anti").groupBy("conv").agg(F.min(F.struct(*KEY)).alias("root"))
    below = flat.where(F.col("n") <= light).join(roots.withColumnRenamed("conv", "rep"), "rep").withColumn("outer", F.col("top") == F.col("root.depth"))
    small = materialise(time_forward(below.repartition("root")), "totals")
    received = small.where("outer").groupBy(F.col("top").alias("_top"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(F.count("*").alias("_children"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    above = flat.where(F.col("n") > light).drop("children", "leaves", "below")
    on = (F.col("_top") == F.col("bottom") + 1) & (F.col("_p1") == F.col("b1")) & (F.col("_p2") == F.col("b2"))
    above = above.join(received, on, "left").select("*", (F.col("top") == 0).alias("outer"), *[F.coalesce(f"_{a}", F.lit(0)).alias(b) for a, b in (("children", "children"), ("leaves", "leaves"), ("saved", "below"))])
    large_totals = time_forward(above.repartition(1))
    parent = lambda df: df.select(F.col("rep").alias("parent_rep"), (F.col("bottom") + 1).alias("top"), F.col("b1").alias("p1"), F.col("b2").alias("p2"))
    tops, others = parent(flat.where(F.col("n") > light)), parent(flat.where(F.col("n") <= light))
    on = ["top", "p1", "p2"]
    # Runs of the top, at most `top`, may have any number of children and are broadcast; others have at most `light` children.
    found = large_totals.unionByName(small.where("outer")).join(F.broadcast(tops), on, "left").unionByName(small.where("NOT outer").join(others, on))
    return found.select("rep", "n", "top", "bottom", "children", "leaves", "below", "parent_rep")


def end_hashes(paths: DataFrame) -> DataFrame:
    """Key and ends_sha256 of the nodes where conversations end. Ids are sorted over all tasks, which join stretches of them; a task
    then reads a node's stretches in order, since a SHA-256 can't be put together from parts, and holds one stretch at a time."""
    last = paths.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("e")).select("e.*", "conv")
    order = [*KEY, "conv"]
    keys = [(c, pa.int64()) for c in KEY]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for d, a, b, conv in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if out and out[-1][:3] == [d, a, b]:
                    out[-1][4].append(str(conv))
                else:
                    out.append([d, a, b, conv, [str(conv)]])
            yield pa.RecordBatch.from_pylist([dict(zip([*order, "ids"], [*r[:4], ",".join(r[4])], strict=True)) for r in out], pa.schema([*keys, ("conv", pa.int64()), ("ids", pa.string())]))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*keys, ("ends_sha256", pa.string())])
        row = lambda key, digest: {**dict(zip(KEY, key, strict=True)), "ends_sha256": digest.hexdigest()}
        now, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if now:
                        out.append(row(now, digest))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([row(now, digest)], schema)

    ship()
    longs = ", ".join(f"{c} long" for c in KEY)
    joined = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stretches, f"{longs}, conv long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashes, f"{longs}, ends_sha256 string")


def trie(turns: DataFrame, top: int = 50_000, least: int = 64) -> DataFrame:
    """The nodes of `turns` (conv, depth, x1, x2, words; depth 0 for the root): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    paths = materialise(members(turns), "members")
    found = paths.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"))
    nodes = materialise(found, "nodes")
    run = ["rep", "n", "block"]
    parts = nodes.select("*", ((F.col("n") - 1) * F.col("words")).alias("w"), F.floor(F.col("depth") / BLOCK).alias("block"))
    later = Window.partitionBy("rep", "n").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy(*run).agg(F.sum("w").alias("w")).select(*run, F.coalesce(F.sum("w").over(later), F.lit(0)).alias("later"))
    # A run's totals are repeated for each of its blocks, so a run of any length is dealt to many tasks.
    facts = blocks.join(totals(nodes, paths, top, least), ["rep", "n"])
    here = F.sum("w").over(Window.partitionBy(*run).orderBy(F.desc("depth")))
    joined = parts.select("*", here.alias("here")).join(facts, run).join(end_hashes(paths), KEY, "left")
    parent: Column = F.when(F.col("depth") == F.col("top"), F.col("parent_rep")).otherwise(F.col("rep"))
    return joined.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("here") + F.col("later") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = materialise(placed_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "placed")
    return trie(rebuilt(placed))


_CRC = """xor(4294967295, list_reduce([4294967295] || [ord(x)::BIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, b.pos AS place, b.role, b.text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), d AS (SELECT conv_id, text, md5(length(role) || ':' || role || text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM r
), m AS (
  SELECT conv_id, depth, string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path
), n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) * (count(*) - 1) AS own FROM m GROUP BY path
), p AS (SELECT n.path, q.path AS parent FROM n JOIN m q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
), k AS (SELECT parent AS path, count(*) AS n_children FROM p GROUP BY parent
), s AS (
  SELECT a.path, sum(n.own) AS saved, count(*) FILTER (WHERE k.path IS NULL) AS leaves
  FROM n LEFT JOIN k ON k.path = n.path JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.path
)
SELECT n.conv_id, n.depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN p ON p.path = n.path LEFT JOIN n f ON f.path = p.parent
"""
