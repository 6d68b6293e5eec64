"""Near-duplicate classes of documents: ProbMinHash signatures, banding, exact verification, connected components.

A text's shingles are its runs of five words (a shorter text is one shingle); their weights are 1 + ln(occurrences). Each
shingle is a Poisson process whose rate is its weight: its arrivals come at exponential intervals and each falls on a random
slot of the signature, which keeps its earliest arrival. A shingle is dropped as soon as its next arrival is later than every
slot's earliest. The share of equal slots estimates the probability Jaccard similarity of the weighted shingles; with all
rates 1 it estimates the plain Jaccard similarity, by which links are verified. So each text is signed with rates of 1, and a
text that repeats a shingle also with its weights; a pair is a candidate by any of its signatures.

Signatures are cut into bands; documents with an equal band share a bucket. In each bucket every document is first compared
with one leader, in linear work. Buckets that then still hold several components are compared further, in blocks: documents
outside the bucket's largest component with all of the bucket, by signature first, each pair in the first band it shares. Every link is verified exactly: the
Jaccard similarity of the shingle sets (64-bit hashes) is at least `similarity`. Classes are the components of these links;
exact copies are joined beforehand by a hash of the text, whatever their number.

Null and empty texts, and texts without a word, have no shingle: equal ones of these form a class, null counting as empty.
A doc_id names one document: rows that repeat it are in one class. Rows with a null id take no part; op10 gives each a null class.
Classes are named by their smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.ship import ship
from docfields.llm.common import batch_of, materialise, parts_of, table, words_of

WORDS = 5
#: Bands and slots in a band: two texts of similarity 0.8 share a band of rates 1 with probability 1 - (1 - 0.8 ** 5) ** 25 > 0.9999.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Slots are won independently, so signatures with rates of 1 of texts of similarity 0.8 agree in fewer slots than this once in
#: about 4 million pairs (a binomial tail), more rarely than such texts share no band (one in 20,000); a test counts both.
LEAST_EQUAL = round(SLOTS * 0.61)
BLOCK = 512
#: Ids and texts in at most this number are broadcast (16 bytes each); beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000
HOT_KEYS = 2000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


Sets = list[tuple[np.ndarray, np.ndarray]]


def shingles(texts: pa.Array) -> Sets:
    """For each text the hashes of its distinct shingles, sorted, and how often each occurs. Words are parted by Unicode white space."""
    ends, number, distinct = words_of(texts, pc.utf8_split_whitespace)
    h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[number]
    size = np.diff(ends)
    runs = np.full(len(h), WORDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(h))):
            runs[: len(h) - k] = _mix(runs[: len(h) - k] * _GOLD + h[k:])
    out = []
    for a, n in zip(ends[:-1].tolist(), size.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(runs[a : a + n - WORDS + 1], return_counts=True))
        else:
            few = np.full(min(n, 1), n, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    few = _mix(few * _GOLD + h[a + k])
            out.append((few, np.ones(len(few), dtype=np.int64)))
    return out


def signatures(sets: Sets) -> np.ndarray:
    """A row of SLOTS shingle hashes (their low 32 bits) for each weighted set; sets without shingles get zeros."""
    docs = len(sets)
    of = np.repeat(np.arange(docs), [len(s) for s, _ in sets])
    element = np.concatenate([s for s, _ in sets]) if docs else np.empty(0, np.uint64)
    rate = 1 + np.log(np.concatenate([c for _, c in sets])) if docs else np.empty(0)
    earliest = np.full(docs * SLOTS, np.inf)
    holder = np.zeros(docs * SLOTS, dtype=np.uint32)
    clock = np.zeros(len(element))
    with np.errstate(over="ignore"):
        arrival = np.uint64(0)
        while len(element):
            arrival += np.uint64(1)
            draw = _mix(element + arrival * _GOLD)
            clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 1) / 2.0**53) / rate
            slot = of * SLOTS + (_mix(draw) % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(earliest, slot, clock)
            won = clock == earliest[slot]  # elements of a text are in order, so the largest of equally early ones holds a slot
            holder[slot[won]] = element[won].astype(np.uint32)
            latest = earliest.reshape(docs, SLOTS).max(axis=1)
            alive = clock <= latest[of]  # later arrivals of the others come later still
            of, element, rate, clock = of[alive], element[alive], rate[alive], clock[alive]
    return holder.reshape(docs, SLOTS)


def _few(sets: Sets) -> Iterator[slice]:
    """Stretches of the sets with about 2 ** 18 shingles each, so that arrays of a stretch stay small."""
    ends = np.cumsum([len(s) for s, _ in sets])
    start = 0
    while start < len(sets):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2**18, side="right")))
        yield slice(start, stop)
        start = stop


def sign(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, bands array<long>, slots array<int>): the key is a hash of the whole text; texts without a word have no bands.
    Bands and slots of the signature with rates of 1 come first, then those of the weighted one if the text repeats a shingle."""
    out = pa.schema([("id", pa.int64()), ("key", pa.string()), ("bands", pa.list_(pa.int64())), ("slots", pa.list_(pa.int32()))])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _GOLD
        for part in parts_of(batches):
            whole = shingles(part.column("text"))
            for few in _few(whole):
                sets, rows = whole[few], part.slice(few.start, few.stop - few.start)
                again = {k: len(sets) + n for n, k in enumerate(k for k, (_, c) in enumerate(sets) if (c > 1).any())}
                slots = signatures([(s, np.ones_like(c)) for s, c in sets] + [sets[k] for k in again])
                band = np.broadcast_to(base, (len(slots), BANDS)).copy()
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        band = _mix(band * _GOLD + slots[:, k::ROWS].astype(np.uint64))
                of = [[k, again[k]] if k in again else [k] if len(s) else [] for k, (s, _) in enumerate(sets)]
                yield batch_of(out, rows.column("id"), rows.column("key"), *([x[k].ravel() for k in of] for x in (band.view(np.int64), slots.view(np.int32))))

    text = F.coalesce(text_col, F.lit(""))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.md5(text).alias("key"), text.alias("text")).mapInArrow(run, "id long, key string, bands array<long>, slots array<int>")


def _of(key: Column) -> Column:
    """What tells an id's texts apart."""
    return F.xxhash64(key).alias("of")


def _part_of(column: str, n: int) -> Column:
    """The n values of this row's kind of signature."""
    return F.slice(column, F.col("kind") * n + 1, F.lit(n)).alias(column)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, of, members array<long>): the shingle sets of the texts named in ids (id, of), one row each."""
    out = pa.schema([("id", pa.int64()), ("of", pa.int64()), ("members", pa.list_(pa.int64()))])

    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            yield batch_of(out, part.column("id"), part.column("of"), [s.view(np.int64) for s, _ in shingles(part.column("text"))])

    some = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    text = F.coalesce(text_col, F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), _of(F.md5(text)), text.alias("text")).join(some, ["id", "of"], "left_semi").mapInArrow(run, "id long, of long, members array<long>")
    return materialise(found, "sets").dropDuplicates(["id", "of"])


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b), of pairs of texts (a, a_of, b, b_of), whose shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id"), F.col("a_of").alias("of")).union(pairs.select("b", "b_of")).distinct()
    sets = _sets(docs, ids, id_col, text_col)
    left, right = (sets.select(F.col("id").alias(c), F.col("of").alias(f"{c}_of"), F.col("members").alias(f"{c}_members")) for c in "ab")
    both = pairs.join(right, ["b", "b_of"]).join(left, ["a", "a_of"])
    shared = F.size(F.array_intersect("a_members", "b_members"))
    return both.where(shared >= similarity * (F.size("a_members") + F.size("b_members") - shared) - 1e-9).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each linked id's component. Each round takes the smallest root among neighbours, then the
    root's own root, until nothing changes; a round is written to the shared folder, so lineage stays short."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    roots = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = edges.join(roots, edges["b"] == roots["id"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        nearer = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        up = roots.select(F.col("id").alias("mid"), F.col("root").alias("top"))
        moved = materialise(nearer.join(up, "mid", "left").select("id", "was", F.least("mid", F.coalesce("top", "mid")).alias("root")), "roots")
        changed = moved.where("was <> root").limit(1).count()
        roots = moved.select("id", "root")
        if not changed:
            return roots


def _meet(rows: DataFrame, compare, schema: str, carried: list[str], groups: int) -> DataFrame:
    """Runs compare(minor rows, other rows) on each pair of blocks of a bucket: rows outside its main component against all. Many
    small pairs travel in one group; compare gets the columns as arrays and yields rows."""
    each = rows.groupBy("bucket").agg(F.sum(F.col("minor").cast("int")).alias("few"), F.count("*").alias("n")).where("few > 0")
    dealt = rows.join(each, "bucket")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    left = dealt.where("minor").select("bucket", *carried, part("few").alias("i"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("j"))
    right = dealt.select(F.col("bucket").alias("at"), *[F.col(c).alias(f"other_{c}") for c in carried], part("n").alias("oj"), F.explode(F.sequence(F.lit(0), blocks("few") - 1)).alias("oi"))
    group = lambda *key: F.pmod(F.xxhash64(*key), F.lit(groups))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def arrays(df: pd.DataFrame, prefix: str) -> dict[str, np.ndarray]:
        return {c: np.stack(df[prefix + c].to_list()) if c == "slots" else df[prefix + c].to_numpy() for c in carried}

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(one) and len(two):
            x, y = arrays(one, ""), arrays(two, "other_")
            there = two.groupby(["at", "oi", "oj"]).indices
            for key, rows_ in one.groupby(["bucket", "i", "j"]).indices.items():
                out += compare(int(key[0]), {c: v[rows_] for c, v in x.items()}, {c: v[there[key]] for c, v in y.items()})
        return pd.DataFrame(out, columns=names, dtype="int64")

    ship()
    return left.withColumn("g", group("bucket", "i", "j")).groupBy("g").cogroup(right.withColumn("og", group("at", "oi", "oj")).groupBy("og")).applyInPandas(run, schema)


def _alike(slots: np.ndarray, mine: np.ndarray, band: int) -> np.ndarray:
    """Rows whose signatures agree often enough with mine, and for which this is the first band they share with it."""
    same = slots == mine
    some = np.flatnonzero(same.sum(axis=1) >= LEAST_EQUAL)
    first = same[some].reshape(len(some), BANDS, ROWS).all(axis=2).argmax(axis=1)
    return some[first == band]


def _further(buckets: DataFrame, raw: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Verified links across components inside buckets that hold several of them. Signatures say which documents may have
    such links; the shingle sets of these alone then meet, block by block. A task returns links that join components which
    its earlier links haven't joined, so the result is no longer than the documents that meet in it."""
    placed = buckets.join(roots, "id", "left").select("bucket", "band", "id", "of", "kind", F.coalesce("root", "id").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    rows = materialise(placed.join(mixed, "bucket"), "mixed")
    need = materialise(rows.select("id", "of").distinct(), "need")
    some = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    slots = raw.select("id", _of(F.col("key")), "slots").join(some, ["id", "of"], "left_semi").groupBy("id", "of").agg(F.first("slots").alias("slots"))
    rows = rows.join(slots, ["id", "of"]).withColumn("slots", _part_of("slots", SLOTS))
    rows = rows.select("bucket", "band", "id", "of", "root", "slots", (F.col("root") != F.col("main")).alias("minor"))

    def likely(bucket: int, mine: dict[str, np.ndarray], others: dict[str, np.ndarray]) -> set[tuple[int, int, int]]:
        out: set[tuple[int, int, int]] = set()
        band = mine["band"][0]
        for i, t, r, s in zip(mine["id"].tolist(), mine["of"].tolist(), mine["root"].tolist(), mine["slots"], strict=True):
            hit = _alike(others["slots"], s, band)
            hit = hit[others["root"][hit] != r]
            if len(hit):
                out.add((bucket, i, t))
                out.update((bucket, *x) for x in zip(others["id"][hit].tolist(), others["of"][hit].tolist(), strict=True))
        return out

    def exact(bucket: int, mine: dict[str, np.ndarray], others: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        ids, roots_, band = others["id"].tolist(), others["root"].tolist(), mine["band"][0]
        sets = [frozenset(m.tolist()) for m in others["members"]]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for i, r, s, m in zip(mine["id"].tolist(), mine["root"].tolist(), mine["slots"], mine["members"], strict=True):
            own = frozenset(m.tolist())
            for k in _alike(others["slots"], s, band).tolist():
                x, y = root(r), root(roots_[k])
                if x != y:
                    shared = len(own & sets[k])
                    if shared >= similarity * (len(own) + len(sets[k]) - shared) - 1e-9:
                        joined[max(x, y)] = min(x, y)
                        out.append((min(i, ids[k]), max(i, ids[k])))
        return out

    groups = max(8, buckets.count() // 1024)
    hits = materialise(_meet(rows, likely, "bucket long, id long, of long", ["id", "of", "root", "slots", "band"], groups).distinct(), "hits")
    sets = _sets(docs, hits.select("id", "of").distinct(), id_col, text_col)
    few = rows.join(hits, ["bucket", "id", "of"], "left_semi").join(sets, ["id", "of"])
    return _meet(few, exact, "a long, b long", ["id", "root", "slots", "band", "members"], groups).distinct()


def _with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to facts, which has each key once and says in `count` how many rows have it. Keys of over 1 / HOT_KEYS of all
    rows, of which there are less than HOT_KEYS, are broadcast, so that no task gets a hot key's rows; the others are shuffled."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(count) * HOT_KEYS > total))
    facts_of_rest = facts.where(F.col(count) * HOT_KEYS <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(facts_of_rest, key)).drop(count)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """A row for each id that isn't null: id, class_id (the class's smallest id), n_copies (ids with just this text), n_links (verified links of this text that
    joined it to others; links inside what is already joined are not looked for)."""
    raw = materialise(sign(docs, id_col, text_col), "signed")
    # One vertex for the texts that have the same smallest id, which names it; an id with texts of several vertices links them.
    texts = materialise(raw.groupBy("key").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n_copies"), F.count("*").alias("n_rows"), F.first("bands").alias("bands")), "texts")
    kinds = texts.where(F.size("bands") > 0).withColumn("kind", F.explode(F.sequence(F.lit(0), (F.size("bands") / BANDS).cast("int") - 1)))
    signed = kinds.select(F.col("rep").alias("id"), _of(F.col("key")), "kind", _part_of("bands", BANDS))
    reps = materialise(_with_facts(raw.select("id", "key"), texts.select("key", "rep", "n_copies", "n_rows"), "key", "n_rows").groupBy("id", "rep").agg(F.max("n_copies").alias("n_copies")), "reps")
    own = reps.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.max("n_copies").alias("n_copies"))
    own = materialise(own, "own")
    several = own.where("other <> rep").select("id", F.col("rep").alias("a")).join(reps.select("id", F.col("rep").alias("b")), "id").where("a <> b").select("a", "b").distinct()

    pairs_in = signed.select("id", "of", "kind", F.posexplode("bands").alias("band", "bucket"))
    leaders = pairs_in.groupBy("bucket").agg(F.min(F.struct("id", "of")).alias("leader"), F.max("id").alias("last")).where("leader.id <> last").drop("last")
    buckets = materialise(pairs_in.join(leaders, "bucket"), "buckets")
    stars = materialise(buckets.where("id <> leader.id").select(F.col("leader.id").alias("a"), F.col("leader.of").alias("a_of"), F.col("id").alias("b"), F.col("of").alias("b_of")).distinct(), "stars")
    links = materialise(_verified(stars, docs, id_col, text_col, similarity).union(several), "links")
    roots = components(links)

    found = materialise(_further(buckets.select("bucket", "band", "id", "of", "kind"), raw, roots, docs, id_col, text_col, similarity), "more_links")
    all_links = links.union(found)
    if found.limit(1).count():
        roots = components(all_links)
    degree = all_links.select(F.col("a").alias("rep")).union(all_links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    by_rep = materialise(own.groupBy("rep").agg(F.count("*").alias("n_ids")).join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left"), "classes")
    named = _with_facts(own.select("id", "rep", "n_copies"), by_rep, "rep", "n_ids")
    return named.select(F.col("id").alias(id_col), F.coalesce("root", "rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def for_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of classes, and for each row with a null id one of nulls."""
    found = classes(docs, id_col, text_col, similarity)
    return found.union(docs.where(F.col(id_col).isNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema]))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class, and how many verified links and exact copies its text has."""
    return for_all(table(spark, sf_dir, "documents"))
