"""Linking field texts to their boxes on the page.

Boxes: extraction_id, ordinal, type (line or word), content, page_number, polygon, in one table or in a dict with a table for each
type. Targets: extraction_id, target_id, target and,
where matching is by page, page_number. `ordinal` may be of any type that has an order; boxes that share one are taken in the order
of page and text.

Matching is filter and verify. Repeated texts count once: of a document's boxes with the same normalised text only the first can be
found, and a text is looked up once, however many fields have it. Equal lines are an equi-join. A text and a line meet if one holds
the other, or if their lengths and letters allow the ratio that is asked for. Words meet by their lengths: a word is looked up under
each length that allows the ratio. Boxes stream past the texts that are looked up, so they are neither sorted nor grouped; only those that
match keep their place. Letters are compared before the ratio itself, the one helper that Spark's functions lack, sees the pairs that
are left."""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docfields.functions.ship import ship
from docfields.functions.store import stored
from docfields.functions.text import blank as is_blank
from docfields.functions.text import normalise, strip

LINE, WORD, UNION_SHARE, BOOST = 0.85, 0.9, 0.95, 0.9
Boxes = DataFrame | dict[str, DataFrame]
#: Writes a table and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]
#: Letters from rare to frequent.
LETTERS = "zqxjkvbpygfwmucldrhsnioate"
#: From this length on the ratio leaves out frequent characters, so that a text may hold another and have a ratio below their share.
JUNK_FROM = 200


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher's ratio of each pair, in this order of arguments; 0 if either text is empty."""
    known: dict[tuple[str, str], float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio() if all(pair) else 0.0
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)])


def letter_distance(a: Column, b: Column) -> Column:
    """The least number of characters that two texts differ in, whatever their order: of each class, how many more one of them has."""
    return counts_distance(letter_counts(a), letter_counts(b))


def letter_counts(c: Column) -> Column:
    """How many characters of each class a text has: each letter, blanks, digits, others."""
    digits, rest = "0123456789", LETTERS + " 0123456789"
    return F.array(*[F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS + " "], F.length(c) - F.length(F.translate(c, digits, "")), F.length(F.translate(c, rest, "")))


def counts_distance(a: Column, b: Column) -> Column:
    return reduce(Column.__add__, [F.abs(a[k] - b[k]) for k in range(len(LETTERS) + 3)])


def rare_letters(c: Column, least: float) -> Column:
    """The first of a text's distinct characters in one order for all texts, of which any text with a ratio of `least` has one among its
    own: it has at least length * least / (2 - least) characters in common with such a text, so not all of as many as it may lack
    and one more. Letters come by rarity, as capitals, which a normalised text doesn't have."""
    needed = F.length(c) - F.ceil(F.length(c) * (least / (2 - least)) - 1e-9) + 1
    ranked = F.array_sort(F.array_distinct(F.split(F.translate(c, LETTERS, string.ascii_uppercase), "")))
    return F.slice(F.array_remove(ranked, ""), F.lit(1), F.greatest(needed, F.lit(1)).cast("int"))


def length_band(length: Column) -> Column:
    """Texts with a ratio of LINE or more are in the same or in neighbouring bands."""
    return F.floor(F.log(length.cast("double")) / math.log((2 - LINE) / LINE)).cast("int")


def may_reach(la: Column, lb: Column, least: Column | float) -> Column:
    """Whether the lengths allow a ratio of at least `least`."""
    return 2 * F.least(la, lb) >= least * (la + lb)


def may_differ(la: Column, lb: Column, least: Column | float) -> Column:
    """How many characters two texts of a ratio of at least `least` may differ in."""
    return (F.lit(1.0) - least) * (la + lb) + 1e-9


def may_seed(length: Column, a: Column, b: Column) -> Column:
    """Whether the ratio may find a character of a text (of counts `a`) in one of JUNK_FROM characters or more (of counts `b`): one that is
    there and not frequent. If not, the ratio sees nothing but what both texts begin with. Digits and others aren't told apart."""
    rare = [(a[k] > 0) & b[k].between(1, F.floor(length / 100) + 1) for k in range(len(LETTERS) + 1)]
    return reduce(Column.__or__, [*rare, *[(a[k] > 0) & (b[k] > 0) for k in (len(LETTERS) + 1, len(LETTERS) + 2)]])


def lengths_within(length: Column, least: Column) -> Column:
    """All lengths of texts that may have a ratio of `least` to one of this length."""
    return F.sequence(F.ceil(length * (least / (2 - least)) - 1e-9), F.floor(length * ((2 - least) / least) + 1e-9))


def union_polygon(polygons: Column) -> Column:
    """The rectangle around all polygons, as four corners from the top left; empty for none."""
    every = F.flatten(polygons)
    xs, ys = F.filter(every, lambda v, i: i % 2 == 0), F.filter(every, lambda v, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when(F.size(every) >= 2, F.array(x0, y0, x1, y0, x1, y1, x0, y1)).otherwise(F.array().cast("array<double>"))


def rectangle_around(polygon: Column) -> Column:
    """As an aggregate, the rectangle around the polygons of a group; numbers at odd places of each are its y. Only the four limits are
    kept, so no polygon leaves its task. Empty if the polygons hold fewer than two numbers."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    x0, x1, y0, y1 = F.min(F.array_min(xs)), F.max(F.array_max(xs)), F.min(F.array_min(ys)), F.max(F.array_max(ys))
    return F.when(F.sum(F.size(polygon)) >= 2, F.array(x0, y0, x1, y0, x1, y1, x0, y1)).otherwise(F.array().cast("array<double>"))


_MATCH = ("polygon", "matched_text", "confidence", "page")


def _keys(by_page: bool) -> list[str]:
    return ["extraction_id", "page_number"] if by_page else ["extraction_id"]


def _dealt(side: DataFrame) -> DataFrame:
    """One side of a join that is dealt by its keys, never sent to all: a stored table's size on disk says little about its rows in
    memory, and the driver would have to build what is sent."""
    return side.hint("merge")


def _looked_up(side: DataFrame) -> DataFrame:
    """The texts side of a join with boxes: dealt by its keys and held by each task for its part, while boxes stream past."""
    return side.hint("shuffle_hash")


def _normal(boxes: Boxes, kind: str, by_page: bool, norm: Callable[[Column], Column] = normalise, blank: bool = False) -> DataFrame:
    """The normalised text `b` of each line or word, with its box as (ordinal, page, content, polygon)."""
    box = F.struct("ordinal", F.col("page_number").alias("page"), "content", "polygon")
    some = boxes[kind] if isinstance(boxes, dict) else boxes.where(F.col("type") == kind)
    if not blank:
        some = some.where(~is_blank(F.col("content")))
    return some.select(*_keys(by_page), norm(F.col("content")).alias("b"), box.alias("box"))


def first_boxes(boxes: Boxes, kind: str, by_page: bool = False, norm: Callable[[Column], Column] = normalise, blank: bool = False) -> DataFrame:
    """The distinct texts `b` of a document's (or page's) lines or words, each with its first box."""
    return _normal(boxes, kind, by_page, norm, blank).groupBy(*_keys(by_page), "b").agg(F.min("box").alias("box"))


def _found(confidence: Column) -> list[Column]:
    return [F.col("box.polygon").alias("polygon"), F.col("box.content").alias("matched_text"), confidence.alias("confidence"), F.col("box.page").alias("page")]


def _texts(targets: DataFrame, by_page: bool) -> DataFrame:
    return targets.where("t <> ''").select(*_keys(by_page), "t").distinct()


def _of_targets(targets: DataFrame, found: DataFrame, by_page: bool) -> DataFrame:
    return targets.select("extraction_id", "target_id", "t", *_keys(by_page)[1:]).join(_dealt(found), [*_keys(by_page), "t"]).select("extraction_id", "target_id", *_MATCH)


def _equal_lines(texts: DataFrame, boxes: Boxes, by_page: bool, keep: Keep | None = None) -> DataFrame:
    on = [*_keys(by_page), "t"]
    lines = _normal(boxes, "line", by_page).withColumnRenamed("b", "t").join(_looked_up(texts), on)
    return lines.groupBy(*on).agg(F.min("box").alias("box")).select(*on, *_found(F.lit(1.0)))


def match_equal_lines(targets: DataFrame, boxes: Boxes, by_page: bool = False) -> DataFrame:
    return _of_targets(targets, _equal_lines(_texts(targets, by_page), boxes, by_page), by_page)


def _rated(pairs: DataFrame, a: str, b: str, known: Column, ratio: Column, keep: Keep | None) -> DataFrame:
    """pairs with the ratio `r` of each: `ratio` where it is known. Other pairs, if several documents have them, are rated once, unless
    rows must stay in their document: `keep` then writes them, since a plan forgets behind a helper how its rows are dealt."""
    if keep:
        return keep(pairs.withColumn("r", F.when(known, ratio).otherwise(fuzzy_ratio(F.when(~known, F.col(a)), F.col(b)))), "rated")
    pairs = stored(pairs, "pairs")  # read three times
    rest = pairs.where(~known)
    asked = rest.select(a, b).distinct().withColumn("r", fuzzy_ratio(a, b))
    return pairs.where(known).withColumn("r", ratio).unionByName(rest.join(_dealt(asked), [a, b]))


def _similar_lines(texts: DataFrame, boxes: Boxes, by_page: bool, keep: Keep | None = None) -> DataFrame:
    """The line that a scan in order ends with: one that holds the target, or is held by it, is taken if its ratio beats the best
    so far, which then becomes at least 0.9; another if its ratio is at least 0.85 and beats the best. So of lines with a ratio
    below 0.85 only the first can count, and only if one text holds the other: the best is then still nothing."""
    ship()
    on = [*_keys(by_page), "t"]
    a, b, t = F.col("t"), F.col("b"), texts.withColumn("t_counts", letter_counts(F.col("t")))
    n, m, both = F.length("t"), F.length("b"), F.length("t") + F.length("b")
    held = b.contains(a) | a.contains(b)
    near = may_reach(n, m, LINE) & (counts_distance(F.col("t_counts"), F.col("counts")) <= may_differ(n, m, LINE))
    lines = _normal(boxes, "line", by_page).withColumn("counts", letter_counts(b))
    # Without a seed the ratio is twice the length of the common beginning over both lengths.
    seeded = may_seed(m, F.col("t_counts"), F.col("counts"))
    begin = F.ceil(both * (LINE / 2) - 1e-9).cast("int")
    begins = F.when(held, F.left(a, F.lit(1)) == F.left(b, F.lit(1))).otherwise(F.left(a, begin) == F.left(b, begin))
    some = lines.join(_looked_up(t), _keys(by_page)).where((held | near) & ((m < JUNK_FROM) | begins | seeded))
    some = some.select(*on, "b", "box", held.alias("held"), ((m >= JUNK_FROM) & seeded).alias("seeded"))
    some = some.groupBy(*on, "b", "held", "seeded").agg(F.min("box").alias("box"))
    # A text that holds another has it as its longest match, so the ratio is known unless frequent characters are left out.
    known = F.col("held") & ((m < JUNK_FROM) | (~F.col("seeded") & (a.startswith(b) | b.startswith(a))))
    rated = _rated(some.withColumn("known", known).drop("seeded"), "t", "b", F.col("known"), 2.0 * F.least(n, m) / both, keep)
    one = F.struct(F.struct("box.ordinal", "box.page").alias("place"), "b", "held", "r", "box")
    lists = rated.where((F.col("held") & (F.col("r") > 0)) | (F.col("r") >= LINE)).groupBy(*on).agg(F.collect_list(F.when(F.col("r") >= LINE, one)).alias("near"), F.min(F.when(F.col("r") < LINE, one)).alias("far"))
    scan = F.array_sort(F.array_compact(F.concat("near", F.array("far"))))
    start = F.struct(F.lit(None).cast(some.schema["box"].dataType).alias("box"), F.lit(0.0).alias("best"))

    def step(acc: Column, e: Column) -> Column:
        best = F.when(e["held"], F.greatest(e["r"], F.lit(BOOST))).otherwise(e["r"])
        return F.when(e["r"] > acc["best"], F.struct(e["box"].alias("box"), best.alias("best"))).otherwise(acc)

    ends = lists.select(*on, F.aggregate(scan, start, step).alias("end"))
    return ends.select(*on, F.col("end.box").alias("box"), F.col("end.best").alias("best")).select(*on, *_found(F.col("best")))


def match_similar_lines(targets: DataFrame, boxes: Boxes, by_page: bool = False) -> DataFrame:
    return _of_targets(targets, _similar_lines(_texts(targets, by_page), boxes, by_page), by_page)


def similar_words(asked: DataFrame, boxes: Boxes, by_page: bool = False, keep: Keep | None = None) -> DataFrame:
    """(keys, w, least, box, r): for each word asked for (keys, w, least) the first word box that equals it or has a ratio of `least`, which
    must be LINE or more."""
    ship()
    keys, least = _keys(by_page), F.col("least")
    n, m = F.length("w"), F.length("b")
    words = _normal(boxes, "word", by_page).withColumn("length", F.length("b").cast("long"))
    pairs = words.join(_looked_up(asked.withColumn("length", F.explode(lengths_within(n, least)))), [*keys, "length"])
    # What one text has beyond the other in order is at least as many characters as must be changed to get from one to the other.
    pairs = pairs.where(may_reach(n, m, least) & (F.levenshtein("w", "b") <= may_differ(n, m, least))).groupBy(*keys, "w", "least", "b").agg(F.min("box").alias("box"))
    near = (keep or stored)(_rated(pairs, "b", "w", F.col("b") == F.col("w"), F.lit(1.0), keep).where("r >= least"), "near")
    first = F.min(F.struct("box.ordinal", "box.page", "b", "r", "box")).alias("m")
    return near.groupBy(*keys, "w", "least").agg(first).select(*keys, "w", "least", "m.box", "m.r")


def _by_words(texts: DataFrame, boxes: Boxes, by_page: bool, keep: Keep | None = None) -> DataFrame:
    """A single word: the first that equals it or is similar enough. Several: for each of two or more letters the first similar box;
    a match if these are at least half of all the target's words."""
    keys = _keys(by_page)
    parts = texts.withColumn("ws", F.split("t", " ")).withColumn("n", F.size("ws")).select(*keys, "t", "n", F.posexplode("ws").alias("k", "w"))
    parts = parts.where("n = 1 OR length(w) >= 2").withColumn("least", F.when(F.col("n") == 1, LINE).otherwise(WORD))
    found = similar_words(parts.select(*keys, "w", "least").distinct(), boxes, by_page, keep)
    ms = parts.join(_dealt(found), [*keys, "w", "least"]).groupBy(*keys, "t", "n").agg(F.sort_array(F.collect_list(F.struct("k", "box", "r"))).alias("ms"))
    share, one, first = F.size("ms") / F.col("n"), F.col("n") == 1, F.col("ms")[0]
    several = union_polygon(F.transform("ms", lambda x: x["box"]["polygon"]))
    return ms.where(share >= 0.5).select(*keys, "t", F.when(one, first["box"]["polygon"]).otherwise(several).alias("polygon"), F.array_join(F.transform("ms", lambda x: x["box"]["content"]), " ").alias("matched_text"), F.when(one, first["r"]).otherwise(F.least(share, F.lit(UNION_SHARE))).alias("confidence"), first["box"]["page"].alias("page"))


def _rest(texts: DataFrame, found: DataFrame, by_page: bool) -> DataFrame:
    return texts.join(_dealt(found), [*_keys(by_page), "t"], "left_anti")


def match_single_words(targets: DataFrame, boxes: Boxes, by_page: bool = False) -> DataFrame:
    return _of_targets(targets, _by_words(_texts(targets, by_page).where("NOT contains(t, ' ')"), boxes, by_page), by_page)


def match_word_unions(targets: DataFrame, boxes: Boxes, by_page: bool = False) -> DataFrame:
    return _of_targets(targets, _by_words(_texts(targets, by_page).where("contains(t, ' ')"), boxes, by_page), by_page)


def match_texts(texts: DataFrame, boxes: Boxes, by_page: bool = False, keep: Keep | None = None) -> DataFrame:
    """The match of each normalised text `t` of a document (or page), in stages: equal line, similar line, then the word or the union of
    words. What a stage leaves is written once and goes on. `keep` writes it in place of a plain table; then inputs are dealt by document,
    and no row leaves its document."""
    found, rest = [], texts
    for stage in (_equal_lines, _similar_lines, _by_words):
        found.append((keep or stored)(stage(rest, boxes, by_page, keep), "found"))
        if stage is not _by_words:
            rest = (keep or stored)(_rest(rest, found[-1], by_page), "rest")
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return keep(every, "matches") if keep else every


def match_text(targets: DataFrame, boxes: Boxes, by_page: bool = False, keep: Keep | None = None) -> DataFrame:
    """The match of each target. Blank targets and targets without a match have no row; targets that share an id have a row each."""
    t = targets.withColumn("t", normalise(F.col("target"))).where("t <> ''")
    return _of_targets(t, match_texts(_texts(t, by_page), boxes, by_page, keep), by_page)


def match_fields(fields: DataFrame, boxes: Boxes, keep: Keep | None = None) -> DataFrame:
    """fields (extraction_id, field_key, field_value, ...) with key_bbox and value_bbox: keys and values are texts of one run. Fields
    are told apart by nothing but their texts, so ids may repeat or be null."""
    both = fields.select("extraction_id", F.explode(F.array("field_key", "field_value")).alias("t")).select("extraction_id", normalise(F.col("t")).alias("t"))
    found = match_texts(_texts(both, False), boxes, keep=keep).select("extraction_id", "t", F.struct(*_MATCH).alias("m"))
    out = fields.drop("key_bbox", "value_bbox")
    for part in ("key", "value"):
        named = found.select("extraction_id", F.col("t").alias(f"_{part}"), F.col("m").alias(f"{part}_bbox"))
        out = out.withColumn(f"_{part}", normalise(F.col(f"field_{part}"))).join(_dealt(named), ["extraction_id", f"_{part}"], "left").drop(f"_{part}")
    return out.select(*[c for c in fields.columns if c not in ("key_bbox", "value_bbox")], "key_bbox", "value_bbox")


def _plain(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def match_contains(targets: DataFrame, boxes: Boxes, by_page: bool = False) -> DataFrame:
    """The viewer's plain match: the first line that holds the target or is held by it (as a blank line is by any), else the first
    equal word."""
    keys = _keys(by_page)
    t = targets.where(F.coalesce("target", F.lit("")) != "").withColumn("t", _plain(F.col("target")))
    texts = t.select(*keys, "t").distinct()
    held = F.col("b").contains(F.col("t")) | F.col("t").contains(F.col("b"))
    by_line = texts.join(_dealt(first_boxes(boxes, "line", by_page, _plain, True)), keys).where(held).groupBy(*keys, "t").agg(F.min("box").alias("box"))
    by_line = stored(by_line, "found")
    by_word = _rest(texts, by_line, by_page).join(_dealt(first_boxes(boxes, "word", by_page, _plain).withColumnRenamed("b", "t")), [*keys, "t"])
    return _of_targets(t, by_line.unionByName(by_word).select(*keys, "t", *_found(F.lit(1.0))), by_page)


def page_boxes(boxes: DataFrame, page: int) -> DataFrame:
    return boxes.where((F.col("page_number") == page) & F.col("type").isin("line", "word") & (F.size("polygon") >= 4))


def points(polygon: Column, digits: int = 1) -> Column:
    """`x,y x,y ...`, empty for fewer than four numbers; a last odd number is left out."""
    n = F.floor(F.size(polygon) / 2).cast("int")
    shown = lambda i: F.get(polygon, i).cast(f"decimal(18,{digits})").cast("string")
    return F.when(F.size(polygon) >= 4, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat_ws(",", shown(2 * k), shown(2 * k + 1))), " ")).otherwise("")


def centre_pct(polygon: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The mean of the corners in percent of the page, 8.5 by 11 unless given."""
    mean = lambda k: F.aggregate(F.filter(polygon, lambda v, i: i % 2 == k), F.lit(0.0), lambda a, v: a + v) / F.floor(F.size(polygon) / 2)
    w, h = F.coalesce(width, F.lit(8.5)) if width is not None else F.lit(8.5), F.coalesce(height, F.lit(11.0)) if height is not None else F.lit(11.0)
    return F.struct((mean(0) / w * 100).alias("x"), (mean(1) / h * 100).alias("y"))


def target_page(value_bbox: Column, key_bbox: Column, page: Column) -> Column:
    return F.coalesce(value_bbox["page"], key_bbox["page"], page, F.lit(1))


def page_fields(fields: DataFrame, page: int) -> DataFrame:
    return fields.where(F.col("page_number") == page)


def page_totals(fields: DataFrame) -> DataFrame:
    return fields.groupBy("extraction_id").agg(F.coalesce(F.max("page_number"), F.lit(1)).alias("pages"))


def no_box(fields: DataFrame, either: bool = False) -> DataFrame:
    missing = F.col("value_bbox").isNull()
    return fields.withColumn("no_box", missing & F.col("key_bbox").isNull() if either else missing)
