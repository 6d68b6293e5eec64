"""Matching of texts to boxes against a plain loop over whole documents."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docfields.operators import layout, matching

BOX = "extraction_id int, ordinal int, type string, content string, page_number int, polygon array<double>"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def norm(text):
    return " ".join((text or "").lower().split())


def union(boxes):
    xs, ys = [v for b in boxes for v in b[5][::2]], [v for b in boxes for v in b[5][1::2]]
    return [min(xs), min(ys), max(xs), min(ys), max(xs), max(ys), min(xs), max(ys)]


def plain(target, boxes):
    """(text, confidence, page, polygon) or nothing. Boxes that share an ordinal are taken by page and text."""
    t = norm(target)
    order = lambda b: (b[1], b[4], norm(b[3]), b[3], b[5])
    lines, words = (sorted((b for b in boxes if b[2] == kind and norm(b[3])), key=order) for kind in ("line", "word"))
    if not t:
        return None
    for b in sorted(lines, key=lambda b: (b[1], b[4], b[3])):
        if norm(b[3]) == t:
            return b[3], 1.0, b[4], b[5]
    best, at = 0.0, None
    for b in lines:
        x = norm(b[3])
        r = ratio(t, x)
        if t in x or x in t:
            if r > best:
                best, at = max(r, 0.9), b
        elif r >= 0.85 and r > best:
            best, at = r, b
    if at:
        return at[3], best, at[4], at[5]
    asked = t.split(" ")
    least = 0.85 if len(asked) == 1 else 0.9
    hits = []
    for w in asked:
        if len(asked) > 1 and len(w) < 2:
            continue
        hit = next((b for b in words if norm(b[3]) == w or ratio(norm(b[3]), w) >= least), None)
        if hit:
            hits.append((hit, 1.0 if norm(hit[3]) == w else ratio(norm(hit[3]), w)))
    if not hits or len(hits) < len(asked) * 0.5:
        return None
    if len(asked) == 1:
        b, r = hits[0]
        return b[3], r, b[4], b[5]
    return " ".join(b[3] for b, _ in hits), min(len(hits) / len(asked), 0.95), hits[0][0][4], union([b for b, _ in hits])


def close(a, b):
    return (a is None) == (b is None) and (a is None or (a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and a[2:] == b[2:]))


def documents(seed, n):
    """Boxes and targets of n documents: lines and words of few letters, near copies of them, long lines, ordinals and pages that repeat."""
    rng = random.Random(seed)
    letters = "abcdeé1-" if seed % 2 else "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 6, 9, 14])))

    def spoilt(text):
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(text) + 1)
            text = rng.choice([text[:k] + rng.choice(letters) + text[k:], text[:k] + text[k + 1 :], text[:k] + rng.choice(letters) + text[k + 1 :]])
        return text

    boxes, targets = [], []
    for doc in range(n):
        lines = [" ".join(word() for _ in range(rng.choice([1, 2, 4, 8, 60 if doc % 5 == 0 else 3]))) for _ in range(rng.randrange(1, 9))]
        lines += [spoilt(rng.choice(lines)) for _ in range(3)] + ["", "  ", None]
        for k, line in enumerate(lines):
            page, box = 1 + k % 2, [float(k), float(doc), k + 5.0, float(doc), k + 5.0, doc + 2.0, float(k), doc + 2.0]
            boxes.append((doc, k // 2 if doc % 3 == 0 else k, "line", line and rng.choice([line, line.upper(), f" {line}  "]), page, box))
            boxes += [(doc, 100 * k + j, "word", w, page, [v + j for v in box]) for j, w in enumerate((line or "").split(" "))]
        every = [w for line in lines if line for w in line.split()]
        for k in range(10):
            line = rng.choice([x for x in lines if x and x.strip()])
            some = [spoilt(rng.choice(every)) for _ in range(rng.choice([1, 2, 5]))]
            targets.append((doc, k % 7, rng.choice([line, spoilt(line), line[: len(line) // 2], line + " " + word(), " ".join(some), spoilt(rng.choice(every)), word(), "", None])))
    return boxes, targets


@pytest.mark.parametrize("seed", [1, 2])
def test_text_matches_follow_the_plain_loop(spark, seed):
    boxes, targets = documents(seed, 30)
    b, t = spark.createDataFrame(boxes, BOX), spark.createDataFrame(targets, "extraction_id int, target_id int, target string")
    got = defaultdict(list)
    for r in matching.match_text(t, b).collect():
        got[r.extraction_id, r.target_id].append((r.matched_text, r.confidence, r.page, r.polygon))
    want, by_doc = defaultdict(list), defaultdict(list)
    for box in boxes:
        by_doc[box[0]].append(box)
    for doc, key, target in targets:
        if (m := plain(target, by_doc[doc])) is not None:
            want[doc, key].append(m)
    assert set(got) == set(want)
    for k in want:
        a, b = (sorted(x, key=str) for x in (got[k], want[k]))
        assert len(a) == len(b) and all(map(close, a, b)), (k, a, b)


def test_text_matches_by_page(spark):
    boxes, targets = documents(4, 12)
    pages = [(d, k, t, p) for d, k, t in targets for p in (1, 2)]
    t = spark.createDataFrame(pages, "extraction_id int, target_id int, target string, page_number int").withColumn("target_id", F.struct("target_id", "page_number", "target"))
    got = {(r.extraction_id, *r.target_id): (r.matched_text, r.confidence, r.page, r.polygon) for r in matching.match_text(t, spark.createDataFrame(boxes, BOX), by_page=True).collect()}
    for d, k, target, page in pages:
        assert close(got.get((d, k, page, target)), plain(target, [b for b in boxes if b[0] == d and b[4] == page]))


def test_fields_with_repeated_and_null_ids(spark):
    boxes, targets = documents(6, 12)
    rows = [(d, rng, a, b) for (d, _, a), (d2, _, b) in zip(targets[::2], targets[1::2], strict=True) for rng in (1, None) if d == d2]
    fields = spark.createDataFrame(rows, "extraction_id int, id int, field_key string, field_value string")
    got = matching.match_fields(fields, spark.createDataFrame(boxes, BOX)).collect()
    assert len(got) == len(rows)
    shown = lambda m: m and (m.matched_text, m.confidence, m.page, m.polygon)
    for r in got:
        mine = [b for b in boxes if b[0] == r.extraction_id]
        assert close(shown(r.key_bbox), plain(r.field_key, mine)) and close(shown(r.value_bbox), plain(r.field_value, mine))


def test_bounds_let_no_match_go(spark):
    rng = random.Random(8)
    pairs = set()
    for _ in range(3000):
        a = "".join(rng.choice("abcdefgz09é ") for _ in range(rng.randrange(1, 24)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice([[], ["q"], ["a"]])
        pairs.add((a, "".join(b)))
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    for x in "ab":
        df = df.withColumns({f"n{x}": F.length(x), f"rare{x}": matching.rare_letters(F.col(x), 0.85), f"band{x}": matching.length_band(F.length(x))})
    near, a, b = 0, F.col("na"), F.col("nb")
    for r in df.withColumns({"may": matching.may_reach(a, b, 0.85), "differ": matching.may_differ(a, b, 0.85), "distance": matching.letter_distance(F.col("a"), F.col("b")), "changes": F.levenshtein("a", "b")}).collect():
        if ratio(r.a, r.b) >= 0.85:
            near += 1
            assert r.may and r.distance <= r.differ and r.changes <= r.differ and set(r.rarea) & set(r.rareb) and abs(r.banda - r.bandb) <= 1
    assert near > 300


def test_contained_texts_and_words(spark):
    boxes = [(1, 0, "line", "Total amount due", 1, [0.0] * 8), (1, 1, "line", "Total", 2, [1.0] * 8), (1, 2, "word", "Extra", 3, [2.0] * 8)]
    targets = [(1, 0, "AMOUNT"), (1, 1, "the total of all"), (1, 2, "extra"), (1, 2, "extr"), (1, 3, ""), (1, 4, None), (2, 0, "total")]
    got = matching.match_contains(spark.createDataFrame(targets, "extraction_id int, target_id int, target string"), spark.createDataFrame(boxes, BOX)).collect()
    assert sorted((r.target_id, r.matched_text, r.page) for r in got) == [(0, "Total amount due", 1), (1, "Total", 2), (2, "Extra", 3)]


def test_flattened_boxes_of_several_pages_are_matched(spark):
    polygon = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    page = lambda n, *lines: {"document_id": 1, "page_number": n, "words": [{"content": w, "confidence": 1.0, "polygon": polygon} for x in lines for w in x.split()], "lines": [{"content": x, "polygon": polygon} for x in lines]}
    pages = spark.createDataFrame([page(2, "Name: Ann", "Total 12"), page(1, "Form A", "Total 12")], layout.ANALYSIS)
    boxes = layout.flatten_boxes(pages).withColumnRenamed("document_id", "extraction_id")
    fields = spark.createDataFrame([(1, "total 12", "Ann"), (1, "Form A", "Fomr A and more words there are")], "extraction_id long, field_key string, field_value string")
    got = {r.field_key: (r.key_bbox.page, r.value_bbox and (r.value_bbox.matched_text, r.value_bbox.page)) for r in matching.match_fields(fields, boxes).collect()}
    assert got == {"total 12": (1, ("Name: Ann", 2)), "Form A": (1, None)}


def test_pages_stored_twice(spark):
    pages = spark.createDataFrame([(1, 1, 8.5, "a.png"), (1, 1, 9.5, "b.png"), (1, None, 1.0, "c.png"), (2, None, 1.0, "d.png")], "document_id int, page_number int, page_width_inches double, image_path string").withColumns({c: F.lit(1) for c in ("page_height_inches", "image_width", "image_height")})
    got = {r.document_id: (r.dimensions and r.dimensions.width_inches, r.image_path) for r in layout.page_of(layout.page_maps(pages), 1).collect()}
    assert got == {1: (9.5, "b.png"), 2: (None, None)}
