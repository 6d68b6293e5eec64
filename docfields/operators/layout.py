"""OCR layout: boxes, page assembly, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POLY = "array<double>"
REGION = f"struct<page_number:int,polygon:{_POLY}>"
#: One analysed page of a document.
ANALYSIS = (
    f"document_id long, page_number int, words array<struct<content:string,confidence:double,polygon:{_POLY}>>, lines array<struct<content:string,polygon:{_POLY}>>, "
    f"selection_marks array<struct<state:string,confidence:double,polygon:{_POLY}>>, "
    f"tables array<struct<row_count:int,column_count:int,regions:array<{REGION}>,cells:array<struct<content:string,row_index:int,column_index:int,regions:array<{REGION}>>>>>, "
    f"paragraphs array<struct<content:string,role:string,regions:array<{REGION}>>>"
)
BOX = "type string, content string, confidence double, polygon array<double>, page_number int, state string, table_index int, row_count int, column_count int, row_index int, column_index int, role string"
ORDINAL = "struct<page:int,kind:int,o0:int,o1:int,o2:int>"


def flatten_boxes(analyses: DataFrame, kinds: tuple[str, ...] = ("word", "line", "selection_mark", "table", "table_cell", "paragraph")) -> DataFrame:
    """Words, lines, selection marks, tables, cells and paragraphs of each page as boxes, with `odd_polygon` where the polygon
    has an odd length. Tables and cells give a box for each of their regions on the page; paragraphs one for the first, their
    content cut to 100 characters and `...`. `ordinal` orders a document's boxes, by page, kind and place. `kinds` says which to make.
    A page's boxes are one array, so analyses are read once, whatever kinds are made."""
    p, zero = F.col("page_number"), F.lit(0)
    here = lambda regions: F.filter(regions, lambda r: r["page_number"] == p)
    fields = [x.split(" ", 1) for x in BOX.split(", ")]
    none = F.array().cast(f"array<struct<{fields[0][0]}:{fields[0][1]},ordinal:{ORDINAL},{','.join(f'{n}:{t}' for n, t in fields[1:])}>>")

    def box(kind: str, rank: int, order: list[Column], given: dict[str, Column]) -> Column:
        ordinal = F.struct(p.cast("int").alias("page"), F.lit(rank).alias("kind"), *[o.cast("int").alias(f"o{k}") for k, o in enumerate(order)])
        made = given | {"page_number": p}
        return F.struct(F.lit(kind).alias("type"), ordinal.alias("ordinal"), *[made.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields[1:]])

    def each(array: Column, f) -> Column:
        return F.coalesce(F.transform(array, f), none)

    def every(array: Column, f) -> Column:
        return F.coalesce(F.flatten(F.transform(array, f)), none)

    def cell(c: Column, at: Column, c_at: Column) -> Column:
        return each(here(c["regions"]), lambda r, k: box("table_cell", 4, [at, c_at, k], {"content": c["content"], "polygon": r["polygon"], "table_index": at, "row_index": c["row_index"], "column_index": c["column_index"]}))

    def paragraph(x: Column, at: Column) -> Column:
        content = F.when(F.length(x["content"]) > 100, F.concat(F.substring(x["content"], 1, 100), F.lit("..."))).otherwise(x["content"])
        return F.when(F.size(here(x["regions"])) > 0, box("paragraph", 5, [at, zero, zero], {"content": content, "polygon": F.get(here(x["regions"]), F.lit(0))["polygon"], "role": F.coalesce(x["role"], F.lit("text"))}))

    made = {
        "word": lambda: each(F.col("words"), lambda x, at: box("word", 0, [at, zero, zero], {"content": x["content"], "confidence": x["confidence"], "polygon": x["polygon"]})),
        "line": lambda: each(F.col("lines"), lambda x, at: box("line", 1, [at, zero, zero], {"content": x["content"], "polygon": x["polygon"]})),
        "selection_mark": lambda: each(F.col("selection_marks"), lambda x, at: box("selection_mark", 2, [at, zero, zero], {"state": x["state"], "confidence": x["confidence"], "polygon": x["polygon"]})),
        "table": lambda: every(F.col("tables"), lambda x, at: each(here(x["regions"]), lambda r, k: box("table", 3, [at, k, zero], {"polygon": r["polygon"], "table_index": at, "row_count": x["row_count"], "column_count": x["column_count"]}))),
        "table_cell": lambda: every(F.col("tables"), lambda x, at: every(x["cells"], lambda c, c_at: cell(c, at, c_at))),
        "paragraph": lambda: F.array_compact(each(F.col("paragraphs"), paragraph)),
    }
    parts = [made[k]() for k in kinds]
    out = analyses.select("document_id", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("x")).select("document_id", "x.*")
    return out.withColumn("odd_polygon", F.coalesce(F.size("polygon") % 2 == 1, F.lit(False)))


def page_counts(analyses: DataFrame) -> DataFrame:
    n = lambda a: F.greatest(F.size(a), F.lit(0))
    return analyses.select("document_id", "page_number", n("words").alias("words"), n("lines").alias("lines"), n("tables").alias("tables"), n("paragraphs").alias("paragraphs"))


def combine_pages(pages: DataFrame, kind: str = "markdown") -> DataFrame:
    """One text for each document from its non-empty pages in order. Markdown gets `## Page n` headings if the document has more
    than one page, empty ones included; HTML a section for each page then."""
    gathered = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce(kind, F.lit("")).alias("text")))).alias("p"))
    full = F.filter("p", lambda x: x["text"] != "")
    plain = F.transform(full, lambda x: x["text"])
    if kind == "html":
        parts = F.transform(full, lambda x: F.concat(F.lit('<section data-page="'), x["page_number"].cast("string"), F.lit('">\n'), x["text"], F.lit("\n</section>")))
        return gathered.select("document_id", F.array_join(F.when(F.size("p") > 1, parts).otherwise(plain), "\n<hr>\n").alias("html"))
    headed = F.transform(full, lambda x: F.concat(F.lit("## Page "), x["page_number"].cast("string"), F.lit("\n\n"), x["text"]))
    return gathered.select("document_id", F.array_join(F.when(F.size("p") > 1, headed).otherwise(plain), "\n\n---\n\n").alias("markdown"))


def html_div(c: Column) -> Column:
    return F.concat(F.lit("<div class='ocr-content'>\n"), c, F.lit("\n</div>"))


def document_rollup(pages: DataFrame) -> DataFrame:
    """Pages, time and success of each document and, if pages have `layout_boxes`, the boxes of all its pages in their order."""
    boxes = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("layout_boxes", F.array()).alias("b")))), lambda x: x["b"])).alias("layout_boxes")] if "layout_boxes" in pages.columns else []
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("processing_time_ms").alias("total_ms"), F.bool_and("success").alias("success"), *boxes).withColumn("error", F.when(~F.col("success"), "Some pages failed"))


def page_maps(pages: DataFrame) -> DataFrame:
    """Dimensions and image paths of each document by page number as text. Of a page that is stored more than once the greatest
    row counts (dimensions, then path); pages without a number have no entry."""
    key = F.col("page_number").cast("string")
    dims = F.struct(F.col("page_width_inches").alias("width_inches"), F.col("page_height_inches").alias("height_inches"), F.col("image_width").alias("image_width_px"), F.col("image_height").alias("image_height_px"))
    once = pages.where("page_number IS NOT NULL").groupBy("document_id", key.alias("key")).agg(F.max(F.struct(dims.alias("dims"), "image_path")).alias("p"))
    maps = once.groupBy("document_id").agg(*[F.map_from_entries(F.collect_list(F.struct("key", f"p.{c}"))).alias(n) for c, n in (("dims", "page_dimensions"), ("image_path", "image_paths"))])
    return pages.select("document_id").distinct().join(maps, "document_id", "left")


def page_of(maps: DataFrame, page: int) -> DataFrame:
    return maps.select("document_id", F.try_element_at("page_dimensions", F.lit(str(page))).alias("dimensions"), F.try_element_at("image_paths", F.lit(str(page))).alias("image_path"))


def reading_order(blocks: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Text blocks (document_id, page_number, ordinal, text, confidence, box of 4 corners) -> lines (line_no, text, confidence, y)."""
    one = F.struct("ordinal", "text", "confidence", "box")
    return lines_of_pages(blocks.groupBy("document_id", "page_number").agg(F.collect_list(one).alias("blocks")), tolerance)


def lines_of_pages(pages: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Pages (document_id, page_number, blocks: array of ordinal, text, confidence, box) -> lines, as reading_order has them. No row
    leaves its page, so there is no exchange.

    Blocks are taken from the top; one starts a new line if its centre is further from the running mean of the current line's
    centres than `tolerance` times the page's mean height. A page is one fold over its blocks that keeps where lines start; lines are then
    cut out of the page's blocks."""

    def placed(b: Column) -> Column:
        y, x = (b["box"][0][1] + b["box"][2][1]) / 2, F.array_min(F.transform(b["box"], lambda p: p[0]))
        return F.struct(y.alias("y"), b["ordinal"].alias("ordinal"), x.alias("x"), b["text"].alias("text"), b["confidence"].alias("confidence"))

    heights = F.array_compact(F.transform("blocks", lambda b: F.abs(b["box"][2][1] - b["box"][0][1])))
    pages = pages.select("document_id", "page_number", F.sort_array(F.transform("blocks", placed)).alias("b"), (_mean(heights) * tolerance).alias("tol"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, e: Column) -> Column:
        new = (acc["n"] == 0) | (F.abs(e["y"] - acc["total"] / acc["n"]) > F.col("tol"))
        return F.struct((acc["at"] + 1).alias("at"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, e["y"]).otherwise(acc["total"] + e["y"]).alias("total"), F.when(new, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"))

    pages = pages.withColumn("starts", F.aggregate("b", start, step, lambda acc: acc["starts"]))
    ends = F.array_append(F.slice("starts", F.lit(2), F.size("starts")), F.size("b"))

    def line(z: Column, at: Column) -> Column:
        xs = F.slice("b", z["starts"] + 1, z["ends"] - z["starts"])
        texts = F.sort_array(F.transform(xs, lambda e: F.struct(e["x"].alias("x"), e["ordinal"].alias("ordinal"), e["text"].alias("text"))))
        of = lambda name: F.array_compact(F.transform(xs, lambda e: e[name]))
        return F.struct(_mean(of("y")).alias("y"), at.alias("line"), F.array_join(F.transform(texts, lambda s: s["text"]), " ").alias("text"), _mean(of("confidence")).alias("confidence"))

    lines = F.sort_array(F.transform(F.arrays_zip("starts", ends.alias("ends")), line))
    return pages.select("document_id", "page_number", F.posexplode(lines).alias("at", "x")).select("document_id", "page_number", "x.text", "x.confidence", "x.y", (F.col("at") + 1).alias("line_no"))


def _mean(numbers: Column) -> Column:
    """The mean of an array of numbers; null for none."""
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / F.size(numbers))


def format_lines(lines: DataFrame, with_confidence: bool = False) -> DataFrame:
    """`01. text` or `01. [0.98] text`, one text for each page."""
    shown = F.format_string("%02d. [%.2f] %s", "line_no", "confidence", "text") if with_confidence else F.format_string("%02d. %s", "line_no", "text")
    return lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", shown.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
