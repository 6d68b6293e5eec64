"""Text and number helpers as columns. Blanks are Unicode white space, as in the rules these columns express."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.85, 0.60


#: All characters that count as white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalise(c: Column) -> Column:
    """Trimmed, lower-cased, with single spaces; null becomes empty. Most texts have nothing to replace, which a look for
    two spaces or for characters in ranges that hold all other blanks tells faster."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(low.rlike(r"  |[\x00-\x1f\x85\xa0\u1680\u2000-\u3000]"), F.regexp_replace(low, r"(?U)\s+", " ")).otherwise(low)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def percent(c: Column) -> Column:
    return (c * 100).cast("int")


def confidence_level(c: Column) -> Column:
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def confidence_icon(c: Column) -> Column:
    """A green, yellow or red circle."""
    return F.when(c >= HIGH, "🟢").when(c >= MEDIUM, "🟡").otherwise("🔴")


def ratio_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent, half to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(0.0)


def file_size(c: Column) -> Column:
    """1024 steps, one decimal, ties to even; null for null or 0."""
    size = c.cast("double")
    shown = lambda x, unit: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    out = F.when(size < 1024, shown(size, "B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (k + 1), shown(size / 1024**k, unit))
    return F.when(c.isNotNull() & (c != 0), out.otherwise(shown(size / 1024**4, "TB")))


def display_status(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
