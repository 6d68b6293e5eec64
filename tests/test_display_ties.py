"""Sizes halfway between two tenths go to the even one, as printf's do."""

from pyspark.sql import functions as F

from docfields.functions import text
from docfields.sources import files


def test_sizes_at_ties(spark):
    df = spark.createDataFrame([(948480,), (948736,), (1280,), (1792,), (1629440,)], "s long")
    assert [r[0] for r in df.select(text.file_size(F.col("s"))).collect()] == ["926.2 KB", "926.5 KB", "1.2 KB", "1.8 KB", "1.6 MB"]
    large = df.limit(1).select(files.check_upload(F.lit("a.pdf"), F.lit(int(25.25 * 1024 * 1024))).alias("v")).first().v
    assert large.message == "File too large (25.2MB). Maximum: 20MB"
