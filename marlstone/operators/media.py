"""Figures: P15 to P17, A7, F24, and the tagged union of raster and vector figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least side of a figure in pixels, largest ratio of its sides, drawing elements of a page that has one.
LEAST_SIDE, MOST_RATIO, LEAST_ELEMENTS = 64, 8.0, 500


def fingerprint(content: Column) -> Column:
    """the first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 32)


def raster_verdicts(images: DataFrame, *, hash_col: str = "hash") -> DataFrame:
    """Verdict of each image (doc_id, hash, w, h): what repeats within a document is decoration,
    all copies of it; then small ones are glyphs, then narrow ones rulers; the rest figures.

    Copies are counted by an aggregate and joined, so one hash in a third of all rows is no burden.
    """
    copies = images.groupBy("doc_id", hash_col).agg(F.count(F.lit(1)).alias("_copies"))
    ratio = F.greatest(F.try_divide("w", "h"), F.try_divide("h", "w"))
    verdict = F.when(F.col("_copies") > 1, "decoration").when(F.least("w", "h") < LEAST_SIDE, "glyph").when(ratio > MOST_RATIO, "ruler").otherwise("figure")
    return images.join(copies, ["doc_id", hash_col]).withColumn("verdict", verdict).drop("_copies")


def vector_pages(pages: DataFrame) -> DataFrame:
    """Pages (column svg) with more than ``LEAST_ELEMENTS`` drawing elements."""
    elements = F.regexp_count("svg", F.lit(r"<(path|line|rect|circle|ellipse|polygon|polyline)\b"))
    return pages.withColumn("n_elements", elements).where(F.col("n_elements") > LEAST_ELEMENTS)


def caption(text: Column) -> Column:
    """The first line of a page that begins like a caption, null if there is none."""
    # Fixed value: how captions begin.
    found = F.regexp_extract(text, r"(?im)^(Figure|Fig\.|Figura|Tabella|Table)\s*\d+[.:\-]?\s*(.*)$", 0)
    return F.when(found != "", F.trim(found))


def all_figures(raster: DataFrame, vector: DataFrame) -> DataFrame:
    """Both kinds in one table, ``kind`` tells which; fields of the other kind are null."""
    return raster.withColumn("kind", F.lit("raster")).unionByName(vector.withColumn("kind", F.lit("vector")), allowMissingColumns=True)
