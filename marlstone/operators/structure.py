"""Documents as sections, figures and links: W1 to W3, W8, W9, A6, C1, C2, J1, J2, J5, J3, J4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import title_form

#: Fixed value: a title that already has a number.
NUMBERED = r"^\d+(\.\d+)*\.?\s+"


def body_size(lines: DataFrame) -> DataFrame:
    """``doc_id, body``: the font size of most characters; of equals the first in the text."""
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("_w"), F.min("seq").alias("_first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("_w", -F.col("_first"))).alias("body"))


def sections(lines: DataFrame, *, bigger: float = 1.25, least: int = 80) -> DataFrame:
    """``doc_id, seq, page, size, title, under, is_title, kept, level``: headings by font size.

    lines: doc_id, seq, page, size, text. A heading is a line of two characters or more in at
    least ``bigger`` times the body's size; the text under it is that of smaller lines up to the next one, and below
    ``least`` characters it is no section (kept false, level null). is_title: the first heading, if
    it is on page 1 and none is larger, names the document and is no section either. level: rank
    of its size among kept ones, the largest first.
    """
    marked = lines.join(body_size(lines), "doc_id").withColumn("_head", (F.col("size") >= bigger * F.col("body")) & (F.length("text") > 1))
    order = Window.partitionBy("doc_id").orderBy("seq")
    islands = marked.withColumn("_island", F.sum(F.col("_head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_island > 0")
    under = F.sum(F.when(F.col("size") < bigger * F.col("body"), F.length("text")).otherwise(0))
    found = islands.groupBy("doc_id", "_island").agg(F.min("seq").alias("seq"), under.cast("long").alias("under"), F.min_by(F.struct("page", "size", "text"), "seq").alias("_h"))
    first = (F.col("_island") == 1) & (F.col("_h.page") == 1) & (F.col("_h.size") == F.max("_h.size").over(Window.partitionBy("doc_id")))
    found = found.withColumn("is_title", first).select("doc_id", "seq", "_h.page", "_h.size", F.col("_h.text").alias("title"), "under", "is_title", ((F.col("under") >= least) & ~F.col("is_title")).alias("kept"))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "kept").orderBy(F.desc("size"))).cast("long")
    return found.withColumn("level", F.when(F.col("kept"), rank))


def with_end_pages(found: DataFrame, pages: Column | str) -> DataFrame:
    """page_end: the page before the next section's, but not before its own; the last one ends with the document."""
    following = F.lead("page").over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.withColumn("page_end", F.greatest("page", F.coalesce(following - 1, F.col(pages) if isinstance(pages, str) else pages)))


def numbered(found: DataFrame, *, own: str | None = NUMBERED) -> DataFrame:
    """Number: chapters with parts below count from 1; one without has none and makes the
    count begin anew. Titles that have numbers get none and count nothing; those match ``own``, and
    with None each title counts, as where digits that begin one are no section's number.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    kid = (F.col("level") == 1) & (F.lead("level", 1, 1).over(order) > 1)
    counted = found.withColumn("_kid", kid).withColumn("_own", F.lit(True) if own is None else ~F.col("title").rlike(own))

    def running(column: Column, *keys: str) -> Column:
        return F.sum(F.when(column, 1).otherwise(0)).over(Window.partitionBy("doc_id", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))

    own = F.col("_own")
    counted = counted.withColumn("_island", running(own & (F.col("level") == 1) & ~F.col("_kid"))).withColumn("_chapter", running(own & (F.col("level") == 1)))
    counted = counted.withColumn("_cap", running(own & F.col("_kid"), "_island")).withColumn("_sub", running(own & (F.col("level") == 2), "_chapter"))
    counted = counted.withColumn("_subsub", running(own & (F.col("level") > 2), "_chapter", "_sub"))
    text = (
        F.when(~own | (F.col("_cap") == 0), None)
        .when(F.col("level") == 1, F.when(F.col("_kid"), F.col("_cap").cast("string")))
        .when(F.col("level") == 2, F.concat_ws(".", F.col("_cap").cast("string"), F.col("_sub").cast("string")))
        .when(F.col("_sub") > 0, F.concat_ws(".", F.col("_cap").cast("string"), F.col("_sub").cast("string"), F.col("_subsub").cast("string")))
    )
    return counted.withColumn("number", text).drop("_kid", "_own", "_island", "_chapter", "_cap", "_sub", "_subsub")


def named(found: DataFrame, label: Column | str, *, counted: bool = False) -> DataFrame:
    """Name: label, number and title; a repeated one gets `` (2)``, `` (3)`` and so on, the first
    that no section before it has. A document's sections are few, so their names are one array.
    counted: how often the name came up to there instead, even if a title itself ends like that."""
    base = title_form(F.concat_ws(" ", label, "number", "title"))
    based = found.withColumn("_base", base)
    if counted:
        nth = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("seq"))
        each = based.withColumn("_nth", nth)
        return each.withColumn("name", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit(" ("), F.col("_nth").cast("string"), F.lit(")")))).drop("_base", "_nth")
    held = based.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "_base"))).alias("_all"))

    def step(used: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.format_string("%s (%d)", x["_base"], k))
        return F.concat(used, F.array(F.when(~F.array_contains(used, x["_base"]), x["_base"]).otherwise(F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), 0))))

    names = F.aggregate("_all", F.expr("cast(array() as array<string>)"), step)
    each = held.select("doc_id", F.inline(F.arrays_zip(F.transform("_all", lambda x: x["seq"]).alias("seq"), names.alias("name"))))
    return based.drop("_base").join(each, ["doc_id", "seq"])


def figures_of_sections(figures: DataFrame, found: DataFrame) -> DataFrame:
    """Figures with the sections whose pages hold theirs, by an equal join on document and page:
    a section stands on each of its pages, so no pair is tried in vain."""
    pages = found.select("doc_id", F.col("seq").alias("section"), F.explode(F.sequence("page", "page_end")).alias("page"))
    return figures.join(pages, ["doc_id", "page"])


def captioned(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """Figures with the caption of their page, empty where there is none."""
    return figures.join(captions, ["doc_id", "page"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def links(notes: DataFrame) -> DataFrame:
    """``note, target``: what [[links]] of the notes (note, body) name; escaped brackets are none."""
    found = F.regexp_extract_all("body", F.lit(r"(?<!\\)\[\[([^\]|#]+?)(?<!\\)\]\]"), F.lit(1))
    return notes.select("note", F.explode(found).alias("target")).withColumn("target", F.trim("target"))


def resolved_links(notes: DataFrame, known: DataFrame) -> DataFrame:
    """``note, n_links, n_resolved, orphans``; known: the column target, of all notes there are."""
    met = links(notes).join(known.select("target").distinct().withColumn("_known", F.lit(True)), "target", "left")
    return met.groupBy("note").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("_known").alias("n_resolved"), F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("target")))).alias("orphans"))


def pending(work: DataFrame, done: DataFrame, *, keys: list[str]) -> DataFrame:
    """What is neither done nor left out on purpose; with a fingerprint among the keys, also
    what has changed since."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def next_pending(work: DataFrame, done: DataFrame, *, keys: list[str], by: str, order: str) -> DataFrame:
    """Of each ``by`` the first pending piece."""
    left = pending(work, done, keys=keys)
    return left.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_nth = 1").drop("_nth")


def upper_median(values: DataFrame, *, by: str, value: str) -> DataFrame:
    """A2: ``by, n, upper_median``: of an even number of values the larger middle one.

    From counts of distinct values, so that no group's values meet in one place.
    """
    counts = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(by).orderBy(value)
    so_far = counts.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    return so_far.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(by).agg(F.first("_all").alias("n"), F.min(value).alias("upper_median"))


def numeric_pages(text: Column) -> Column:
    """A1: characters that are no white space."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def outline_or_sizes(outline: DataFrame, by_size: DataFrame, *, least: int = 3) -> DataFrame:
    """A document's outline entries if there are ``least`` or more, else its sections by size.
    Both: doc_id, seq, page, title, level."""
    enough = outline.groupBy("doc_id").count().where(F.col("count") >= least).select("doc_id")
    columns = ["doc_id", "seq", "page", "title", "level"]
    return outline.join(enough, "doc_id", "left_semi").select(*columns).unionByName(by_size.join(enough, "doc_id", "left_anti").select(*columns))


def document_report(pages: DataFrame, found: DataFrame, verdicts: DataFrame, captions: DataFrame, *, least: int) -> DataFrame:
    """Counts for each document that has pages.

    pages: doc_id, page, chars; found: as ``sections`` gives it; verdicts: doc_id, page, verdict of
    each image; captions: doc_id, page of pages that have one; least: the gate of P14.
    """
    told = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.sum("chars").alias("n_chars"))
    middle = upper_median(pages, by="doc_id", value="chars").select("doc_id", "upper_median", (F.col("upper_median") >= least).alias("has_text"))
    cut = found.groupBy("doc_id").agg(F.count_if("kept").alias("n_sections"), F.count_if(~F.col("kept") & ~F.col("is_title")).alias("n_dropped"), F.max(F.when(F.col("is_title"), F.col("title"))).alias("title"))
    shown = verdicts.join(captions.withColumn("_told", F.lit(True)), ["doc_id", "page"], "left")
    is_ = lambda v: F.col("verdict") == v
    figures = shown.groupBy("doc_id").agg(*[F.count_if(is_(v)).alias(f"n_{v}s") for v in ("figure", "decoration", "glyph", "ruler")], F.count_if(is_("figure") & F.col("_told")).alias("n_captioned"))
    out = told.join(middle, "doc_id").join(cut, "doc_id", "left").join(figures, "doc_id", "left")
    counts = ("n_sections", "n_dropped", "n_figures", "n_decorations", "n_glyphs", "n_rulers", "n_captioned")
    return out.fillna(0, list(counts)).select("doc_id", "n_pages", "n_chars", "upper_median", "has_text", *counts[:2], "title", (F.col("n_sections") > 0).alias("structured"), *counts[2:], (F.col("n_figures") - F.col("n_captioned")).alias("n_uncaptioned"))
