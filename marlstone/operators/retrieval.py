"""Search: keyword overlap, passages, shortlists and budgets (T1 to T4, F5, P8, P9), and the
two-stage retrieval by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import lexicons
from marlstone.functions.text import collapsed, keywords, words


#: Rows of query words that are broadcast, at most.
MOST_ASKED = 100_000


def asked_words(queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``query_id, word`` of the queries' keywords, and their distinct words if there are few rows.

    Then the rows are to be broadcast, and documents drop all other words before these become rows;
    of more queries than that nothing is collected, and joins are by hash."""
    asked = queries.select("query_id", F.explode(keywords(F.col("text"))).alias("word"))
    if asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        return asked, None
    return F.broadcast(asked), sorted(r["word"] for r in asked.select("word").distinct().collect())


def _only(found: Column, known: list[str] | None) -> Column:
    return found if known is None else F.filter(found, lambda w: w.isin(known))


def overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, shared, n_chars``: distinct keywords that a query shares with a document.

    queries: query_id and text, a stated set that doesn't grow with the documents. A document's
    pairs are made where it is read, so only these are shuffled, never its words.
    """
    asked, known = asked_words(queries)
    # in two steps, else each word's row would carry the whole text and measure it again
    found = F.array_distinct(_only(words(F.col("text")), known)) if known is not None else keywords(F.col("text"))
    held = docs.select("doc_id", F.length("text").alias("n_chars"), found.alias("words")).select("doc_id", "n_chars", F.explode("words").alias("word"))
    return held.join(asked, "word").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n_chars").alias("n_chars"))


def top(scored: DataFrame, by: str, score: Column, tie: str, most: int) -> DataFrame:
    """The ``most`` rows of each ``by`` with the highest score, and ``pos`` from 0."""
    order = Window.partitionBy(by).orderBy(score.desc(), tie)
    # the filter is on the bare row number, so that Spark drops rows beyond it before they are shuffled
    first = scored.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most)
    return first.withColumn("pos", (F.col("_nth") - 1).cast("long")).drop("_nth")


def paragraphs(text: Column, least: int = 80) -> Column:
    """Trimmed lines of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)


def paragraph_score(paragraph: Column, keys: Column, pos: Column, n: Column) -> Column:
    """Shared keywords against the length, and a bonus for coming early; 0 for boilerplate."""
    shared = F.size(F.array_intersect(keys, keywords(paragraph)))
    score = shared / (1 + F.length(paragraph) / 800) + 0.35 * (1 - pos / F.greatest(n, F.lit(1)))
    return F.when(paragraph.rlike(f"(?i){lexicons.BOILERPLATE}"), 0.0).otherwise(score)


def packed_passages(text: Column, keys: Column, all_: Column, most: int) -> Column:
    """The text's best paragraphs for a query in their own order, ``most`` characters at most.

    keys and all_: columns with the query's keywords and the text's paragraphs, made in a step
    before so that they aren't made again for each paragraph. Paragraphs are tried by score (in
    order if there are no keywords); one that doesn't fit is skipped, and above four fifths the
    packing ends. If none fits, the best one is cut; if there is none, the text.
    """

    def rank(p: Column, i: Column) -> Column:
        score = F.when(F.size(keys) > 0, paragraph_score(p, keys, i, F.size(all_))).otherwise(F.lit(0.0))
        # the first place of an equal paragraph is its place in the output
        return F.struct((-score).alias("key"), i.alias("i"), F.array_position(all_, p).cast("int").alias("place"), p.alias("p"))

    ranked = F.array_sort(F.transform(all_, rank))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"), F.expr("cast(array() as array<struct<place:int,i:int,p:string>>)").alias("held"))

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + F.length(x["p"])
        taken = F.struct(total.alias("total"), (total > 0.8 * most).alias("done"), F.concat(s["held"], F.array(F.struct(x["place"].alias("place"), x["i"].alias("i"), x["p"].alias("p")))).alias("held"))
        return F.when(s["done"] | (total > most), s).otherwise(taken)

    held = F.aggregate(ranked, start, step, lambda s: F.array_sort(s["held"]))
    return (
        F.when(F.size(all_) == 0, F.substring(collapsed(text), 1, most))
        .when(F.size(held) == 0, F.substring(collapsed(F.get(ranked, 0)["p"]), 1, most))
        .otherwise(F.array_join(F.transform(held, lambda x: x["p"]), "\n\n"))
    )


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_storefront(url: Column) -> Column:
    """A url without a path."""
    return F.trim(url_path(url), F.lit("/")) == ""


def site(url: Column) -> Column:
    """The url's host and port without a leading ``www.``; empty if it has none."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r"^www\.", "")


def shortlist(results: DataFrame, *, by: str, seen: int = 12, most: int = 3) -> DataFrame:
    """Of each ``by``'s first ``seen`` results (columns pos, url) one a site, storefronts
    last, ``most`` of them; ``place`` from 1."""
    first = results.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("_nth") <= seen)
    first = first.withColumn("site", site(F.col("url"))).withColumn("storefront", is_storefront(F.col("url"))).where("site != ''")
    once = first.withColumn("_of_site", F.row_number().over(Window.partitionBy(by, "site").orderBy("storefront", "pos"))).where("_of_site = 1")
    out = once.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("storefront", "pos"))).where(F.col("place") <= most)
    return out.withColumn("place", F.col("place").cast("long")).drop("_nth", "_of_site")


def budgeted(blocks: DataFrame, *, by: str, most: int = 1400) -> DataFrame:
    """T4: each ``by``'s blocks (columns pos, block) joined by line ends until one would exceed
    ``most`` characters, the first one in any case, then cut there."""
    order = Window.partitionBy(by).orderBy("pos")
    so_far = blocks.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # lengths are positive, so the first that exceeds is followed by none that fits
    kept = so_far.where((F.col("_sum") <= most) | (F.col("_n") == 1))
    held = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("n_blocks"), F.substring(F.array_join(F.transform(held, lambda x: x["block"]), "\n"), 1, most).alias("body"))


def bm25(queries: DataFrame, pieces: DataFrame, *, key: str, least: float = 0.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, key, score`` of the pieces (columns key and text) that score above ``least``;
    none, rather than the least bad, if none does.

    Statistics cover all pieces; only words of queries are joined.
    """
    asked, known = asked_words(queries)
    tokens = pieces.select(key, words(F.col("text")).alias("words")).select(key, F.size("words").alias("size"), _only(F.col("words"), known).alias("words"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    each = tokens.select(key, "size", F.explode("words").alias("word"))
    if known is None:
        each = each.join(asked.select("word").distinct(), "word", "left_semi")
    counted = each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    df = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # a row for each word of the queries at most
    met = counted.join(df if known is None else F.broadcast(df), "word").join(asked, "word").crossJoin(F.broadcast(stats))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    # rounded parts add up to the same sum in any order
    return met.groupBy("query_id", key).agg((F.sum(F.round(part * 1e6).cast("long")) / 1e6).alias("score")).where(F.col("score") > least)
