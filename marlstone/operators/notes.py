"""Notes and pages as text, and what is told about turns: K1 to K3, K7, F19, F27 to F29, J12, P20,
A18, T7, T10, W14, S5; and operations that were planned beside them: validity of facts, echoes,
two-stage retrieval, overlapping sections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import words
from marlstone.operators import geometry, retrieval

#: Fixed value: prompt tokens from which a conversation is near its limit.
NEAR_LIMIT = 52000
#: Fixed value: share of blocks above which a rewritten note says so.
MUCH_BLOCKS = 0.50


def _json(text: Column) -> Column:
    """A JSON string."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def pages_of(page: Column, page_end: Column) -> Column:
    return F.when(page_end > page, F.concat_ws("-", page.cast("string"), page_end.cast("string"))).otherwise(page.cast("string"))


def section_note(document: Column, number: Column, title: Column, page: Column, page_end: Column, extract: Column) -> Column:
    """K2: a section's note; the extract's double brackets are escaped, an empty one is left out."""
    name, shown = document.cast("string"), F.replace(F.replace(extract, F.lit("[["), F.lit("\\[\\[")), F.lit("]]"), F.lit("\\]\\]"))
    lines = [
        F.lit("---\ntipo: nota-sezione"),
        F.concat(F.lit('documento: "[['), name, F.lit(']]"')),
        F.concat(F.lit("sezione: "), number.cast("string")),
        F.concat(F.lit("titolo: "), _json(title)),
        F.concat(F.lit("pagina: "), page.cast("string")),
        F.concat(F.lit("pagina_fine: "), page_end.cast("string")),
        F.concat(F.lit("---\n\n# "), title),
        F.concat(F.lit("\nDocumento: [["), name, F.lit("]]")),
        F.concat(F.lit("Pagina: "), pages_of(page, page_end)),
        F.when(extract != "", F.concat(F.lit("\n> "), shown)),
    ]
    return F.concat_ws("\n", *lines)


def rewritten_note(note: Column, title: Column, points: Column, body: Column, material: Column, unknown: Column, share: Column) -> Column:
    """K3: the note's front matter with what is measured, and the rewritten section below it.

    points: array of key points; unknown: array of numbers that the source lacks; share: of blocks.
    """
    front = F.regexp_extract(note, r"(?s)^---\n(.*?)\n---\n", 1)
    much = share > MUCH_BLOCKS
    held = [
        F.concat(F.lit("---\n"), front),
        F.concat(F.lit("numeri_non_verificati: "), F.size(unknown).cast("string")),
        F.concat(F.lit("frazione_segnaposti: "), F.format_string("%.4f", share)),
        F.when(much, F.lit("avviso_segnaposti: true")),
        F.concat(F.lit("---\n\n# "), title),
        F.lit("\n## In breve"),
        F.when(F.size(points) > 0, F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n")).otherwise("- (punti chiave non disponibili)"),
        F.concat(F.lit("\n## La spiegazione\n\n"), F.trim(body)),
        F.when(material != "", F.concat(F.lit("\n## Materiale originale\n\n"), material)),
        F.when(F.size(unknown) > 0, F.concat(F.lit("\n⚠ "), F.size(unknown).cast("string"), F.lit(" numeri non verificati"))),
    ]
    return F.concat_ws("\n", *held)


def page_body(prose: Column, tables: Column, formulas: Column, page: Column) -> Column:
    """a page's prose, then its tables and formulas (arrays of texts) in fences."""

    def fenced(kind: str, texts: Column) -> Column:
        kept = F.filter(texts, lambda t: t != "")
        return F.transform(kept, lambda t, i: F.concat(F.lit(f"<!-- {kind} pag "), page.cast("string"), F.lit(" blocco "), (i + 1).cast("string"), F.lit(" -->\n\n```\n\n"), t, F.lit("\n\n```")))

    return F.array_join(F.concat(F.filter(F.array(prose), lambda p: p != ""), fenced("tabella", tables), fenced("formula", formulas)), "\n\n")


def missing_pages(pages: DataFrame, written: DataFrame) -> DataFrame:
    """K1: pages that are still to be written; pages are keyed by document and number."""
    return pages.join(written.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def facts_note(found: DataFrame) -> DataFrame:
    """K7: ``conv_id, body``: a conversation's facts, then how many sentences went for which reason.
    found: as ``facts.facts`` gives it."""
    kept = F.array_sort(F.collect_list(F.when(F.col("kind") != "discarded", F.struct("turn", "seq", "sentence"))))
    each = found.groupBy("conv_id").agg(kept.alias("kept"), F.count_if(F.col("kind") == "discarded").alias("n_discarded"))
    counted = found.where("kind = 'discarded'").groupBy("conv_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    told = counted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    facts = F.transform("kept", lambda x: F.concat(F.lit('- "'), x["sentence"], F.lit('" — msg_id='), x["turn"].cast("string")))
    reasons = F.transform("reasons", lambda x: F.concat(F.lit("- "), x["reason"], F.lit(": "), x["n"].cast("string")))
    body = F.concat_ws("\n", F.concat(F.lit("- fatti estratti: "), F.size("kept").cast("string")), F.concat(F.lit("- frasi scartate: "), F.col("n_discarded").cast("string")), F.lit("\n## Fatti\n"), F.array_join(facts, "\n"), F.when(F.col("reasons").isNotNull(), F.concat(F.lit("\n## Scartate\n\n"), F.array_join(reasons, "\n"))))
    return each.join(told, "conv_id", "left").select("conv_id", body.alias("body"))


def characters(text: Column) -> Column:
    """characters without comments and white space."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"\s+", ""))


def words_in_box(words_: DataFrame, boxes: DataFrame) -> DataFrame:
    """``doc_id, page, block, body``: the words within each box (x0, y0, x1, y1), line by line."""
    met = boxes.select("doc_id", "page", "block", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).join(words_, ["doc_id", "page"])
    inside = met.where("x0 >= b_x0 and x1 <= b_x1 and y0 >= b_y0 and y1 <= b_y1")
    lines = inside.groupBy("doc_id", "page", "block", "y0").agg(F.array_sort(F.collect_list(F.struct("x0", "txt"))).alias("ws"))
    held = F.array_sort(F.collect_list(F.struct("y0", F.array_join(F.transform("ws", lambda w: w["txt"]), " ").alias("line"))))
    return lines.groupBy("doc_id", "page", "block").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("body"))


def image_of(photos: Column, document_kind: Column, document: Column) -> Column:
    """the last photo of a message, else its document if that is an image."""
    return F.coalesce(F.when(F.size(photos) > 0, F.try_element_at(photos, F.lit(-1))), F.when(document_kind.startswith("image/"), document))


def turn_measures(turns: DataFrame) -> DataFrame:
    """The cached share in percent (0 without a prompt), whether the limit is near, and
    tokens a second (0 for no time). turns: prompt, cached, generated, seconds."""
    return turns.withColumn("cached_percent", F.coalesce(F.try_divide(100.0 * F.col("cached"), F.col("prompt")), F.lit(0.0))).withColumn("near_limit", F.col("prompt") >= NEAR_LIMIT).withColumn("tokens_s", F.coalesce(F.try_divide("generated", "seconds"), F.lit(0.0)))


def diary_detail(text: Column, final: Column, most: int = 300) -> Column:
    """Long texts are cut, but for those that end a run."""
    return F.when(~final & (F.length(text) > most), F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def tail(rows: DataFrame, *, by: str, order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows of each ``by``."""
    last = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= most).drop("_nth")


def styled_lines(pieces: DataFrame | geometry.Laid) -> DataFrame:
    """``doc_id, page, line, top, size, text`` of pieces (doc_id, page, top, left_, width,
    height, size, text), or of texts that are set on pages.

    Pieces join a line while their baselines lie within 0.4 mean heights (0.5 at least) of the
    piece before; they are set close where the gap is up to 1.5, else a space apart.
    """
    if isinstance(pieces, DataFrame):
        x0, y0 = F.col("left_").cast("double"), F.col("top").cast("double")
        pieces = pieces.select("doc_id", "page", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("width")).alias("x1"), (y0 + F.col("height")).alias("y1"), "size", F.col("text").alias("txt")).where("txt is not null")
    return geometry.by_page(pieces, "line long, top double, size double, text string", _styled)


def _in_order(first: np.ndarray, second: np.ndarray, texts: list[str]) -> np.ndarray:
    """Numbers of pieces by two values, and by text where both are equal."""
    order = np.lexsort((second, first))
    if ((np.diff(first[order]) == 0) & (np.diff(second[order]) == 0)).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (first[i], second[i], texts[i])))
    return order


def _styled(page: geometry.Page) -> list[tuple]:
    """The lines of a page."""
    said = np.array([i for i, t in enumerate(page.txt) if t.strip(" ")], int)
    if not len(said):
        return []
    x0, y0, x1, y1, size = (v[said] for v in (page.x0, page.y0, page.x1, page.y1, page.size))
    texts = [page.txt[i] for i in said.tolist()]
    order = _in_order(y1, x0, texts)
    cuts = np.flatnonzero(np.abs(np.diff(y1[order])) > max(0.5, 0.4 * float((y1 - y0).mean()))) + 1
    out = []
    for line, part in enumerate(np.split(order, cuts)):
        part = part[_in_order(np.zeros(len(part)), x0[part], [texts[i] for i in part.tolist()])]
        apart = np.concatenate([[False], x0[part[1:]] - x1[part[:-1]] > 1.5]).tolist()
        out.append((line, y0[part].min(), size[part].max(), "".join([" " + texts[i].strip(" ") if far else texts[i].strip(" ") for i, far in zip(part.tolist(), apart, strict=True)])))
    return out


def parents(found: DataFrame) -> DataFrame:
    """Parent: the seq of the last section before of a lower level, null if there is none.

    Levels are few, so the last place of each is carried along, and the best of the lower ones taken.
    """
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*[F.struct(F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(order).alias("seq"), F.lit(k).alias("level")) for k in range(1, 7)])
    return found.withColumn("_last", last).withColumn("parent", F.array_max(F.transform(F.filter("_last", lambda x: x["level"] < F.col("level")), lambda x: x["seq"]))).drop("_last")


def validity(stated: DataFrame, *, by: list[str], at: str) -> DataFrame:
    """Facts that are superseded, never deleted: valid_to is where the next one of the same ``by`` begins."""
    return stated.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))


def echo(before: DataFrame, said: str, reply: str, n: int = 3) -> DataFrame:
    """``before`` with echo: the share of the reply's runs of ``n`` words that the text said before
    it has too; 0 if it has none. Words are cut once, in a step of their own."""

    def runs(found: str) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " ")))

    cut = before.withColumn("_said", words(F.col(said))).withColumn("_reply", words(F.col(reply)))
    met = cut.withColumn("_said", runs("_said")).withColumn("_reply", runs("_reply"))
    share = F.try_divide(F.size(F.array_intersect("_said", "_reply")), F.size("_reply"))
    return met.withColumn("echo", F.coalesce(share, F.lit(0.0))).drop("_said", "_reply")


def two_stage(queries: DataFrame, docs: DataFrame, *, least: float, opened: int = 3, second: int = 2) -> DataFrame:
    """``query_id, doc_id, piece, shared, place``: documents by BM25, then the pieces (paragraphs) of
    these that share most keywords with the query; pieces that share none are left out."""
    chosen = retrieval.top(retrieval.bm25(queries, docs, key="doc_id", least=least).withColumn("score", F.round("score", 3)), "query_id", F.col("score"), "doc_id", opened).select("query_id", "doc_id")
    pieces = docs.join(chosen, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id").select("query_id", "doc_id", retrieval.keywords(F.col("query")).alias("keys"), F.posexplode(retrieval.paragraphs(F.col("text"))).alias("piece", "p"))
    scored = pieces.withColumn("shared", F.size(F.array_intersect("keys", retrieval.keywords(F.col("p"))))).where("shared > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "doc_id", "piece")
    first = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= second)
    return first.select("query_id", "doc_id", "piece", "shared", F.col("place").cast("long").alias("place"))


def overlapping(found: DataFrame) -> DataFrame:
    """Sections that begin before the one before them ends (page, page_end), which is an error to be told."""
    before = F.lag("page_end").over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.withColumn("_before", before).where(F.col("_before") >= F.col("page")).drop("_before")
