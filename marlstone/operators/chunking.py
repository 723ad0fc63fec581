"""Long texts in parts: F11 to F14, A12, A16 to A18, A20."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import lexicons
from marlstone.functions.text import collapsed

#: Tokens of the fixed prompt, of the answer, the share left free, and characters of a token at worst.
PROMPT, ANSWER, FREE, CHARS = 150, 1800, 0.10, 2.7444
#: Fixed value: collapsed sources below this many characters are left out.
LEAST_SOURCE = 200

LEVELS = ("titoli", "pagine", "paragrafi", "frasi", "parole")
CHUNKS = T.StructType([T.StructField("chunks", T.ArrayType(T.StringType())), *(T.StructField(n, T.LongType()) for n in LEVELS)])
_BLOCK = re.compile(lexicons.BLOCK)
_MARK = re.compile(r"__BLOCCO_(\d+)__+")
#: The levels at which a text is cut first, from the strongest boundary to the weakest.
_CUTS = (("titoli", re.compile(r"\n(?=#{1,6} )")), ("pagine", re.compile(r"\n(?=<!-- pag \d+ -->)")), ("paragrafi", re.compile(r"\n\s*\n")))
_SENTENCE = re.compile(r"[^.!?]+[.!?]+|[^.!?]+$")


def budget(context: int = 8192) -> int:
    """characters of a part, by the model's context."""
    return max(1000, int((context - PROMPT - ANSWER) * (1 - FREE) * CHARS))


def _refilled(pieces: list[str], most: int, glue: str) -> list[str]:
    """Pieces joined as long as they stay within ``most`` characters."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + len(glue) + len(piece) <= most:
            out[-1] += glue + piece
        else:
            out.append(piece)
    return out


def _cut(text: str, most: int, counts: dict[str, int]) -> Iterator[str]:
    """Pieces of a text; a weaker boundary is used only where the stronger ones leave too much."""
    waiting = [text]
    while waiting:
        piece = waiting.pop()
        if len(piece) <= most:
            yield piece
            continue
        for level, boundary in _CUTS:
            parts = [p.strip() for p in boundary.split(piece) if p.strip()]
            if len(parts) > 1:
                counts[level] += 1
                waiting += reversed(parts)
                break
        else:
            sentences = [s.strip() for s in _SENTENCE.findall(piece) if s.strip()]
            counts["frasi" if len(sentences) > 1 else "parole"] += 1
            yield from _refilled(sentences if len(sentences) > 1 else piece.split(), most, " ")


def chunked(text: str, most: int) -> tuple[list[str], dict[str, int]]:
    """parts of a text of ``most`` characters, and how often each boundary was used.

    Fenced blocks are never cut; one stands for as many characters as its placeholder has, since
    that is what the model gets. A sentence or word longer than ``most`` stays whole.
    """
    blocks: list[str] = []

    def held(m: re.Match) -> str:
        blocks.append(m[0])
        return "\n\n" + f"__BLOCCO_{len(blocks) - 1}__".ljust(len(lexicons.PLACEHOLDERS[m[1]]), "_") + "\n\n"

    counts = dict.fromkeys(LEVELS, 0)
    parts = _refilled(list(_cut(_BLOCK.sub(held, text).strip(), most, counts)), most, "\n\n")
    parts = [_MARK.sub(lambda m: blocks[int(m[1])], p) for p in parts if p]
    return parts or [text], counts


#: Characters of texts that are chunked and handed over at once, and a text at least.
AT_ONCE = 1 << 20


def _handed(rows: list[tuple[list[str], dict[str, int]] | None]) -> pa.Array:
    """Structs of chunks and counts."""
    kept = [r or ([], dict.fromkeys(LEVELS)) for r in rows]
    made = [pa.array([r and r[0] for r in rows], pa.list_(pa.string())), *(pa.array([counts[n] for _, counts in kept], pa.int64()) for n in LEVELS)]
    return pa.StructArray.from_arrays(made, names=["chunks", *LEVELS])


def _pieces(batches: Iterable[pa.Array], most: int) -> Iterator[pa.Array]:
    """Chunks of each text, some texts at a time."""
    for texts in batches:
        rows, held = [], 0
        for text in texts:
            found = text.as_py()
            rows.append(None if found is None else chunked(found, most))
            held += len(found or "")
            if held >= AT_ONCE:
                yield _handed(rows)
                rows, held = [], 0
        yield _handed(rows)


def chunks(text: Column, most: int | None = None) -> Column:
    """F12 as a column: struct of chunks and counts, all null for null. Texts come in Arrow batches of
    10,000 and go in pieces of a few megabytes, so that a worker never holds more than these."""
    limit = most or budget()

    @F.arrow_udf(CHUNKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _pieces(batches, limit)

    return run(text)


def for_model(text: Column) -> Column:
    """the text with placeholders for its blocks."""
    for kind, stands in lexicons.PLACEHOLDERS.items():
        text = F.regexp_replace(text, lexicons.BLOCK.replace("(tabella|formula)", kind), stands)
    return text


def material(text: Column) -> Column:
    """the blocks in order, each below its kind's name."""
    found = F.regexp_extract_all(text, F.lit(lexicons.BLOCK), F.lit(0))
    return F.array_join(F.transform(found, lambda b: F.concat(F.when(b.startswith("<!-- tabella"), "**Tabella**\n\n").otherwise("**Formula**\n\n"), b)), "\n\n")


def block_counts(text: Column) -> dict[str, Column]:
    """Tables, formulas, and ^ and _ within formulas."""
    bodies = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<!-- formula pag [^>]* -->\s*```\s*(.*?)```"), F.lit(1)), "")
    return {
        "n_tables": F.regexp_count(text, F.lit("<!-- tabella pag")),
        "n_formulas": F.regexp_count(text, F.lit("<!-- formula pag")),
        "n_raised": F.regexp_count(bodies, F.lit(r"\^")),
        "n_lowered": F.regexp_count(bodies, F.lit("_")),
    }


def placeholder_share(text: Column) -> Column:
    """Characters of blocks against the collapsed text's, 0 for an empty one; may exceed 1."""
    held = F.aggregate(F.regexp_extract_all(text, F.lit(lexicons.BLOCK), F.lit(0)), F.lit(0), lambda s, b: s + F.length(b))
    return F.coalesce(F.try_divide(held, F.length(collapsed(text))), F.lit(0.0))


def page_range(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``doc_id, section, source``: the pages first to last of each range in order; empty if
    the first one is missing. pages: doc_id, page, text; ranges: doc_id, section, first, last."""
    each = ranges.withColumn("page", F.explode(F.sequence("first", "last")))
    met = each.join(pages, ["doc_id", "page"], "left")
    held = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text"))))
    out = met.groupBy("doc_id", "section").agg(F.bool_or((F.col("page") == F.col("first")) & F.col("text").isNotNull()).alias("_has"), held.alias("_held"))
    return out.select("doc_id", "section", F.when(F.col("_has"), F.trim(F.array_join(F.transform("_held", lambda x: x["text"]), "\n"))).otherwise("").alias("source"))


def coverage(chunked_docs: DataFrame, *, least: int = LEAST_SOURCE) -> DataFrame:
    """Totals over documents (columns text and parts, as ``chunks`` gives them)."""
    size = F.length(collapsed(F.col("text")))
    done = size >= least
    return chunked_docs.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if(~done).alias("n_left_out"),
        F.count_if(done & (F.size("parts.chunks") > 1)).alias("n_divided"),
        F.sum(F.when(done, F.size("parts.chunks")).otherwise(0)).cast("long").alias("n_chunks"),
        *[F.sum(F.when(done, F.col(f"parts.{n}")).otherwise(0)).alias(f"n_{n}") for n in LEVELS],
    )


def merged_bullets(bullets: Column, most: int = 4) -> Column:
    """The first of each bullet that differ by more than case, ``most`` of them, in order."""
    low = F.transform(bullets, lambda b: F.lower(b))
    return F.slice(F.filter(bullets, lambda b, i: F.array_position(low, F.lower(b)) == i + 1), 1, most)


def sections_for_model(sources: DataFrame, *, least: int = LEAST_SOURCE, most: int | None = None) -> DataFrame:
    """C7 up to the model: ``sources`` (a column source) with n_chars, placeholder_share, reason, divided,
    for_model and material.

    P18: reason tells why a section is left out, null for others, whose text for the model and
    kept blocks follow. divided: whether the section is above ``most`` characters and so goes to the
    model in parts (``chunks``)."""
    n = F.col("n_chars")
    told = sources.withColumn("n_chars", F.length(collapsed(F.col("source")))).withColumn("placeholder_share", placeholder_share(F.col("source")))
    told = told.withColumn("reason", F.when(n < least, F.format_string("fonte troppo corta: %d caratteri", n)))
    kept = F.col("reason").isNull()
    return told.withColumn("divided", kept & (n > (most or budget()))).withColumn("for_model", F.when(kept, for_model(F.col("source")))).withColumn("material", F.when(kept, material(F.col("source"))))


def throughput(tokens: Column, model_ns: Column, wall_s: Column, parts: Column) -> Column:
    """Tokens a second: of one part by the model's own time, of several by the clock; 0 for no time."""
    own = F.when(parts > 1, F.try_divide(tokens, wall_s)).otherwise(F.try_divide(tokens * 1e9, model_ns))
    return F.coalesce(F.round(own, 1), F.lit(0.0))
