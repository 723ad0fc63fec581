"""Readers of the formats that texts come in, and the sinks beside Spark's own.

Binary formats (PDF, SQLite) are landed by other tools; their text output is what is read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, path: str, *, least_files: int = 0) -> DataFrame:
    """Messages of all files below ``path``; null texts are empty. Too few files are an error."""
    found = spark.read.parquet(path).withColumn("text", F.coalesce("text", F.lit("")))
    if least_files and found.select(F.input_file_name()).distinct().limit(least_files).count() < least_files:
        raise ValueError(f"{path} holds fewer than {least_files} files")
    return found


def said(found: DataFrame) -> DataFrame:
    """S1': messages that say something, trimmed."""
    return found.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text != ''")


def file_queue(spark: SparkSession, path: str, schema: str, *, format: str = "parquet", files_at_once: int = 100) -> DataFrame:
    """Files that arrive below ``path``, each once: what was seen is in the query's checkpoint."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sse_data(line: Column) -> Column:
    """The data of a line of a server's event stream, null for other lines."""
    return F.when(line.startswith("data:"), F.trim(F.substring(line, F.lit(6), F.length(line))))


def of_session(events: DataFrame, session: str) -> DataFrame:
    """Events (column data, JSON) of one session, and those of none."""
    own = F.get_json_object("data", "$.properties.sessionID")
    return events.where(own.isNull() | (own == session))


def bullets(text: Column, sections: tuple[str, ...] = ("## Fatti", "## Osservazioni")) -> Column:
    """Bullets below the first of the named headings, up to the next heading."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    named = F.array(*[F.lit(s) for s in sections])
    start = F.struct(F.lit(0).alias("state"), F.expr("cast(array() as array<string>)").alias("held"))

    def step(s: Column, x: Column) -> Column:
        state = F.when((s["state"] == 0) & F.array_contains(named, x), 1).when((s["state"] == 1) & x.startswith("#"), 2).otherwise(s["state"])
        return F.struct(state.alias("state"), F.when((s["state"] == 1) & x.startswith("- "), F.concat(s["held"], F.array(F.trim(F.substring(x, F.lit(3), F.length(x)))))).otherwise(s["held"]).alias("held"))

    return F.aggregate(lines, start, step, lambda s: s["held"])


def settings(text: Column) -> Column:
    """A map of ``KEY=value`` lines; blank ones, comments and others are left out, the last value counts."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#") & F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    return _last_map(pairs)


def front_matter(text: Column) -> Column:
    """A map of the ``key: value`` lines between the first two ``---`` lines; indented lines
    and list items are left out. Every value is text."""
    inside = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(inside, "\n"), lambda x: F.contains(x, F.lit(":")) & ~x.startswith(" ") & ~x.startswith("-"))
    return _last_map(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))))


def _last_map(pairs: Column) -> Column:
    """A map in which the last of equal keys counts."""
    # in order of key and place, an entry whose successor has its key is not the last one
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    followed = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(pairs), F.lit(1))), lambda p, q: F.struct(p.alias("p"), q["key"].alias("next")))
    last = F.filter(followed, lambda x: x["p"].isNotNull() & ~x["p"]["key"].eqNullSafe(x["next"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["p"]["key"].alias("key"), x["p"]["value"].alias("value"))))


def section_notes(notes: DataFrame) -> DataFrame:
    """``path, section, title, page, page_end`` of notes (path, text) whose front matter has a section and a page."""
    held = notes.select("path", front_matter(F.col("text")).alias("m"))
    number = lambda k: F.element_at("m", F.lit(k)).try_cast("int")
    title = F.coalesce(F.element_at("m", F.lit("titolo")), F.lit('""'))
    out = held.select("path", number("sezione").alias("section"), F.regexp_replace(F.regexp_replace(title, r'^"+|"+$', ""), r'\\"', '"').alias("title"), number("pagina").alias("page"), F.coalesce(number("pagina_fine"), number("pagina")).alias("page_end"))
    return out.where("section is not null and page is not null")


def pages_of_text(texts: DataFrame) -> DataFrame:
    """S3: ``doc_id, page, text`` of documents' text output (doc_id, text), a form feed behind each page."""
    cut = F.split(F.regexp_replace("text", "\f$", ""), "\f")
    return texts.select("doc_id", F.posexplode(cut).alias("page", "text")).withColumn("page", F.col("page") + 1)


def metasearch(answers: DataFrame) -> DataFrame:
    """``query_id, pos, url, title, content`` of answers (query_id, body) in JSON; bodies that
    aren't JSON, or have no results, give no rows."""
    kind = "struct<results:array<struct<url:string,title:string,content:string>>>"
    each = answers.select("query_id", F.posexplode(F.from_json("body", kind)["results"]).alias("pos", "r"))
    return each.select("query_id", "pos", "r.url", "r.title", "r.content")


def updates_since(updates: DataFrame, offset: int) -> DataFrame:
    """Updates from ``offset`` on, with next_offset, which is to be kept before they are handled,
    so that none is handled twice."""
    return updates.where(F.col("update_id") >= offset).withColumn("next_offset", F.col("update_id") + 1)


def history(messages: DataFrame) -> DataFrame:
    """``id, role, content, calls, call_id`` as the model gets messages (id, role, text, tool_calls,
    call_id): answers of tools name their call; an assistant's message with calls has no content."""
    kind = "array<struct<id:string,name:string>>"
    has = (F.col("role") != "tool") & (F.coalesce("tool_calls", F.lit("")) != "")
    return messages.select(
        "id",
        F.when(F.col("role") == "tool", "tool").when(has, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(~has, F.coalesce("text", F.lit(""))).alias("content"),
        F.when(has, F.from_json("tool_calls", kind)).alias("calls"),
        F.when(F.col("role") == "tool", F.col("call_id")).alias("call_id"),
    )


def live(locks: DataFrame, processes: DataFrame) -> DataFrame:
    """Locks (path, pid) with held, whether their process lives; the others are orphans."""
    return locks.join(processes.select("pid").distinct().withColumn("held", F.lit(True)), "pid", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def page_differences(expected: DataFrame, present: DataFrame) -> DataFrame:
    """``doc_id, page, side`` of pages that only one of the two has (extra ones included): none if all are there."""
    keys = ["doc_id", "page"]
    lacking = expected.select(*keys).exceptAll(present.select(*keys)).withColumn("side", F.lit("missing"))
    return lacking.unionByName(present.select(*keys).exceptAll(expected.select(*keys)).withColumn("side", F.lit("unexpected")))


def page_words(pages: DataFrame) -> DataFrame:
    """``doc_id, page, x0, y0, x1, y1, txt`` of pages (doc_id, page, xhtml) with boxes of words."""
    # Fixed value: how the word boxes are written.
    word = r'<word ([^>]+)>([^<]*)</word>'
    each = pages.select("doc_id", "page", F.explode(F.arrays_zip(F.regexp_extract_all("xhtml", F.lit(word), F.lit(1)).alias("a"), F.regexp_extract_all("xhtml", F.lit(word), F.lit(2)).alias("t"))).alias("w"))
    side = lambda n: F.coalesce(F.regexp_extract("w.a", rf'{n}="([\d.\-]+)"', 1).try_cast("double"), F.lit(0.0))
    from marlstone.functions.text import unescaped

    return each.select("doc_id", "page", side("xMin").alias("x0"), side("yMin").alias("y0"), side("xMax").alias("x1"), side("yMax").alias("y1"), unescaped(F.col("w.t")).alias("txt"))


def metadata(info: Column) -> Column:
    """A map of Title, Author and CreationDate, blank ones left out."""
    fields = [F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(info, rf"(?m)^{k}:[ \t]*(.*)$", 1)).alias("value")) for k in ("Title", "Author", "CreationDate")]
    return F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"] != ""))


def image_list(listing: DataFrame) -> DataFrame:
    """``page, num, width, height`` of a listing's lines (column line) that name an image."""
    cells = F.split(F.trim("line"), r"\s+")
    found = listing.where(F.get(cells, F.lit(2)) == "image").select(*[F.get(cells, F.lit(i)).try_cast("int").alias(n) for i, n in ((0, "page"), (1, "num"), (3, "width"), (4, "height"))])
    return found.dropna()


def outline_rows(outline: DataFrame) -> DataFrame:
    """Entries (doc_id, seq, title, level, page0) with titles collapsed and pages from 1; blank
    titles and entries without a page are left out."""
    from marlstone.functions.text import collapsed

    return outline.withColumn("title", collapsed(F.col("title"))).where("title != '' and page0 is not null").withColumn("page", F.col("page0") + 1).drop("page0")


def latest(pairs: DataFrame) -> DataFrame:
    """D3: of each key the value with the latest ts."""
    return pairs.groupBy("key").agg(F.max_by("value", "ts").alias("value"))


def newest(rows: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` rows inserted last; a bounded top, so no sort of all rows."""
    return rows.orderBy(F.desc("inserted")).limit(most)


def first_lane(*lanes: Column) -> Column:
    """The first lane that has an answer; a failed lane is null, never an error."""
    return F.coalesce(*lanes)


def quarantined(docs: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """K6: the documents without a reason against them, and the others with it."""
    told = docs.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def write_diary(events: DataFrame, path: str, checkpoint: str):
    """K5: a stream of events as lines of JSON; returns the started query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def owned(requests: DataFrame) -> DataFrame:
    """Requests of the first chat, which thereby is the owner's."""
    owner = requests.agg(F.min_by("chat_id", F.struct("ts", "request_id")).alias("chat_id"))
    return requests.join(owner, "chat_id", "left_semi")
