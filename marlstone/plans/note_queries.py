"""Queries over notes, turns and the planned operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import facts, geometry, notes
from marlstone.plans.catalogue import register
from marlstone.plans.conversation_queries import SENTENCES
from marlstone.plans.document_queries import SECTIONS, WORDS, _docs, _sections, _words
from marlstone.plans.search_queries import _asked, _keys
from marlstone.session import table


@register("facts_note", f"""WITH {SENTENCES},
k AS (SELECT conv_id, count(*) FILTER (WHERE kind <> 'discarded') AS kept, count(*) FILTER (WHERE kind = 'discarded') AS gone,
  coalesce(string_agg('- "' || sentence || '" — msg_id=' || turn, chr(10) ORDER BY turn, seq, sentence) FILTER (WHERE kind <> 'discarded'), '') AS fs FROM facts GROUP BY conv_id),
r AS (SELECT conv_id, string_agg('- ' || reason || ': ' || n, chr(10) ORDER BY reason) AS rs FROM (SELECT conv_id, reason, count(*) AS n FROM facts WHERE kind = 'discarded' GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10), '- fatti estratti: ' || kept, '- frasi scartate: ' || gone, chr(10) || '## Fatti' || chr(10), fs, CASE WHEN rs IS NOT NULL THEN chr(10) || '## Scartate' || chr(10) || chr(10) || rs END) AS body
FROM k LEFT JOIN r USING (conv_id)""")
def facts_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.facts_note(facts.facts(table(spark, sf_dir, "conversations")))


@register("section_notes", rf"""WITH {SECTIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS number FROM ends)
SELECT doc_id, number, '---' || chr(10) || concat_ws(chr(10), 'tipo: nota-sezione', 'documento: "[[' || doc_id || ']]"', 'sezione: ' || number,
  'titolo: "' || replace(replace(title, '\', '\\'), '"', '\"') || '"', 'pagina: ' || page, 'pagina_fine: ' || page_end, '---' || chr(10) || chr(10) || '# ' || title,
  chr(10) || 'Documento: [[' || doc_id || ']]', 'Pagina: ' || CASE WHEN page_end > page THEN page || '-' || page_end ELSE page::VARCHAR END, CASE WHEN under >= 2000 THEN chr(10) || '> ' || title END) AS note FROM n""")
def section_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of sections; long sections show their title as the extract."""
    found = _sections(spark, sf_dir).withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast("long"))
    extract = F.when(F.col("under") >= 2000, F.col("title")).otherwise("")
    return found.select("doc_id", "number", notes.section_note(F.col("doc_id"), F.col("number"), F.col("title"), F.col("page"), F.col("page_end"), extract).alias("note"))


@register("page_assembly")
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as whole prose and fenced tables, cropped word for word, and formulas."""
    return geometry.page_texts(_words(spark, sf_dir)).select("doc_id", "page", notes.page_body(F.col("prose"), F.col("tables"), F.col("formulas"), F.col("page")).alias("body"))


@register("styled_lines", f"WITH {WORDS}, g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0, txt) AS back FROM lined WHERE trim(txt) <> '') SELECT doc_id, page, seq * 12.0::DOUBLE AS top, string_agg(CASE WHEN back > 1.5 THEN ' ' ELSE '' END || trim(txt), '' ORDER BY x0, txt) AS body FROM g GROUP BY doc_id, page, seq")
def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.styled_lines(_words(spark, sf_dir)).select("doc_id", "page", "top", F.col("text").alias("body"))


@register("outline_parents", f"WITH {SECTIONS} SELECT e.doc_id, e.seq, max(p.seq) AS parent FROM ends e LEFT JOIN ends p ON p.doc_id = e.doc_id AND p.seq < e.seq AND p.level < e.level GROUP BY e.doc_id, e.seq")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.parents(_sections(spark, sf_dir)).select("doc_id", "seq", "parent")


@register("section_overlaps", f"WITH {SECTIONS}, b AS (SELECT *, lag(page_end) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM ends) SELECT doc_id, seq, page, page_end FROM b WHERE before >= page")
def section_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.overlapping(_sections(spark, sf_dir)).select("doc_id", "seq", "page", "page_end")


@register("fact_validity", f"WITH {SENTENCES}, m AS (SELECT conv_id, turn, min(sentence) AS fact FROM facts WHERE kind = 'fact' GROUP BY ALL) SELECT conv_id, turn, fact, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS valid_to FROM m")
def fact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's fact holds until its next one is stated."""
    stated = facts.facts(table(spark, sf_dir, "conversations")).where("kind = 'fact'").groupBy("conv_id", "turn").agg(F.min("sentence").alias("fact"))
    return notes.validity(stated, by=["conv_id"], at="turn")


_RUNS = r"list_distinct(list_transform(range(1, len(@) - 1), lambda i: array_to_string(@[i:i + 2], ' ')))"


@register("echo_overlap", rf"""WITH m AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS ws, lag(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) OVER (PARTITION BY conv_id ORDER BY turn) AS bs FROM conversations),
g AS (SELECT conv_id, turn, {_RUNS.replace('@', 'ws')} AS r, {_RUNS.replace('@', 'bs')} AS b FROM m WHERE bs IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(b, r)) / len(r)::DOUBLE END, 9) AS echo FROM g""")
def echo_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each message repeats the one before."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    met = said.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return notes.echo(met, "before", "text").select("conv_id", "turn", F.round("echo", 9).alias("echo"))


@register("two_stage_retrieval", rf"""WITH asked AS (SELECT item_id AS query_id, unnest({_keys('text')}) AS word FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
tf AS (SELECT doc_id, word, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM asked) GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (SELECT query_id, doc_id, round(sum(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) * 1000000)::BIGINT) / 1000000, 3) AS score
  FROM tf JOIN df USING (word) JOIN asked USING (word), stats GROUP BY query_id, doc_id),
one AS (SELECT query_id, doc_id FROM scored WHERE score > 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
ps AS (SELECT query_id, doc_id, {_keys('b.text')} AS keys, list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 80) AS ps FROM one JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
each AS (SELECT query_id, doc_id, keys, unnest(range(len(ps)))::INTEGER AS piece, unnest(ps) AS p FROM ps),
sh AS (SELECT query_id, doc_id, piece, len(list_intersect(keys, {_keys('p')}))::INTEGER AS shared FROM each)
SELECT query_id, doc_id, piece, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id, piece) AS place FROM sh WHERE shared > 0 QUALIFY place <= 2""")
def two_stage_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.two_stage(_asked(spark, sf_dir), _docs(spark, sf_dir).select("doc_id", "text"), least=1.0)


TURNS = """t AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 100 AS prompt,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0)::BIGINT * 100 AS cached, length(text)::BIGINT AS generated, (turn % 3)::DOUBLE AS seconds FROM conversations WHERE text IS NOT NULL)"""


@register("turn_measures", f"""WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN prompt = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * cached / prompt END, 6) AS cached_percent, prompt >= 52000 AS near_limit, round(CASE WHEN seconds = 0 THEN 0.0::DOUBLE ELSE generated / seconds END, 6) AS tokens_s FROM t""")
def turn_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message's prompt is all that was said before, at a hundred tokens a character so that limits are met; its cache what was there a turn earlier."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    so_far = lambda last: F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)) * 100
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", so_far(-1).alias("prompt"), so_far(-2).alias("cached"), F.length("text").cast("long").alias("generated"), (F.col("turn") % 3).cast("double").alias("seconds"))
    return notes.turn_measures(turns).select("conv_id", "turn", F.round("cached_percent", 6).alias("cached_percent"), "near_limit", F.round("tokens_s", 6).alias("tokens_s"))


@register("diary_details", "SELECT doc_id, CASE WHEN lang <> 'en' AND length(text) > 300 THEN text[1:300] || '...' ELSE text END AS detail, length(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\\s+', '', 'g'))::INTEGER AS n_chars FROM documents")
def diary_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diary texts; those in English stand for final ones."""
    return _docs(spark, sf_dir).select("doc_id", notes.diary_detail(F.col("text"), F.col("lang") == "en").alias("detail"), notes.characters(F.col("text")).alias("n_chars"))


@register("event_tails", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def event_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.tail(table(spark, sf_dir, "events"), by="user_id", order=["ts", "event_id"], most=5).select("user_id", "event_id")
