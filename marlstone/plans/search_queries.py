"""Queries over documents, pages, benchmark and embeddings: fusion, passages, shortlists, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import html_markdown, is_link_line, plain_text
from marlstone.operators import fusion, retrieval
from marlstone.plans.catalogue import register
from marlstone.session import table

STOP = "['" + "', '".join(retrieval.lexicons.STOPWORDS) + "']"


def _keys(text: str) -> str:
    """The keywords of a text, in SQL."""
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


OVERLAP = f"""
asked AS (SELECT item_id AS query_id, unnest({_keys('text')}) AS word FROM benchmark),
held AS (SELECT doc_id, length(text) AS n_chars, unnest({_keys('text')}) AS word FROM documents),
overlap AS (SELECT query_id, doc_id, count(*) AS shared, any_value(n_chars) AS n_chars FROM held JOIN asked USING (word) GROUP BY ALL)"""

LISTS = f"""{OVERLAP},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) - 1 AS pos FROM overlap QUALIFY pos < 20),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared / (1.0::DOUBLE + n_chars / 800.0::DOUBLE) DESC, doc_id) - 1 AS pos FROM overlap QUALIFY pos < 20),
ranked AS (SELECT query_id, 0 AS list_no, pos, doc_id FROM a UNION ALL SELECT query_id, 1, pos, doc_id FROM b)"""


def _fused(weights: tuple[float, float]) -> str:
    return f"""WITH {LISTS},
parts AS (SELECT query_id, doc_id, max(CASE WHEN list_no = 0 THEN pos END) AS p0, max(CASE WHEN list_no = 1 THEN pos END) AS p1 FROM ranked GROUP BY ALL),
scored AS (SELECT query_id, doc_id, coalesce({weights[0]}::DOUBLE / (61 + p0), 0.0::DOUBLE) + coalesce({weights[1]}::DOUBLE / (61 + p1), 0.0::DOUBLE) AS score,
  (p0 IS NOT NULL)::BIGINT + (p1 IS NOT NULL)::BIGINT AS n_lists, least(coalesce(p0, p1), coalesce(p1, p0))::BIGINT AS best_pos,
  CASE WHEN p0 IS NOT NULL THEN 0 ELSE 1 END AS l, coalesce(p0, p1) AS p FROM parts)
SELECT query_id, doc_id AS id, round(score, 12) AS score, n_lists, best_pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_lists DESC, best_pos, l, p, doc_id) AS rank
FROM scored QUALIFY rank <= 10"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of 20 documents for each benchmark item: by shared keywords, and by these against the length."""
    met = retrieval.overlap(_asked(spark, sf_dir), table(spark, sf_dir, "documents"))
    by_count = retrieval.top(met, "query_id", F.col("shared"), "doc_id", 20).withColumn("list_no", F.lit(0))
    by_share = retrieval.top(met, "query_id", F.col("shared") / (1 + F.col("n_chars") / 800), "doc_id", 20).withColumn("list_no", F.lit(1))
    return by_count.unionByName(by_share).select("query_id", "list_no", "pos", F.col("doc_id").alias("id"))


@register("rrf_fusion", _fused((1.0, 1.0)))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_lists(spark, sf_dir), by=["query_id"], most=10).withColumn("score", F.round("score", 12))


@register("rrf_weighted", _fused((2.0, 0.5)))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.sql("SELECT * FROM VALUES (0, 2.0D), (1, 0.5D) AS t(list_no, weight)")
    return fusion.fuse(_lists(spark, sf_dir), by=["query_id"], weights=weights, most=10).withColumn("score", F.round("score", 12))


@register("keyword_overlap", f"WITH {OVERLAP} SELECT query_id, doc_id, shared FROM overlap")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overlap(_asked(spark, sf_dir), table(spark, sf_dir, "documents")).select("query_id", "doc_id", "shared")


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with the three documents that share most of its keywords."""
    asked, docs = _asked(spark, sf_dir), table(spark, sf_dir, "documents")
    first = retrieval.top(retrieval.overlap(asked, docs), "query_id", F.col("shared"), "doc_id", 3)
    return first.join(asked.withColumnRenamed("text", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")


#: Paragraphs of what was opened (query_id, doc_id, pos, query, text), and their scores.
SCORED = f"""
pieces AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 80) AS ps, {_keys('query')} AS keys FROM opened),
scored AS (SELECT query_id, doc_id, pos, i, p, len(ps) AS n, list_position(ps, p) AS place,
  CASE WHEN regexp_matches(p, '(?i){retrieval.lexicons.BOILERPLATE}') THEN 0.0::DOUBLE
  ELSE len(list_intersect(keys, {_keys('p')})) / (1.0::DOUBLE + length(p) / 800.0::DOUBLE) + 0.35::DOUBLE * (1.0::DOUBLE - i / greatest(n, 1)::DOUBLE) END AS score
  FROM (SELECT query_id, doc_id, pos, ps, keys, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM pieces))"""

OPENED = f"""{OVERLAP},
first AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) - 1 AS pos FROM overlap QUALIFY pos < 3),
opened AS (SELECT f.*, b.text AS query, d.text FROM first f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d USING (doc_id)),
{SCORED}"""


@register("passage_score", f"WITH {OPENED} SELECT query_id, doc_id, i::INTEGER AS paragraph, round(score, 9) AS score FROM scored")
def passage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _opened(spark, sf_dir).withColumn("ps", retrieval.paragraphs(F.col("text")))
    each = opened.select("query_id", "doc_id", retrieval.keywords(F.col("query")).alias("keys"), "ps").select("query_id", "doc_id", "keys", F.size("ps").alias("n"), F.posexplode("ps").alias("paragraph", "p"))
    score = retrieval.paragraph_score(F.col("p"), F.col("keys"), F.col("paragraph"), F.col("n"))
    return each.select("query_id", "doc_id", "paragraph", F.round(score, 9).alias("score"))


#: The best paragraphs of each text that fit, taken one by one, and the passage they make.
WALK = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, i) AS r FROM scored),
walk AS (
  SELECT query_id, doc_id, 0::BIGINT AS r, 0::BIGINT AS total, false AS done, []::STRUCT(place INTEGER, i BIGINT, p VARCHAR)[] AS held FROM pieces
  UNION ALL
  SELECT w.query_id, w.doc_id, k.r, CASE WHEN take THEN total + length(k.p) ELSE total END, done OR (take AND total + length(k.p) > 0.8 * 340),
    CASE WHEN take THEN list_append(held, {{'place': k.place::INTEGER, 'i': k.i::BIGINT, 'p': k.p}}) ELSE held END
  FROM (SELECT w.*, NOT done AND total + length(k.p) <= 340 AS take, k AS k FROM walk w JOIN ranked k ON k.query_id = w.query_id AND k.doc_id = w.doc_id AND k.r = w.r + 1) w),
ends AS (SELECT query_id, doc_id, arg_max(held, r) AS held FROM walk GROUP BY ALL)"""
PASSAGE = r"""CASE
  WHEN len(ps) = 0 THEN trim(regexp_replace(text, '\s+', ' ', 'g'))[1:340]
  WHEN len(held) = 0 THEN trim(regexp_replace((SELECT p FROM ranked k WHERE k.query_id = o.query_id AND k.doc_id = o.doc_id AND k.r = 1), '\s+', ' ', 'g'))[1:340]
  ELSE array_to_string(list_transform(list_sort(held), lambda x: x.p), chr(10) || chr(10)) END"""

PACKED = f"""WITH RECURSIVE {OPENED},
{WALK}
SELECT o.query_id, o.doc_id, {PASSAGE} AS passage
FROM pieces o JOIN ends e ON e.query_id = o.query_id AND e.doc_id = o.doc_id"""


@register("passage_pack", PACKED)
def passage_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _opened(spark, sf_dir).select("query_id", "doc_id", "text", retrieval.keywords(F.col("query")).alias("keys"), retrieval.paragraphs(F.col("text")).alias("ps"))
    return opened.select("query_id", "doc_id", retrieval.packed_passages(F.col("text"), F.col("keys"), F.col("ps"), 340).alias("passage"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as result lists of twelve each, as long as a list that is looked at whole: by the id."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 12).alias("query_id"), "page_id", "url", "html")
    return pages.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("page_id")) - 1)


SHORTLIST = r"""
r AS (SELECT page_id // 12 AS query_id, page_id, url, row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) - 1 AS pos FROM pages QUALIFY pos < 12),
s AS (SELECT *, regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^www\.', '') AS site, trim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') = '' AS storefront FROM r),
u AS (SELECT * FROM s WHERE site <> '' QUALIFY row_number() OVER (PARTITION BY query_id, site ORDER BY storefront, pos) = 1),
short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY storefront, pos) AS place FROM u QUALIFY place <= 3)"""


@register("search_shortlist", f"WITH {SHORTLIST} SELECT query_id, page_id, site, storefront, place FROM short")
def search_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.shortlist(_results(spark, sf_dir), by="query_id").select("query_id", "page_id", "site", "storefront", "place")


@register("budgeted_concat", f"""WITH {SHORTLIST},
b AS (SELECT query_id, place, '- ' || site || chr(10) || '  ' || url AS block FROM short),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY place) AS so_far FROM b)
SELECT query_id, count(*) AS n_blocks, string_agg(block, chr(10) ORDER BY place)[1:90] AS body FROM c WHERE so_far <= 90 OR place = 1 GROUP BY query_id""")
def budgeted_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = retrieval.shortlist(_results(spark, sf_dir), by="query_id")
    blocks = short.select("query_id", F.col("place").alias("pos"), F.concat(F.lit("- "), "site", F.lit("\n  "), "url").alias("block"))
    return retrieval.budgeted(blocks, by="query_id", most=90)


MARKDOWN = r"""
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
  '(?is)<a\b[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', '[\2](\1)', 'g'), '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g'),
  '(?i)</?(p|div|br|li|ul|ol|h[1-6]|nav|article|footer|header|body|html|head|title|tr|table)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS md FROM pages),
lines AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM m),
judged AS (SELECT *, NOT regexp_matches(regexp_replace(regexp_replace(line, '!?\[(?:[^\]\[]|\[[^\]]*\])*\]\([^)]*\)', ' ', 'g'), '%[^\s%]+%', ' ', 'g'), '[\p{L}\p{N}_]') AS nav FROM lines)"""


@register("link_line_filter", f"WITH {MARKDOWN} SELECT page_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND nav) AS n_nav FROM judged GROUP BY page_id")
def link_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(html_markdown(F.col("html")), "\n")).alias("line"))
    said = F.trim("line") != ""
    return lines.groupBy("page_id").agg(F.count_if(said).alias("n_lines"), F.count_if(said & is_link_line(F.col("line"))).alias("n_nav"))


PAGE_TEXT = rf"""{MARKDOWN},
kept AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE trim(line) <> '' AND NOT nav) AS t FROM judged GROUP BY page_id),
bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '!\[(?:[^\]\[]|\[[^\]]*\])*\]\([^)]*\)', '', 'g'),
  '\[((?:[^\]\[]|\[[^\]]*\])*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{{1,6}}\s*', '', 'g'), '[*_`]{{1,3}}', '', 'g') AS t FROM kept),
un AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM bare),
bodies AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS body FROM un)"""


@register("page_text", f"WITH {PAGE_TEXT} SELECT page_id, body FROM bodies")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", plain_text(html_markdown(F.col("html"))).alias("body"))


@register("search_chain", f"""WITH RECURSIVE {SHORTLIST},
{PAGE_TEXT.strip()},
items AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark),
opened AS (SELECT s.query_id, s.page_id AS doc_id, s.place AS pos, b.text AS query, t.body AS text FROM short s JOIN items b ON b.k = s.query_id % b.n JOIN bodies t ON t.page_id = s.page_id),
{SCORED},
{WALK},
passages AS (SELECT o.query_id, o.pos, o.doc_id, {PASSAGE} AS passage FROM pieces o JOIN ends e ON e.query_id = o.query_id AND e.doc_id = o.doc_id),
blocks AS (SELECT p.query_id, p.pos, '- ' || site || chr(10) || '  ' || passage AS block FROM passages p JOIN short s ON s.query_id = p.query_id AND s.place = p.pos),
total AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY pos) AS so_far FROM blocks)
SELECT query_id, count(*) AS n_blocks, string_agg(block, chr(10) ORDER BY pos)[1:800] AS body FROM total WHERE so_far <= 800 OR pos = 1 GROUP BY query_id""")
def search_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of twelve pages, dealt to the benchmark items in turn: shortlist, text of the pages that
    remain, passages for the item's keywords, and as many blocks as the budget holds."""
    asked = _asked(spark, sf_dir)
    items = asked.select((F.row_number().over(Window.orderBy("query_id")) - 1).alias("k"), F.col("text").alias("query"))
    short = retrieval.shortlist(_results(spark, sf_dir), by="query_id").withColumn("k", F.col("query_id") % max(1, asked.count())).join(items, "k")
    opened = short.select("query_id", "place", "site", retrieval.keywords(F.col("query")).alias("keys"), plain_text(html_markdown(F.col("html"))).alias("text"))
    found = opened.withColumn("ps", retrieval.paragraphs(F.col("text"))).withColumn("passage", retrieval.packed_passages(F.col("text"), F.col("keys"), F.col("ps"), 340))
    blocks = found.select("query_id", F.col("place").alias("pos"), F.concat(F.lit("- "), "site", F.lit("\n  "), "passage").alias("block"))
    return retrieval.budgeted(blocks, by="query_id", most=800)


@register("bm25_documents", rf"""WITH asked AS (SELECT item_id AS query_id, unnest({_keys('text')}) AS word FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
tf AS (SELECT doc_id, word, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM asked) GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (SELECT query_id, doc_id, sum(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) * 1000000)::BIGINT) / 1000000 AS score
  FROM tf JOIN df USING (word) JOIN asked USING (word), stats GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC, doc_id) AS place FROM scored WHERE score > 1 QUALIFY place <= 5""")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(_asked(spark, sf_dir), table(spark, sf_dir, "documents"), key="doc_id", least=1.0).withColumn("score", F.round("score", 3))
    return retrieval.top(found, "query_id", F.col("score"), "doc_id", 5).select("query_id", "doc_id", "score", (F.col("pos") + 1).alias("place"))


@register("cosine_topk", """WITH each AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, i, sum(round(x * 1000000)::BIGINT)::DOUBLE AS c FROM each GROUP BY label, i),
norm AS (SELECT label, sqrt(sum(c * c)) AS n FROM centre GROUP BY label),
met AS (SELECT c.label, e.vec_id, sum(e.x * c.c) / any_value(n.n) / sqrt(sum(e.x * e.x)) AS cosine FROM each e JOIN centre c USING (i) JOIN norm n ON n.label = c.label GROUP BY c.label, e.vec_id)
SELECT label, vec_id, round(cosine, 5) AS cosine, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 5) DESC, vec_id) AS place FROM met QUALIFY place <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to the centre of each label, of all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    each = vectors.select("label", F.posexplode("v").alias("i", "x"))
    sums = each.groupBy("label", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).cast("double").alias("c"))
    centres = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # rows of labels are broadcast a thousand at a time, about
    parts = max(1, -(-centres.count() // 1000))
    tops = []
    for part in range(parts):
        some = F.broadcast(centres.where(F.pmod(F.xxhash64("label"), F.lit(parts)) == part))
        met = vectors.drop("label").crossJoin(some).withColumn("cosine", F.round(dot("v", "c") / F.sqrt(dot("c", "c")) / F.sqrt(dot("v", "v")), 5))
        tops.append(retrieval.top(met, "label", F.col("cosine"), "vec_id", 5).select("label", "vec_id", "cosine", (F.col("pos") + 1).alias("place")))
    return reduce(DataFrame.unionByName, tops)
