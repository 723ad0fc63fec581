"""The query of each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import imagecopies, licences, neardup, packing, ppm, quality, secrets, spbpe, tokenfiles, urlfilter
from marlstone.session import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = """SELECT * FROM VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/') AS t(verdict, host, path)"""


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.judge(docs, quality.fit(docs, trusted))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each vector of ``embeddings`` is drawn as one, and every 20th
    also as an edited copy; each of these is a row of the result."""
    media = imagecopies.drawn_media(table(spark, sf_dir, "embeddings"))
    return imagecopies.image_copies(media, id_col="vec_id", media_col="media", keep=("edited",))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spbpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ppm.identify(docs, ppm.learn(docs))
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


OP6_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{r.name}") for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base, secrets.RULES), 256).alias("base_sha256"), secrets.written(F.col("spans"), secrets.RULES).alias("spans"))


def _op7_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = quote(r.pattern)
        parts.append(f"""
  SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'kind': {i}, 'size': length(m[i]), 'held': length(h[i])}}), lambda s: s.held >= {r.least}) AS found
  FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS h FROM d)""")
    names = "[" + ", ".join(quote(r.name) for r in secrets.RULES) + "]"
    text = f"list_transform({{}}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.size))"
    whole, base = text.format("spans"), text.format("list_filter(spans, lambda s: s.kind < 3)")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, list_sort(flatten(list(list_transform(found, lambda x: {{'start': x.start::BIGINT, 'kind': x.kind, 'size': x.size::BIGINT}})))) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, len(list_filter(spans, lambda s: s.kind = 0))::BIGINT AS n_assign, len(list_filter(spans, lambda s: s.kind = 1))::BIGINT AS n_access, len(list_filter(spans, lambda s: s.kind = 2))::BIGINT AS n_hex,
  sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({whole}, ',') AS spans
FROM s
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfiles.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, expected=packing.expected_pieces(docs))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    phrases = F.array(*[F.lit(p) for p, _ in licences.BASE_PHRASES])
    base = F.filter("places", lambda p: F.array_contains(phrases, p["phrase"]))
    starts = F.transform(base, lambda p: p["word"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    own = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("tags", lambda t: t["identifiers"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(own).alias("labels"),
        "score",
        F.when(F.size("tags") > 0, F.forall("tags", lambda t: t["accepted"])).alias("accepted"),
    )


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_quality_rules, op2_near_duplicates, op3_image_copies, op4_byte_bpe, op5_language_id, op6_url_filter, op7_secret_scan, op8_token_files, op9_best_two_fit, op10_licence_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op7_secret_scan": _op7_sql()}
