"""The corpus pipeline: documents are filtered, deduplicated, cleaned and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import neardup, packing, ppm, quality, secrets
from marlstone.session import shared_folder, table


def _kept(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns named so that none clashes with what an operator adds, the names of all
    but the id and the text, and the way back to the columns of ``docs``."""
    names = {c: c if c in ("doc_id", "text") else f"held_{i}" for i, c in enumerate(docs.columns)}
    others = tuple(n for c, n in names.items() if n not in ("doc_id", "text"))
    return docs.toDF(*names.values()), others, lambda found: found.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the counts and whose byte n-grams are not much rarer among good
    documents than in the corpus: their mean log ratio is -0.6 or more."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    own, others, back = _kept(docs)
    return back(quality.judge(own, quality.fit(own, trusted), keep=("text", *others)).where("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known and as likely as all others together."""
    own, others, back = _kept(docs)
    return back(ppm.identify(own, ppm.learn(docs), keep=("text", *others)).where("lang_pred != 'und' and score >= 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class."""
    own, others, back = _kept(docs)
    return back(neardup.near_duplicates(own, keep=("text", *others)).where("representative"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; ``n_chars`` follows the text."""
    own, others, back = _kept(docs)
    found = back(secrets.scan_secrets(own, keep=others, mask="[secret]").withColumnRenamed("masked", "text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of up to 2048."""
    pieces = packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), expected=packing.expected_pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_two_fit", best_two_fit),
]

#: SQL can express neither the learned models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
