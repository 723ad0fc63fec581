"""Quality rules: counts of each document, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams of bytes (``GRAMS``) are counted: one of the raw corpus
(every document), one of a trusted target (documents labelled good). A document's score is the
mean, over its n-grams, of log p_target - log p_raw; being a mean it doesn't grow with the text.
Byte n-grams are few enough that a small target has met those of clean text. A document is kept
if the score reaches ``least`` and the base counts pass. The same rows always give the same
verdicts: hashes are fixed, counts are integers, and nothing is drawn at random.

Counting is one pass that adds up inside each task; a task hands on at most one row for each
bucket. The model is two numbers for each of ``buckets``, so what the driver gathers and ships
has a fixed size, whatever the input. The target is fitted on at most ``sample`` labelled
documents, those with the smallest hashes of their ids; raw counts cover all documents.

Defined results: null is the empty text; a text without words has the score 0 and fails the base
rule; without any target (no labels) every score is 0; repeated rows count, and are judged, one
by one; a label counts once however often it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import chunks, map_texts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Hash buckets of the n-grams.
BUCKETS = 1 << 16
#: Labelled documents on which the target is fitted, at most.
SAMPLE = 20_000
#: Lengths of the n-grams, in bytes.
GRAMS = (2, 3)
#: The smallest score of a kept document, in nats an n-gram.
LEAST = -0.6
#: Added to a bucket's count in the target, and to what the raw corpus would have there.
PRIOR = 4.0

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordIds:
    """Numbers of words, and their 64-bit hashes, kept until there are ``most`` of them."""

    def __init__(self, most: int = 100_000):
        self.most, self.ids, self.hashes = most, {}, np.zeros(1 << 16, np.uint64)

    def __call__(self, cut: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of all documents, one after another."""
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
        for word in set().union(*cut).difference(ids):
            number = ids[word] = len(ids)
            if number == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[number] = xxhash.xxh64_intdigest(word)
        get = ids.__getitem__
        return np.fromiter(chain.from_iterable(map(get, words) for words in cut), np.int64, sum(map(len, cut)))


def gram_buckets(data: list[bytes], buckets: int, grams: tuple[int, ...] = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: buckets of all n-grams within a document, and the documents."""
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(data)), [len(b) for b in data])
    for n in grams:
        size = len(flat) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, np.uint64)
        for k in range(n):
            value = value * _MIX + flat[k : k + size]
        value = (value ^ (value >> np.uint64(31))) * _MIX2
        inside = doc[:size] == doc[n - 1 :]
        yield ((value[inside] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), doc[:size][inside]


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, numbers = np.unique(ids, return_inverse=True)
    base = np.int64(numbers.max() + 1)
    _, first = np.unique(numbers[:-2] * base + numbers[1:-1], return_inverse=True)
    _, where, count = np.unique(first * base + numbers[2:], return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


_words = WordIds()


def _count(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, raw, target``: n-grams of all documents, and of those with ``trusted``."""
    schema = "bucket int, raw long, target long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in chunks(batches, "text"):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
            trusted = np.array(part["trusted"].to_pylist(), bool)
            for found, doc in gram_buckets(data, buckets):
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[trusted[doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return docs.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, sample: int = SAMPLE, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of each bucket.

    trusted_ids: ids of the target in its first column. A bucket's ratio is (t + prior) / (e +
    prior), of the target's count t and the count e that as many n-grams of the raw corpus have
    there, so that n-grams too rare to tell count little.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_trusted")).where("_trusted is not null").distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(sample)
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left").select("text", F.col("_trusted").isNotNull().alias("trusted"))
    rows = _count(marked, buckets).toPandas()  # a row for each bucket at most
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log(target + prior) - np.log(raw * (target.sum() / raw.sum()) + prior)


def judge(docs: DataFrame, ratios: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, the counts, score, base_failed and kept of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [*(T.StructField(n, T.LongType()) for n in longs), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]

    def run(texts: list) -> dict:
        texts = [t or "" for t in texts]
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        cut = [b.split() for b in data]
        sizes = np.array([len(w) for w in cut])
        ids = _words(cut)
        total, number = np.zeros(len(texts)), np.zeros(len(texts))
        for found, doc in gram_buckets(data, len(shipped.value)):
            total += np.bincount(doc, weights=shipped.value[found], minlength=len(texts))
            number += np.bincount(doc, minlength=len(texts))
        score = total / np.maximum(1, number)
        ends = np.cumsum(sizes)
        repeat = np.array([repeated_words(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)])
        failed = (sizes < 50) | (100 * repeat > 50 * sizes)
        return {
            "n_words": sizes,
            "word_chars": [len(t) - (len(b) - len(b.translate(None, SPACE))) for t, b in zip(texts, data, strict=True)],
            "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in data],
            "n_dup_lines": [repeated_lines(t) for t in texts],
            "n_repeat_words": repeat,
            "score": score,
            "base_failed": failed,
            "kept": ~failed & (score >= least),
        }

    return map_texts(docs, run, fields, id_col=id_col, text_col=text_col, keep=keep)
