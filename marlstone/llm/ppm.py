"""Language identification by prediction by partial matching.

For each language, counts of bytes after contexts of up to ``order`` bytes form a tree. The code
length of a byte is that of method C without exclusions: after a context that was seen n times,
before d different bytes, a byte seen k times costs log2((n + d) / k) bits, another one costs the
escape, log2((n + d) / d), and then its cost after the context that is a byte shorter; below the
empty context all 256 bytes cost 8. Statistics are frozen after fitting, so a byte's cost depends
on the bytes before it only; costs are kept as integers (1/1024 bit) and sums are exact. The
language that codes a text in the fewest bits wins, the first by name among equals.

The trees of all languages share their nodes, ``nodes`` at most: the most frequent contexts of each
language in turn, so that a rare language has as many of its own (a context counts as often as its
longer ones together, so the tree is whole). The model, which is broadcast, takes
nodes * bytes in use * languages * 4 bytes; every value of the language column is learned. All texts of
a batch are scored together: the context of each byte is found by walking the tree backwards,
a table look-up for each of the ``order`` steps.

Fitting takes about ``per_language`` documents of each language, fewer if these would have more than
an equal share of ``most_bytes``, picked by a hash of their ids and texts among those of at most
``longest`` bytes; of a language that has only longer ones, from a slice of each, of at most as
many bytes, that begins where the hash says. Equal texts of a language count once, so repeated rows
don't add up. Every text is scored whole.

score: the language's share of the languages' 2^-bits, where bits are those of ``SPAN`` bytes at the
text's mean cost (of the whole text if it is shorter): how clearly the language stands out,
whatever the text's length.

Defined results: null, and texts without a letter, are ``und`` with the score 0; so is every
text if no language was learned. Repeated rows are scored one by one. A text is coded from the
empty context on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import map_texts

#: Longest context, in bytes.
ORDER = 4
#: Contexts in the tree, at most.
NODES = 6000
#: Documents of each language from which it is learned, about; and the largest of these in bytes.
PER_LANGUAGE, LONGEST = 400, 50_000
#: Bytes of all texts that are learned from, about; they go to the driver.
MOST_BYTES = 64 << 20
#: Bytes of a text for which the score is given.
SPAN = 16
_UNIT = 1024
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """symbols: number of each byte, 0 for all not in use. after: next state by state and symbol,
    walking back; a state below ``len(costs)`` is a node that may have longer contexts, the same
    plus ``len(costs)`` one that ended. costs: by node, symbol and language."""

    languages: tuple[str, ...]
    symbols: np.ndarray
    after: np.ndarray
    costs: np.ndarray
    order: int


def fit(texts: dict[str, list[str]], *, order: int = ORDER, nodes: int = NODES) -> Model:
    """The model of some texts by language."""
    languages = tuple(sorted(texts))
    data = {lang: [t.encode("utf-8", "surrogatepass") for t in texts[lang]] for lang in languages}
    used = sorted(set(b"".join(b for x in data.values() for b in x)))
    symbols = np.zeros(256, np.int64)
    symbols[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1

    # of each language and order, how often each context stood before each symbol; a context is
    # a number in base ``size``, its latest byte the lowest digit
    if size ** (order + 1) >= 2**63:
        raise ValueError("order is too high for this many bytes")
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = []
    # of each context, its best place among those of a language
    places: dict[tuple[int, int], int] = {}
    for lang in languages:
        own, totals = [], []
        for k in range(order + 1):
            keys = []
            for b in data[lang]:
                s = symbols[np.frombuffer(b, np.uint8)]
                if len(s) > k:
                    context = np.zeros(len(s) - k, np.int64)
                    for j in range(k, 0, -1):  # the oldest byte first, so that it is the highest digit
                        context = context * size + s[k - j : len(s) - j]
                    keys.append(context * size + s[k:])
            found = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            own.append(found)
            contexts, where = np.unique(found[0] // size, return_inverse=True)
            sums = np.bincount(where, weights=found[1]) if len(contexts) else []
            totals += [(-int(n), k, c) for c, n in zip(contexts.tolist(), sums, strict=True)] if k else []
        for place, (_, k, c) in enumerate(heapq.nsmallest(nodes - 1, totals)):
            places[k, c] = min(place, places.get((k, c), place))
        seen.append(own)

    chosen = set(sorted(places, key=lambda x: (places[x], x))[: nodes - 1])
    # a context whose shorter one was cut off at an equal count goes with it
    for k in range(2, order + 1):
        chosen -= {(k, c) for kk, c in list(chosen) if kk == k and (k - 1, c % size ** (k - 1)) not in chosen}
    order_of = [(0, 0), *sorted(chosen)]
    number = {x: i for i, x in enumerate(order_of)}
    n = len(order_of)
    after = np.repeat(np.arange(2 * n)[:, None], size, 1)
    after[:n] += n
    for (k, c), i in number.items():
        if k:
            shorter = (k - 1, c % size ** (k - 1))
            after[number[shorter], c // size ** (k - 1)] = i

    costs = np.zeros((n, size, len(languages)))
    for at in range(len(languages)):
        counts = np.zeros((n, size))
        for k, (keys, amounts) in enumerate(seen[at]):
            rows = np.array([number.get((k, c), -1) for c in (keys // size).tolist()], int)
            some = rows >= 0
            counts[rows[some], (keys % size)[some]] += amounts[some]
        for i, (k, c) in enumerate(order_of):
            below = costs[number[(k - 1, c % size ** (k - 1))], :, at] if k else np.full(size, 8.0)
            total, different = counts[i].sum(), (counts[i] > 0).sum()
            if total:
                own = np.log2(total + different) - np.log2(np.maximum(counts[i], 1))
                below = np.where(counts[i] > 0, own, np.log2((total + different) / different) + below)
            costs[i, :, at] = below
    dtype = np.uint16 if 2 * n < 1 << 16 else np.int32
    return Model(languages, symbols.astype(np.uint8), after.astype(dtype), np.round(costs * _UNIT).astype(np.int32), order)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """By text and language, the code length in 1/1024 bits."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    some = [i for i, t in enumerate(texts) if t]
    if not some or not model.languages:
        return out
    n, size = len(model.costs), model.after.shape[1]
    # before each text stand as many bytes as a context has, whose symbol 0 no context holds
    gap, pad = b"\0" * model.order, model.order
    data = np.frombuffer(gap + gap.join(texts[i] for i in some), np.uint8)
    sizes = np.array([len(texts[i]) for i in some])
    starts = np.cumsum(sizes + pad) - sizes
    symbol = model.symbols[data].astype(np.int32)
    inside = np.ones(len(data), bool)
    for k in range(1, pad + 1):
        inside[starts - k] = False
    symbol[~inside] = 0
    flat, state = model.after.ravel(), np.zeros(len(data) - pad, np.int32)
    for k in range(1, pad + 1):
        state = flat[state * size + symbol[pad - k : len(data) - k]].astype(np.int32)
    state -= n * (state >= n)
    cost = model.costs.reshape(n * size, -1)[state * size + symbol[pad:]]
    cost[~inside[pad:]] = 0
    out[some] = np.add.reduceat(cost, starts - pad, axis=0, dtype=np.int64)
    return out


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, longest: int = LONGEST, most_bytes: int = MOST_BYTES, order: int = ORDER, nodes: int = NODES) -> Model:
    """The model of the labelled rows that are not held out."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    size = F.octet_length("text")
    fits = size <= longest
    sizes = own.groupBy("lang").agg(F.count_if(fits).alias("short"), F.count(F.lit(1)).alias("all"), F.coalesce(F.sum(F.when(fits, size)), F.lit(0)).alias("bytes")).orderBy("lang").collect()
    if not sizes:
        return fit({}, order=order, nodes=nodes)

    def share(row) -> int:
        """Of 2^30 hashes those that are picked."""
        n, held = (row["short"], row["bytes"]) if row["short"] else (row["all"], row["all"] * longest)
        return int((1 << 30) * min(1.0, per_language / n, most_bytes / len(sizes) / max(1, held)))

    # a map in the plan, so that texts are not dealt by language
    of = lambda value: F.try_element_at(F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], value(row))]), F.col("lang"))
    picked = own.withColumn("sliced", of(lambda row: row["short"] == 0)).withColumn("share", of(share))
    picked = picked.where((F.col("sliced") | fits) & (F.xxhash64("id", "text", F.lit("learn")).bitwiseAND(F.lit((1 << 30) - 1)) < F.col("share")))
    # a character has up to four bytes
    room = max(1, longest // 4)
    begin = F.pmod(F.xxhash64("id", F.lit("slice")), F.greatest(F.lit(1), F.length("text") - room + 1)).cast("int") + 1
    picked = picked.withColumn("text", F.when(F.col("sliced"), F.substring("text", begin, F.lit(room))).otherwise(F.col("text")))
    # equal texts go to the driver once, however many rows have them
    texts: dict[str, set[str]] = {row["lang"]: set() for row in sizes}
    for row in picked.select("lang", "text").distinct().collect():
        texts[row["lang"]].add(row["text"])
    return fit({lang: sorted(found) for lang, found in texts.items() if found}, order=order, nodes=nodes)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, lang_pred, score and bits_per_byte of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]

    def run(texts: list) -> dict:
        model = shipped.value
        known = np.array([t is not None and bool(model.languages) and _LETTER.search(t) is not None for t in texts])
        data = [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known, strict=True)]
        if not model.languages:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts)), "bits_per_byte": np.zeros(len(texts))}
        bits = code_lengths(model, data) / _UNIT
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        size = np.maximum(1, [len(b) for b in data])
        share = 1 / np.exp2((least[:, None] - bits) * np.minimum(1, SPAN / size)[:, None]).sum(1)
        return {"lang_pred": [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], "score": np.where(known, share, 0.0), "bits_per_byte": least / size}

    return map_texts(docs, run, fields, id_col=id_col, text_col=text_col, keep=keep)
