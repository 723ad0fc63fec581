"""MinHash near-duplicates: BagMinHash signatures, bands, and exact multiset overlap.

A text is the multiset of its runs of five words (lower-cased runs of letters, marks and digits;
all words together if there are fewer). Two texts are linked if their weighted Jaccard
similarity, sum of minima over sum of maxima of the counts, is ``least`` or more; a class is what
links join.

Signatures. An element of count w owns Poisson processes over the weight axis (0, w]. The axis
is cut into dyadic levels (0, 1], (1, 2], (2, 4], ...; a level has one process of a rate equal to
its width, its random numbers depend on the element and the level alone, and a point carries its
integer weight within the level, so that counts share exactly the points up to the smaller
count. A point falls on one of ``SIZE`` places and leaves its time there if it is the earliest. The
share of equal places is an unbiased estimate of the similarity. A process stops when its time
passes the latest place of its text, so a text costs about its distinct elements plus
SIZE * log(SIZE) points.

Candidates. Equal texts are one node from the start. Nodes meet in the buckets of ``BANDS`` bands.
1. In each bucket all nodes are compared with its most central node, the one with the most
   company over all bands: a row for each node and bucket, and in a group of edited copies that
   node is the original or next to it.
2. Links found so far are joined to classes. Two nodes of one class need no comparison of their
   own. Buckets that still hold several classes are the rest: all pairs across classes are
   compared. In a bucket above ``SMALL`` nodes only those outside its leader's class meet the
   others, in blocks: a pair counts in the first of its bands only and is left out if the block has
   already joined the two. A block gives links, never pairs.
All links are overlaps counted exactly from the texts. A pair whose estimated similarity is below
``GUESS`` is not counted out, in buckets of any size: that is eight standard errors below ``LEAST``,
which a link of ``LEAST`` meets once in 10^12 (the bands miss one three times in 10^6).

Nothing is collected, and no step holds a bucket or a class in one task: buckets are aggregated
by hash with partial sums, joins on buckets and leaders are split by Spark where they are skewed,
classes come from large-star and small-star rounds, and rows of texts and classes that have more than
a thousandth of all rows (of which there are fewer than a thousand) meet these by broadcast.

Defined results: null texts and texts without words are classes of their own; repeated rows are
copies; null ids are allowed (a class whose ids are all null has a null class id); an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import map_texts
from marlstone.llm.quality import WordIds
from marlstone.session import checkpointed, stored

#: Words of a shingle; the least similarity of a link.
WORDS, LEAST = 5, 0.8
#: Bands, rows of each, places of a signature.
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Nodes of a bucket whose pairs are simply joined, at most; nodes of a block in larger ones.
SMALL, BLOCK = 8, 1024
#: Estimated similarity from which a pair is counted out: eight standard errors below LEAST.
GUESS = 0.55

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def bag_min_hash(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """Signatures (times, by document and place) of multisets given as (doc, element, count)."""
    first = np.full(docs * size, np.inf)
    deepest = int(count.max(initial=1) - 1).bit_length()
    parts = []
    for level in range(deepest + 1):
        below = 1 << level >> 1  # the level is (below, below + width]
        some = count > below
        parts.append((doc[some], mixed(element[some] ^ np.uint64(level * int(_MIX1) % 2**64)), np.full(some.sum(), max(1, below)), count[some] - below))
    doc, seed, width, room = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        points = int(np.clip(4096 // len(doc), 1, 64))
        for_points = mixed(seed[:, None] + (np.arange(step, step + points).astype(np.uint64) * _MIX2)[None, :])
        step += points
        gaps = -np.log(((for_points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        draw = mixed(for_points)
        place = ((draw >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        # within its level a point has one of ``width`` weights; it counts up to the element's own
        weight = (draw & np.uint64(0xFFFFFFFF)) * width[:, None].astype(np.uint64) >> np.uint64(32)
        inside = weight.astype(np.int64) < room[:, None]
        where = (doc[:, None] * size + place)[inside]
        np.minimum.at(first, where, times[inside])
        time = times[:, -1]
        alive, back = np.unique(doc, return_inverse=True)
        latest = first.reshape(docs, size)[alive].max(axis=1)
        going = time < latest[back]
        doc, seed, width, room, time = doc[going], seed[going], width[going], room[going], time[going]
    return first.reshape(docs, size)


_ids = WordIds()


def sketch_texts(texts: list) -> dict:
    """node, keys and sig of each text; null for those without words."""
    cut = [[w.encode() for w in words_of(t)] if t else [] for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    numbers = _ids(cut)
    hashes = _ids.hashes[numbers]
    doc = np.repeat(np.arange(len(texts)), sizes)
    last = np.cumsum(sizes)
    # a shingle begins at each word that has WORDS - 1 behind it; in shorter texts at the first
    shingles = np.maximum(sizes - WORDS + 1, np.minimum(sizes, 1))
    of = np.repeat(np.arange(len(texts)), shingles)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(last - sizes, shingles)
    value = np.zeros(len(of), np.uint64)
    for k in range(WORDS):
        at = begin + k
        inside = at < last[of]
        value = mixed(value ^ np.where(inside, hashes[np.minimum(at, max(0, len(hashes) - 1))] if len(hashes) else 0, np.uint64(k)).astype(np.uint64))
    _, index, count = np.unique(mixed(value ^ (of.astype(np.uint64) * _GOLD)), return_index=True, return_counts=True)
    times = bag_min_hash(of[index], value[index], count, len(texts))
    bits = times.view(np.uint64)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys ^ bits.reshape(len(texts), BANDS, ROWS)[:, :, r])
    keys = mixed(keys ^ np.arange(BANDS).astype(np.uint64)[None, :]).view(np.int64)
    short = (mixed(bits) >> np.uint64(48)).astype("<u2")
    some = sizes > 0
    return {
        "node": [blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in cut],
        "keys": [k.tolist() if s else None for k, s in zip(keys, some, strict=True)],
        "sig": [k.tobytes() if s else None for k, s in zip(short, some, strict=True)],
    }


def bag_of(text: str) -> Counter:
    """The multiset of a text's shingles."""
    words = words_of(text)
    return Counter(tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1)))


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two multisets that aren't empty."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    common = sum(min(n, large[k]) for k, n in small.items() if k in large)
    return common / (x.total() + y.total() - common)


_bag = lru_cache(maxsize=64)(bag_of)


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts with words."""
    return similarity(_bag(a), _bag(b))


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose overlap is ``least`` or more. nodes: node, sig, text.

    The signatures are met first, so that texts move for pairs that may be links only."""

    def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(side.to_pylist()), "<u2").reshape(len(side), SIZE) for side in (a, b))
        return (x == y).sum(axis=1)

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(alike(batch["sig_a"], batch["sig_b"]) >= GUESS * SIZE))

    sigs, texts = nodes.select("node", "sig"), nodes.select("node", "text")
    met = pairs.join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b").join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
    likely = met.select("a", "b", "sig_a", "sig_b").mapInArrow(guessed, "a binary, b binary")
    both = likely.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [overlap(x.as_py(), y.as_py()) >= least for x, y in zip(batch["text_a"], batch["text_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


#: Links that a task of ``components`` takes, about.
LINKS = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: each node of the links, and the smallest node of its component.

    Rounds of large-star and small-star; each moves a node's neighbours to the smallest one with
    aggregates and joins, and is written to the shared checkpoint folder. They end when each node
    has one link, to a node that has none of its own. The number of tasks follows that of links.
    """
    # (u, v) with u > v, a row for each link
    edges = checkpointed(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        n, starts = edges.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        tasks = max(1, -(-n // LINKS))
        edges = edges.coalesce(tasks)
        if n == starts and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")).coalesce(tasks)
        larger = edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        edges = larger.union(least.where("u != m").select("u", F.col("m").alias("v"))).where("u != v").distinct().coalesce(tasks)
        least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        smaller = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(smaller.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _across_blocks(rest: DataFrame, least: float) -> DataFrame:
    """Links in large buckets; ``rest``: key, node, root, size, leading, sig, all_keys, text."""
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))).cast("int"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    # nodes outside the leader's class meet every block, all nodes meet every block of those
    outer = dealt.where("not leading").select("*", F.col("part").alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"), F.lit(True).alias("asks"))
    inner = dealt.select("*", F.col("part").alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("x"), F.lit(False).alias("asks"))
    rows = outer.unionByName(inner).select("key", "x", "y", "asks", "node", "root", "leading", "sig", "all_keys", "text")

    def run(table: pa.Table) -> pa.Table:
        key = table["key"][0].as_py()
        asks = np.array(table["asks"].to_pylist(), bool)
        node, root = np.array(table["node"].to_pylist(), object), np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        sig = np.stack([np.frombuffer(s, "<u2") for s in table["sig"].to_pylist()])
        keys = np.array(table["all_keys"].to_pylist(), np.int64)
        own = int(np.flatnonzero((keys == key).all(axis=0))[0])
        others, text = np.flatnonzero(~asks), table["text"].to_pylist()
        bags: dict[int, Counter] = {}

        def bag(i: int) -> Counter:
            if i not in bags:
                bags[i] = bag_of(text[i])
            return bags[i]

        joined = np.arange(root.max() + 1)  # classes that the block has joined so far
        a, b = [], []
        for i in np.flatnonzero(asks):
            alike = (sig[others] == sig[i]).sum(axis=1)
            fit = others[alike >= GUESS * sig.shape[1]][np.argsort(-alike[alike >= GUESS * sig.shape[1]], kind="stable")]
            fit = fit[~(keys[fit, :own] == keys[i, :own]).any(axis=1)]
            for j in fit:
                if joined[root[i]] != joined[root[j]] and similarity(bag(i), bag(j)) >= least:
                    a.append(node[i])
                    b.append(node[j])
                    joined[joined == joined[root[j]]] = joined[root[i]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary")


def met_evenly(rows: DataFrame, facts: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``facts``, a row for each ``key``, none of which crowds a task.

    Keys that have more than 1 / ``parts`` of all rows, fewer than ``parts`` therefore, are joined
    by broadcast, the others by hash."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    large = stored(counts.crossJoin(F.broadcast(total)).where(F.col("_n") * parts > F.col("_all")).select(key))  # one row
    apart = rows.join(F.broadcast(large.join(facts, key, "left")), key)
    return apart.unionByName(rows.join(F.broadcast(large), key, "left_anti").join(facts, key, "left"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, class_id (the class's smallest id), class_size, and
    representative (true for one row of each class) of every row."""
    held = {c: "text" if c == text_col else f"keep_{i}" for i, c in enumerate(keep)}
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in held.items() if h != "text"]).withColumn("row", F.monotonically_increasing_id())
    fields = [T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    # written once, so that row numbers hold and texts aren't sketched again
    rows = stored(map_texts(numbered, sketch_texts, fields, id_col="id", text_col="text", keep=("row", "text", *(h for h in held.values() if h != "text"))))
    roots = components(_links(rows, least))
    classed = rows.select("row", "id", F.coalesce("node", F.encode(F.concat(F.lit("row "), F.col("row").cast("string")), "utf-8")).alias("node"))
    classed = met_evenly(classed, roots, "node").select("row", "id", F.coalesce("root", "node").alias("root"))
    classes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("one"))
    found = met_evenly(classed, classes, "root").select("row", "id", "class_id", "class_size", (F.col("row") == F.col("one.row")).alias("representative"))
    if keep:
        found = found.drop("id").join(rows.select("row", "id", *held.values()), "row")
    return found.select(F.col("id").alias(id_col), *[F.col(h).alias(c) for c, h in held.items()], "class_id", "class_size", "representative")


def _links(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes that give the classes of all links that the bands find."""
    met = rows.where("node is not null").select("node", F.explode("keys").alias("key")).distinct()
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = stored(met.join(sizes, "key"))
    company = crowd.groupBy("node").agg(F.sum("size").alias("company"))
    leaders = crowd.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    first = rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row")).join(company.select("node"), "node", "left_semi")
    held = stored(rows.select("row", "text", "keys", "sig").join(first, "row"))
    nodes = held.select("node", "sig", "text")
    pairs = crowd.join(leaders, "key").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_verified(pairs, nodes, least))

    known = crowd.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_keys = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    # pairs with the leader were counted out already
    rest = stored(known.join(mixed_keys, "key").join(leaders, "key"))
    few = rest.where(F.col("size") <= SMALL).where("node != leader").select("key", "node", "root")
    small = few.join(few.withColumnsRenamed({"node": "b", "root": "root_b"}), "key").where("root != root_b and node < b").select(F.col("node").alias("a"), "b").distinct()
    many = rest.where(F.col("size") > SMALL)
    leading = known.select("key", F.col("node").alias("leader"), F.col("root").alias("leading_root"))
    many = many.join(leading, ["key", "leader"]).select("key", "node", "root", "size", (F.col("root") == F.col("leading_root")).alias("leading")).join(held.select("node", "sig", F.col("keys").alias("all_keys"), "text"), "node")
    return links.union(_verified(small, nodes, least)).union(_across_blocks(many, least))
