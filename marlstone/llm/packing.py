"""Best-two-fit packing of token sequences.

A document's ids, the end id last, form one piece; only longer ones are cut, into pieces of
``size``, of which the last may be shorter. A bin takes the longest unpacked piece, then again
and again the longest that still fits. Where a gap stays, the bin's smallest piece is replaced by
two unpacked ones that together fill the gap, with its room added, more tightly; that repeats
while it helps. Pieces of equal length are interchangeable, so a bin is found from counts by
length, with a table of the longest available length up to each number.

Packing needs lengths only. Pieces are dealt by a hash into groups of about ``group`` pieces;
groups are packed apart, at the cost of about one bin each that isn't full. The number of groups
follows from the documents and their bytes (``expected_pieces``), so a group, and what a task
holds, stays as small on any input, also where documents are very long; and no key can crowd one
group: the hash also takes the row's place in its task.

Defined results: null is the empty text, one piece with the end id; repeated rows are packed one
by one; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import chunks
from marlstone.llm.pieces import ended, library_encoder

#: Pieces of a group, about, and bytes of a token as they are guessed from. Where tokens are
#: shorter, down to a byte, groups get four times as many at most.
GROUP, TOKEN_BYTES = 8192, 4
#: Bytes of text that are encoded at once, and entries that the encoder keeps: fewer than for token
#: files, as other stages' workers live beside these.
ENCODED, KEPT = 4 << 20, 200_000


def cut_documents(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, piece, start, length, ids``, the columns ``keep``, and ``row`` (any number).

    ids are little-endian unsigned 32-bit integers. A row of ``keep`` is given with each piece.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    kept = ["_id", *(f"_keep_{i}" for i in range(len(keep)))]
    schema = T.StructType([*(T.StructField(c, own.schema[c].dataType) for c in kept), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = library_encoder(path, True, KEPT), TaskContext.get().partitionId() << 33
        for part in chunks(batches, "_text", ENCODED):
            flat, sizes = ended(*encoder([t or "" for t in part["_text"].to_pylist()]), end_id)
            flat = flat.astype("<u4")
            number = -(-sizes // size)
            of = np.repeat(np.arange(len(sizes)), number)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            length = np.minimum(size, sizes[of] - piece * size)
            offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(of)) for c in kept), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), ids, pa.array(row + np.arange(len(of)))], names=schema.names)
            row += len(of)

    out = own.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "piece", "start", "length", "ids", "row")


def expected_pieces(docs: DataFrame, *, size: int = 2048, text_col: str = "text") -> int:
    """About how many pieces the documents will be cut into."""
    n, held = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return n + held // (TOKEN_BYTES * size)


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins, as lists of numbers of pieces; every bin's lengths add up to ``size`` at most."""
    if len(lengths) and not 0 < lengths.min() <= lengths.max() <= size:
        raise ValueError("a piece is empty or longer than a bin")
    counts = np.bincount(lengths, minlength=size + 1)
    every = np.arange(size + 1)
    fits = np.maximum.accumulate(np.where(counts > 0, every, 0))  # the longest available up to each number

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            end = n + int(np.argmax(fits[n:] > n)) if fits[-1] > n else size + 1
            fits[n:end] = fits[n - 1]

    def give(n: int) -> None:
        counts[n] += 1
        if counts[n] == 1:
            end = n + int(np.argmax(fits[n:] > n)) if fits[-1] > n else size + 1
            fits[n:end] = n

    def pair(least: int, gap: int) -> tuple[int, int] | None:
        """Two available lengths with the largest sum above ``least`` and up to ``gap``."""
        longer = np.flatnonzero(counts[: gap]) if gap > 1 else every[:0]
        if not len(longer):
            return None
        other = fits[gap - longer]
        alone = (other == longer) & (counts[longer] < 2)
        other = np.where(alone, fits[np.maximum(longer - 1, 0)], other)
        sums = np.where(other > 0, longer + other, 0)
        best = int(sums.argmax())
        return (int(longer[best]), int(other[best])) if sums[best] > least else None

    bins: list[list[int]] = []
    while fits[size]:
        held: list[int] = []
        gap = size
        while gap and fits[gap]:
            n = int(fits[gap])
            take(n)
            held.append(n)
            gap -= n
        while gap and fits[size]:
            smallest = held[-1]
            found = pair(smallest, gap + smallest)
            if not found:
                break
            held.pop()
            for n in found:
                take(n)
            give(smallest)
            gap += smallest - sum(found)
            held = sorted(held + list(found), reverse=True)
        bins.append(held)
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    return [[by_length[n].pop() for n in held] for held in bins]


def pack(pieces: DataFrame, *, expected: int, size: int = 2048, group: int = GROUP, row_col: str = "row", length_col: str = "length") -> DataFrame:
    """``pieces`` without ``row_col`` and with sequence_id and offset.

    expected: about how many pieces there are, which sets the number of groups. row_col: any number
    that tells the rows apart, as evenly as the groups shall be.
    """
    groups = max(1, -(-expected // group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(row_col), F.lit(groups)))
    names = [c for c in pieces.columns if c != row_col]
    schema = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(row_col)  # rows come in any order; the result doesn't depend on it
        lengths = table[length_col].to_numpy()
        bins = best_two_fit(lengths, size)
        order = np.array([i for held in bins for i in held])
        filled = np.array([len(held) for held in bins])
        sequence = np.repeat(np.arange(len(bins)), filled) + (table["_group"][0].as_py() << 32)
        ends = np.cumsum(lengths[order])
        first = np.repeat(np.concatenate([[0], ends[np.cumsum(filled)[:-1] - 1]]), filled)
        out = table.select(names).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(ends - lengths[order] - first))

    return dealt.groupBy("_group").applyInArrow(run, schema)
