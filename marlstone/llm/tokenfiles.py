"""Token-id files: an adaptive context-mixing range coder over ids, in blocks.

A file holds the ids of documents, one after another, cut into blocks of ``BLOCK`` ids. Every
block starts from the same state (the file's order-0 table, equal classes and empty predictions),
has its own checksum, and can be decoded without the others.

The probability of an id mixes three predictions. Order 2 and order 1 each name the id that last
followed the same two ids (the same id) in the block, with a confidence of 0 to 3. Order 0 parts
the file's ids, most frequent first, into ``CLASSES`` of equal weight; how often each class comes is
learned within the block, and within a class the file's counts hold. The weights of the
predictions are learned as well: for each pair of confidences a block counts which prediction
held. Weights and classes follow their counts from time to time, while coding. A range coder with
62 bits turns that into words of 32: one step decides among the two predictions and the classes, a
second one gives the id within its class where neither held. Sums are integers, so every machine
decodes alike.

A coder must go through a block id by id, but the blocks of a file don't wait for each other:
step t of up to ``LANES`` of them is one set of numpy operations over an array with an element for
each block. How many go together changes nothing in the file.

File: magic, sizes (numbers of ids, documents, blocks, used ids, bytes of lengths and table), the
lengths of documents (zlib), the order-0 table (zlib), for each block its length and crc32, the
crc32 of all that, and the blocks. Where a checksum fails, an error names the block or the head.

Files are values of a binary column, written as Parquet by Spark, so they go to whatever store
Spark can reach; a task's partial output never counts. Rows are dealt out by ranges of the id,
files are numbered by their range and place in it, and what a document's place needs from other
files is a running sum over one row for each range, and within a range one for each file.

Defined results: null is the empty text, with the end id alone; null ids come first; repeated rows
and equal ids are kept, by hashes of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import chunks
from marlstone.llm.pieces import TOKEN_CHUNK, ended, library_encoder
from marlstone.session import shared_folder

MAGIC = b"MTF3"
#: Ids of a block.
BLOCK = 2048
#: Blocks that are coded in step, at most. Their tables should stay in the caches.
LANES = 3072
#: Classes of order 0.
CLASSES = 8
#: Ids of a file, at most, unless one document has more. Bounds what a task holds.
FILE = 6 << 20
#: Files whose places are broadcast, at most.
MOST_FILES = 100_000
#: Slots of each prediction table of a block; states of a block's weights; shift of a hash.
_SLOTS, _STATES, _SHIFT = 256, 32, 56
_HASH = np.array([0x9E3779B97F4A7C15], dtype=np.uint64).view(np.int64)
#: The coder's range at first, and below which it moves on by a word: a step divides it by 2^26 at most.
_FULL, _LOW = 1 << 62, 1 << 30
#: Steps after which weights and classes follow their counts: multiples of the first, and these.
_REFRESH, _EARLY = 256, (16, 32, 64, 128)
#: Steps whose ids are put in order at once.
_TURN = 64
#: Bits of the parts of 1 by which a class's ids, and (with 8 bits of weights) classes, are told.
_ID_BITS, _CLASS_BITS = 16, 6
_HEAD = struct.Struct("<4sQIIIII")


class Order0:
    """What order 0 knows of a file: its used ids and their counts of 1 to 65535, which are stored.

    known: of each id its class, what stands before it in its class and its share there, less 1, both
    of 2^16, in order of rank, as one number; id_at: the id of each class and part."""

    def __init__(self, used: np.ndarray, counts: np.ndarray):
        self.used, self.counts = used, counts
        rank = np.lexsort((used, -counts))
        ids, weight = used[rank], counts[rank].astype(np.int64)
        kind = (np.cumsum(weight) - weight) * CLASSES // weight.sum()
        size, total = np.bincount(kind, minlength=CLASSES), np.bincount(kind, weight, CLASSES).astype(np.int64)
        share = 1 + weight * ((1 << _ID_BITS) - size[kind]) // total[kind]
        first = np.cumsum(size) - size
        some = size > 0  # what is left over goes to the class's most frequent id
        share[first[some]] += (1 << _ID_BITS) - np.add.reduceat(share, first[some])
        ends = np.cumsum(share)
        before = ends - share - (np.cumsum(some) - 1)[kind] * (1 << _ID_BITS)
        self.known = np.zeros(int(used[-1]) + 1, np.int64)
        self.known[ids] = kind << 32 | before << 16 | share - 1
        self.id_at = np.zeros((CLASSES, 1 << _ID_BITS), np.uint16)
        self.id_at[some] = np.repeat(ids, share).reshape(-1, 1 << _ID_BITS)
        self.id_at = self.id_at.ravel()

    @classmethod
    def of(cls, ids: np.ndarray) -> Order0:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        return cls(used, np.maximum(1, counts[used] * 65535 // counts.max()))


class _Classes:
    """The learned shares, of 2^6, of the classes of order 0 in each block."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes) * CLASSES
        self.counts, self.noted = np.full(lanes * CLASSES, 4, np.int32), []
        self.set()

    def set(self) -> None:
        ends = np.cumsum(self.counts.reshape(-1, CLASSES), axis=1)
        ends = np.arange(1, CLASSES + 1) + ends * ((1 << _CLASS_BITS) - CLASSES) // ends[:, -1:]
        self.share = np.diff(ends, axis=1, prepend=0).ravel()
        self.before = ends.ravel() - self.share
        self.at: np.ndarray | None = None

    def class_at(self, lane: np.ndarray, part: np.ndarray) -> np.ndarray:
        if self.at is None:
            self.at = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), len(self.base)), self.share)
        return self.at.take((lane << _CLASS_BITS) + part)

    def after(self, step: int, number: np.ndarray) -> None:
        """number: CLASSES * block + class, of the blocks whose id came from order 0."""
        self.noted.append(number)
        if step % _REFRESH == 0 or step in _EARLY:
            self.counts += np.bincount(np.concatenate(self.noted), minlength=len(self.counts)).astype(np.int32)
            self.noted = []
            self.set()
            self.counts -= self.counts >> 5


class _Weights:
    """The learned weights of all blocks: shares of 256 for order 2 and order 1 by state."""

    def __init__(self, lanes: int):
        state = np.arange(_STATES)
        second, first, same = state >> 2 & 3, state & 3, state >> 4
        start = np.stack([np.array([2, 6, 14, 30])[second] + 4 * same, np.array([2, 4, 8, 12])[first] * (1 - same) + 1, np.full(_STATES, 12)])
        self.size = np.int64(lanes * _STATES)  # of the counts of one prediction, or of none
        self.counts, self.noted = np.tile(start, lanes).ravel(), []
        self.set()

    def set(self) -> None:
        n2, n1, n0 = self.counts.astype(np.int32).reshape(3, -1)
        total = n2 + n1 + n0
        two = np.clip((n2 << 8) // total, 4, 200).astype(np.int64)
        both = two + np.clip((n1 << 8) // total, 4, 240 - two)
        # order 2, both, and the classes, so many of 2^14 (2^14, 2^8) as one number
        self.shares = two << _CLASS_BITS | both << _CLASS_BITS + 16 | (256 - both) << 32

    def after(self, step: int, state: np.ndarray, kind: np.ndarray) -> None:
        """Of each block its state, and which prediction held."""
        self.noted.append(state + kind * self.size)
        if step % _REFRESH == 0 or step in _EARLY:
            self.counts += np.bincount(np.concatenate(self.noted), minlength=len(self.counts))
            self.noted = []
            self.set()
            self.counts -= self.counts >> 5


class _Predictions:
    """What order 2 and order 1 predict in each of ``lanes`` blocks. Contexts of the same last id are
    beside each other, in 64 bytes: eight slots for order 1, by a hash of that id, and eight for
    order 2, by one of both ids."""

    def __init__(self, lanes: int):
        self.slots = np.zeros(lanes * 2 * _SLOTS, np.int32)
        self.base, self.state_base = np.arange(lanes) * 2 * _SLOTS, np.arange(lanes) * _STATES
        self.before, self.hashed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.weights = _Weights(lanes)

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids of order 2 and 1, and the shares of the weights."""
        own = self.before * _HASH
        place = (own.view(np.uint64) >> _SHIFT).view(np.int64)
        line = self.base + (place & -8)
        self.at1 = line + place
        self.at2 = line + (place & -8) + 8 + ((own * 31 + self.hashed).view(np.uint64) >> 61).view(np.int64)
        self.hashed = own
        self.slot1, self.slot2 = self.slots.take(self.at1), self.slots.take(self.at2)
        one, two = self.slot1 & 0xFFFF, self.slot2 & 0xFFFF
        state = (self.slot2 >> 16 << 2) + (self.slot1 >> 16) + ((one == two).view(np.uint8) << 4)
        self.state = self.state_base + state
        return two, one, self.weights.shares.take(self.state)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, kind: np.ndarray, step: int) -> None:
        most = ids | 0x30000
        for at, slot, hit in ((self.at2, self.slot2, hit2), (self.at1, self.slot1, hit1)):
            # a step of confidence up, 3 at most, or down, and below 0 the new id
            moved = np.minimum(slot + ((hit.astype(np.int32) << 17) - 0x10000), most)
            self.slots[at] = np.where(moved < 0, ids, moved)
        self.weights.after(step, self.state, kind)
        self.before = ids.astype(np.int64)


def encode_blocks(ids: np.ndarray, table: Order0) -> list[bytes]:
    """The bytes of each block. The last one is filled up with its last id."""
    lanes = -(-len(ids) // BLOCK)
    width = min(BLOCK, len(ids))
    grid = np.full(lanes * width, ids[-1], np.uint16)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, width)
    return [block for a in range(0, lanes, LANES) for block in _encode_lanes(grid[a : a + LANES], table)]


def _encode_lanes(grid: np.ndarray, table: Order0) -> list[bytes]:
    lanes, width = grid.shape
    # the words of all blocks, as they come, and the blocks they are of; of 33 bits, as a carry may be in them
    words, owners, numbers = [], [], np.arange(lanes, dtype=np.uint16)
    low, reach = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
    known, classes = _Predictions(lanes), _Classes(lanes)
    for t in range(width):
        if t % _TURN == 0:
            steps = np.ascontiguousarray(grid[:, t : t + _TURN]).T.astype(np.int32, order="C")
        x = steps[t % _TURN]
        two, one, shares = known.look()
        part = reach >> 8 + _CLASS_BITS
        edge2, edge1 = part * (shares & 0xFFFF), part * (shares >> 16 & 0xFFFF)
        part *= shares >> 32
        hit2, hit1 = x == two, x == one
        kind = (~hit2).view(np.uint8) * (2 - hit1.view(np.uint8))
        only1, rest = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        own = table.known.take(x.take(rest))
        number = classes.base.take(rest) + (own >> 32)
        unit = part.take(rest)
        part = unit * classes.share.take(number) >> _ID_BITS
        low[only1] += edge2.take(only1)
        low[rest] += edge1.take(rest) + unit * classes.before.take(number) + part * (own >> 16 & 0xFFFF)
        reach = edge2
        reach[only1] = edge1.take(only1) - edge2.take(only1)
        reach[rest] = part * ((own & 0xFFFF) + 1)
        short = np.flatnonzero(reach < _LOW)
        some = low.take(short)
        words.append(some >> 30)
        owners.append(numbers.take(short))
        low[short] = (some & _LOW - 1) << 32
        reach[short] = reach.take(short) << 32
        known.learn(x, hit2, hit1, kind, t + 1)
        classes.after(t + 1, number)
    owner = np.concatenate([*owners, numbers, numbers])
    out = np.concatenate([*words, low >> 30, (low & _LOW - 1) << 2]).take(np.argsort(owner, kind="stable"))
    while (over := np.flatnonzero(out >> 32)).size:  # a carry goes to the word before; no block begins with one
        out[over] &= 0xFFFFFFFF
        out[over - 1] += 1
    data, ends = out.astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(owner, minlength=lanes))
    return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]


def decode_blocks(blocks: list[bytes], width: int, table: Order0) -> np.ndarray:
    """The ids of the blocks, ``width`` of each, one block after another."""
    return np.concatenate([_decode_lanes(blocks[a : a + LANES], width, table) for a in range(0, len(blocks), LANES)])


def _decode_lanes(blocks: list[bytes], width: int, table: Order0) -> np.ndarray:
    lanes = len(blocks)
    words = np.frombuffer(b"".join(blocks), "<u4").astype(np.int64)
    get = np.cumsum([0, *(len(b) // 4 for b in blocks[:-1])])
    # the range has 62 bits, so what follows stands two bits before the words' borders
    code = words.take(get) << 30 | words.take(get + 1) >> 2
    words[:-1] = (words[:-1] & 3) << 30 | words[1:] >> 2
    get += 1
    reach = np.full(lanes, _FULL, np.int64)
    known, classes = _Predictions(lanes), _Classes(lanes)
    found = np.zeros((lanes, width), np.uint16)
    steps = np.zeros((_TURN, lanes), np.uint16)
    for t in range(width):
        two, one, shares = known.look()
        part = reach >> 8 + _CLASS_BITS
        edge2, edge1 = part * (shares & 0xFFFF), part * (shares >> 16 & 0xFFFF)
        part *= shares >> 32
        past2, past1 = code >= edge2, code >= edge1
        kind = past2.view(np.uint8) + past1.view(np.uint8)
        only1, rest = np.flatnonzero(kind == 1), np.flatnonzero(past1)
        left = code.take(rest) - edge1.take(rest)
        unit = part.take(rest)
        held = classes.class_at(rest, np.minimum(_quotient(left, unit), (1 << _CLASS_BITS) - 1)).astype(np.int64)
        number = classes.base.take(rest) + held
        left -= unit * classes.before.take(number)
        part = unit * classes.share.take(number) >> _ID_BITS
        new = table.id_at.take((held << _ID_BITS) + np.minimum(_quotient(left, part), (1 << _ID_BITS) - 1))
        own = table.known.take(new)
        x = two
        x[only1], x[rest] = one.take(only1), new
        code[only1] -= edge2.take(only1)
        code[rest] = left - part * (own >> 16 & 0xFFFF)
        reach = edge2
        reach[only1] = edge1.take(only1) - edge2.take(only1)
        reach[rest] = part * ((own & 0xFFFF) + 1)
        short = np.flatnonzero(reach < _LOW)
        where = get.take(short)
        code[short] = code.take(short) << 32 | words.take(where, mode="clip")
        get[short] = where + 1
        reach[short] = reach.take(short) << 32
        steps[t % _TURN] = x
        if t % _TURN == _TURN - 1 or t == width - 1:
            found[:, t - t % _TURN : t + 1] = steps[: t % _TURN + 1].T
        known.learn(x, ~past2, x == one, kind, t + 1)
        classes.after(t + 1, number)
    return found.reshape(-1)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of numbers that aren't negative."""
    return (a.view(np.uint64) // b.view(np.uint64)).view(np.int64)


def pack_file(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The file of some ids (below 2^16), cut into documents of the given sizes."""
    order0 = Order0.of(ids)
    blocks = encode_blocks(ids, order0)
    table = zlib.compress(np.diff(order0.used, prepend=0).astype("<u2").tobytes() + order0.counts.astype("<u2").tobytes(), 6)
    lengths = zlib.compress(sizes.astype("<u4").tobytes(), 1)
    directory = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    head = _HEAD.pack(MAGIC, len(ids), len(sizes), len(blocks), len(order0.used), len(lengths), len(table)) + lengths + table + directory
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes of documents of a file."""
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a token file")
    _, n, documents, blocks, n_used, n_lengths, n_table = _HEAD.unpack_from(data)
    at = _HEAD.size + n_lengths + n_table
    end = at + 8 * blocks
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("the head of a token file is damaged")
    sizes = np.frombuffer(zlib.decompress(data[_HEAD.size : at - n_table]), "<u4").astype(np.int64)
    table = np.frombuffer(zlib.decompress(data[at - n_table : at]), "<u2").astype(np.int64)
    directory, place, found = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(-1, 2), end + 4, []
    for number, (length, crc) in enumerate(directory.tolist()):
        block = data[place : place + length]
        if zlib.crc32(block) != crc:
            raise ValueError(f"block {number} of a token file is damaged")
        found.append(block)
        place += length
    ids = decode_blocks(found, min(BLOCK, n), Order0(np.cumsum(table[:n_used]), table[n_used:]))[:n]
    if len(sizes) != documents or sizes.sum() != n:
        raise ValueError("a token file's lengths don't add up")
    return ids, sizes


def to_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, most: int = FILE) -> DataFrame:
    """``part, number, n_ids, ids, content``: files in ascending order of (part, number), with the
    ids of their documents. Every text is followed by ``end_id``."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("content", T.BinaryType())])
    # ranges are sampled by the driver, which so gets hashes instead of texts; rows that are equal in
    # both can stand in any order, so their places part them, however many there are
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("id", "hash", "place").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        if encoder.dtype != np.dtype("<u2"):
            raise ValueError("token files hold ids below 65536")
        part, number, keys, coded, lengths, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made() -> pa.RecordBatch:
            flat = np.concatenate(coded)
            content = pack_file(flat, np.concatenate(lengths))
            names = ["part", "number", "n_ids", "ids", "content"]
            values = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([content], pa.binary())], names=names)

        for rows in chunks(batches, "text", TOKEN_CHUNK):
            ids, sizes = ended(*encoder([t or "" for t in rows["text"].to_pylist()]), end_id)
            keys.append(rows["id"])
            coded.append(ids)
            lengths.append(sizes)
            size += len(ids)
            if size >= most:
                yield made()
                number, keys, coded, lengths, size = number + 1, [], [], [], 0
        if size:
            yield made()

    return ordered.mapInArrow(run, schema)


def from_files(files: DataFrame, id_col: str, id_type: T.DataType) -> DataFrame:
    """``id_col, start, ids``: documents of the files, ids as little-endian unsigned 32-bit integers."""
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range, as many as the session has shuffle partitions, then files within ranges
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    order = files.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("within")).join(F.broadcast(ranges), "part")
    order = order.select("part", "number", (F.col("base") + F.col("within")).alias("base"))
    # a few bytes for each file; with very many files the contents are shuffled instead
    placed = files.join(F.broadcast(order) if files.count() <= MOST_FILES else order, ["part", "number"])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = unpack_file(batch["content"][k].as_py())
                keys, ends, base = batch["ids"][k].values, np.cumsum(sizes), batch["base"][k].as_py()
                for a in range(0, len(sizes), 1000):
                    b = min(a + 1000, len(sizes))
                    first = int(ends[a] - sizes[a])
                    wide = ids[first : ends[b - 1]].astype("<u4")
                    offsets = np.concatenate([[0], (ends[a:b] - first) * 4]).astype(np.int32)
                    held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(base + ends[a:b] - sizes[a:b]), held], names=["id", "start", "ids"])

    return placed.select("base", "ids", "content").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def write_and_read(docs: DataFrame, path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the token files of ``docs`` to ``folder`` and gives what they hold (see ``from_files``)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    to_files(docs, path, id_col=id_col, text_col=text_col, end_id=end_id).write.parquet(folder)
    return from_files(spark.read.parquet(folder), id_col, docs.schema[id_col].dataType)
