"""Media columns: copies of images, also cropped, turned or edited ones, by local descriptors.

1. Each image (binary PGM or PPM) is described by ``CORNERS`` Harris corners in each of ``SCALES``
   sizes. A corner's orientation is that of its patch's centre of brightness; 192 binary tests of
   the smoothed patch, turned by that orientation, make its descriptor.
2. The descriptor is cut into ``TABLES`` parts of 32 bits, the keys of Hamming tables. Corners that
   share a key, and whose descriptors differ in ``DISTANCE`` bits at most, match. In a bucket of
   up to ``SMALL`` corners all pairs of images meet; in each larger one all meet the first corner.
3. A match proposes a turn, a size and a shift. Two images are linked if ``INLIERS`` corners or
   more, not sharing a place, agree on these.
4. Classes are what links join. In buckets that still hold several classes, all pairs of corners
   across classes are then compared, in blocks, and vote again, so no class is lost that all pairs
   of all buckets would join. Two images of one class are not compared any more.

Rows are dealt by key; partial sums come before each shuffle; nothing is collected.

Defined results: null or undecodable bytes, and images without corners, are classes of their own;
repeated rows are copies of each other (if they have corners); a null id is a class of its own. Of
equally strong corners at the end of an image's list some are kept, by numpy's partition, which
gives equal images the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.llm.common import chunks
from marlstone.llm.neardup import components, met_evenly
from marlstone.session import stored

CORNERS, SCALES = 24, (1.0, 0.8)
RADIUS, TESTS, TURNS = 12, 192, 36
TABLES, DISTANCE, INLIERS, SMALL = TESTS // 32, 48, 4, 16
#: Bytes of images that are described at once, unless one has more: a pixel takes some 100 bytes meanwhile, more where corners are close.
AT_ONCE = 256 << 10
#: Corners of a block in larger buckets, about.
BLOCK = 1024
_HEADER = regex.compile(rb"P([56])\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s", regex.A)


def decode_pnm(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM with 8 bits a sample; None if it isn't one."""
    m = _HEADER.match(data or b"")
    if not m or not 0 < int(m[4]) < 256:
        return None
    width, height, depth = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    held = np.frombuffer(data, np.uint8, offset=m.end())
    if not width * height or len(held) < width * height * depth:
        return None
    image = held[: width * height * depth].reshape(height, width, depth).astype(np.float32).mean(axis=2)
    return image * (255 / int(m[4]))


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, over the last two axes."""
    if scale == 1:
        return image
    for axis in (-2, -1):
        n = image.shape[axis]
        at = np.clip((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).astype(np.float32)
        shape = [1] * image.ndim
        shape[axis] = -1
        part = part.reshape(shape)
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return image


def _box(image: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1 pixels, edges repeated."""
    for axis in (-2, -1):
        pad = [(0, 0)] * image.ndim
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(image, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = image.shape[axis]
        image = (np.take(total, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(total, np.arange(n), axis)).astype(np.float32)
    return image


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """The patch's pixels, and the tests' pixels (turn, test, end, y and x), both from the corner."""
    span = np.arange(-RADIUS, RADIUS + 1)
    disc = np.array([(y, x) for y in span for x in span if y * y + x * x <= RADIUS * RADIUS])
    points = np.random.default_rng(20).normal(0, RADIUS / 2, (TESTS, 2, 2))
    size = np.hypot(*np.moveaxis(points, -1, 0))[..., None]
    points *= np.minimum(1, (RADIUS - 0.5) / np.maximum(size, 1e-9))
    turn = 2 * np.pi * np.arange(TURNS) / TURNS
    y, x = points[..., 0], points[..., 1]
    cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    return disc, np.stack([np.round(y * cos + x * sin), np.round(x * cos - y * sin)], axis=-1).astype(int)


def describe(images: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of images of one size: image, place (y, x, in pixels), turn, scale, bits."""
    disc, tests = _patterns()
    out: dict[str, list] = {k: [] for k in ("image", "y", "x", "turn", "scale", "bits")}
    for number, scale in enumerate(SCALES):
        own = resized(images.astype(np.float32), scale)
        height, width = own.shape[1:]
        edge = RADIUS + 1
        if min(height, width) <= 2 * edge:
            continue
        gy, gx = np.gradient(own, axis=(1, 2))
        yy, xx, yx = _box(gy * gy, 3), _box(gx * gx, 3), _box(gy * gx, 3)
        power = yy * xx - yx * yx - 0.05 * (yy + xx) ** 2
        inner = power[:, edge:-edge, edge:-edge]
        best = inner > 1e3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    best &= inner >= power[:, edge + dy : height - edge + dy, edge + dx : width - edge + dx]
        strength = np.where(best, inner, 0).reshape(len(own), -1)
        most = min(CORNERS, strength.shape[1])
        chosen = np.argpartition(strength, -most, axis=1)[:, -most:]
        image, k = np.nonzero(np.take_along_axis(strength, chosen, 1) > 0)
        at = chosen[image, k]
        y, x = at // inner.shape[2] + edge, at % inner.shape[2] + edge
        patch = own[image[:, None], y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        angle = np.arctan2(patch @ disc[:, 0].astype(np.float32), patch @ disc[:, 1].astype(np.float32))
        turn = np.round(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
        smooth = _box(own, 1)
        ends = smooth[image[:, None, None], y[:, None, None] + tests[turn, :, :, 0], x[:, None, None] + tests[turn, :, :, 1]]
        out["bits"].append(np.packbits(ends[:, :, 0] < ends[:, :, 1], axis=1))
        out["image"].append(image)
        out["y"].append(y / scale)
        out["x"].append(x / scale)
        out["turn"].append(angle)
        out["scale"].append(np.full(len(y), number))
    empty = {"bits": np.zeros((0, TESTS // 8), np.uint8)}
    return {k: np.concatenate(v) if v else empty.get(k, np.zeros(0)) for k, v in out.items()}


#: A corner: its number in the image, place in pixels, turn in radians, scale, and descriptor.
CORNER = "struct<corner:int,y:float,x:float,turn:float,scale:int,tables:array<int>>"


def described(media: DataFrame, *, media_col: str) -> DataFrame:
    """``media`` with the image's corners in place of its bytes; an empty array if there are none."""
    names = [c for c in media.columns if c != media_col]
    schema = T.StructType([*(media.schema[c] for c in names), T.StructField("corners", T._parse_datatype_string(f"array<{CORNER}>"))])
    arrow = to_arrow_schema(schema)
    fields = list(arrow.field("corners").type.value_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, media_col, AT_ONCE):
            by_shape: dict[tuple, list] = {}
            for i, data in enumerate(part[media_col].to_pylist()):
                if (image := decode_pnm(data)) is not None:
                    by_shape.setdefault(image.shape, []).append((i, image))
            held: dict[str, list] = {k: [] for k in ("image", "y", "x", "turn", "scale", "bits")}
            for own in by_shape.values():
                found = describe(np.stack([image for _, image in own]))
                found["image"] = np.array([i for i, _ in own])[found["image"].astype(int)]
                for k, v in held.items():
                    v.append(found[k])
            of = np.concatenate(held["image"]).astype(int) if held["image"] else np.zeros(0, int)
            order = np.argsort(of, kind="stable")
            sizes = np.bincount(of, minlength=part.num_rows)
            bits = (np.concatenate(held["bits"])[order] if len(of) else np.zeros((0, TESTS // 8), np.uint8)).copy().view("<i4")
            tables = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * TABLES), pa.array(bits.reshape(-1)))
            number = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = {k: np.concatenate(held[k])[order] if len(of) else np.zeros(0) for k in ("y", "x", "turn", "scale")}
            columns = [pa.array(number.astype(np.int32)), *(pa.array(flat[k].astype(np.float32)) for k in ("y", "x", "turn")), pa.array(flat["scale"].astype(np.int32)), tables.cast(fields[-1].type)]
            structs = pa.StructArray.from_arrays(columns, fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), structs).cast(arrow.field("corners").type)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), lists], schema=arrow)

    return media.mapInArrow(run, schema)


_OWN = ("row", "corner", "y", "x", "turn", "scale", "tables")
_MATCH = [f"{x}_{c}" for x in "ab" for c in _OWN if c != "tables"]


def _as(df: DataFrame, end: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{end}_{c}" for c in _OWN})


def _near(df: DataFrame) -> DataFrame:
    apart = F.aggregate(F.zip_with("a_tables", "b_tables", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return df.where(apart <= DISTANCE)


def _met(found: DataFrame) -> DataFrame:
    """The corners (b_...) of each bucket (key, size) of two images or more, and the bucket's first
    corner (a_...)."""
    keyed = found.select("row", "corner", F.posexplode("tables").alias("table", "part")).select(F.col("row").alias("b_row"), F.col("corner").alias("b_corner"), (F.shiftleft(F.col("part").cast("long"), 4) + F.col("table")).alias("key"))
    # a bucket of one image has no pairs
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("b_row", "b_corner")).alias("first"), F.max("b_row").alias("high")).where("first.b_row < high")
    sizes = sizes.select("key", "size", F.col("first.b_row").alias("a_row"), F.col("first.b_corner").alias("a_corner")).join(_as(found, "a"), ["a_row", "a_corner"])
    return stored(keyed.join(sizes, "key").join(_as(found, "b"), ["b_row", "b_corner"]))


def _own(crowd: DataFrame, end: str, *more: str) -> DataFrame:
    """The buckets' corners without their first ones, named by ``end``."""
    return crowd.select("key", *[F.col(f"b_{c}").alias(f"{end}_{c}") for c in _OWN], *[F.col(c).alias(f"{end}_{c}") for c in more])


def _matches(crowd: DataFrame) -> DataFrame:
    """Pairs of near corners (a_..., b_...) of two images: all of small buckets, and those with the
    first corner of large ones."""
    few = crowd.where(F.col("size") <= SMALL)
    small = _own(few, "a").join(_own(few, "b"), "key").where("a_row < b_row")
    star = crowd.where(F.col("size") > SMALL).where("a_row != b_row")
    return _near(small.drop("key").unionByName(star.drop("key", "size"))).select(_MATCH).dropDuplicates(["a_row", "a_corner", "b_row", "b_corner"])


def _across(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of near corners that share a bucket, of images of different classes."""
    known = crowd.join(roots.withColumnRenamed("node", "b_row"), "b_row", "left").withColumn("root", F.coalesce("root", "b_row"))
    known = stored(known.select("key", "size", *[f"b_{c}" for c in _OWN], "root"))
    several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("b_row", "root")).alias("first")).where("low != high")
    rest = stored(known.join(several.select("key", F.col("first.root").alias("first_root")), "key"))
    few, many = rest.where(F.col("size") <= SMALL), rest.where(F.col("size") > SMALL)
    # a pair counts in the first of its tables only
    table = F.array_position(F.zip_with("a_tables", "b_tables", lambda a, b: a == b), F.lit(True)) - 1
    small = _near(_own(few, "a", "root").join(_own(few, "b", "root"), "key").where("a_row < b_row and a_root != b_root")).where(F.col("key").bitwiseAND(F.lit(15)) == table)
    return small.select(_MATCH).unionByName(_across_blocks(many))


def _across_blocks(many: DataFrame) -> DataFrame:
    """``_across`` in large buckets; those outside the first corner's class meet all corners, in blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = many.withColumn("leading", F.col("root") == F.col("first_root")).withColumn("part", F.pmod(F.xxhash64("b_row", "b_corner"), blocks).cast("int"))
    asking = dealt.where("not leading").select("*", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(True).alias("asks"))
    asked = dealt.select("*", F.col("part").alias("j"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.lit(False).alias("asks"))
    rows = asking.unionByName(asked).select("key", "i", "j", "asks", "leading", "root", *[F.col(f"b_{c}").alias(c) for c in _OWN])
    schema = T.StructType([T.StructField(f"{x}_{c}", rows.schema[c].dataType) for x in "ab" for c in _OWN if c != "tables"])
    arrow = to_arrow_schema(schema)

    def run(block: pa.Table) -> pa.Table:
        asks, leading, root, row = (block[c].to_numpy() for c in ("asks", "leading", "root", "row"))
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        parts = block["tables"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        words = np.ascontiguousarray(parts).view(np.uint64)
        apart = np.zeros((len(mine), len(theirs)), np.uint8)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[mine, k][:, None] ^ words[theirs, k][None, :])
        i, j = np.nonzero((apart <= DISTANCE) & (root[mine][:, None] != root[theirs][None, :]))
        i, j = mine[i], theirs[j]
        # two that are outside the first class ask each other; a pair counts in the first of its tables
        once = (leading[j] | (row[i] < row[j])) & ((parts[i] == parts[j]).argmax(axis=1) == block["key"][0].as_py() % 16)
        i, j = i[once], j[once]
        low, high = np.where(row[i] < row[j], i, j), np.where(row[i] < row[j], j, i)
        return pa.table([block[name[2:]].take(pa.array(low if name[0] == "a" else high)) for name in arrow.names], schema=arrow)

    return rows.groupBy("key", "i", "j").applyInArrow(run, schema)


def _links(matches: DataFrame, inliers: int) -> DataFrame:
    """Pairs of images (a, b) of which enough corners agree on turn, size and shift."""
    turn = F.col("b_turn") - F.col("a_turn")
    grow = F.pow(F.lit(SCALES[0] / SCALES[1]), (F.col("b_scale") - F.col("a_scale")).cast("double"))
    # y grows downwards; a turn takes (y, x) to (y cos + x sin, x cos - y sin)
    moved = matches.withColumn("turn", F.pmod(turn.cast("double"), F.lit(2 * np.pi))).withColumn("grow", F.col("b_scale") - F.col("a_scale"))
    moved = moved.withColumn("dy", F.col("b_y") - grow * (F.col("a_y") * F.cos("turn") + F.col("a_x") * F.sin("turn"))).withColumn("dx", F.col("b_x") - grow * (F.col("a_x") * F.cos("turn") - F.col("a_y") * F.sin("turn")))
    # each vote goes to two overlapping cells an axis, so that no border parts those that agree
    votes = moved.withColumn("half", F.explode(F.sequence(F.lit(0), F.lit(7))))
    half = [F.shiftright("half", i).bitwiseAND(F.lit(1)) / 2 for i in range(3)]
    cell = [F.floor(F.col("dy") / 16 + half[0]), F.floor(F.col("dx") / 16 + half[1]), F.floor(F.pmod(F.col("turn") * 12 / (2 * np.pi) + half[2], F.lit(12.0)))]
    # corners of one place (on both scales) count once
    place = F.struct(F.round(F.col("a_y") / 2), F.round(F.col("a_x") / 2))
    agreed = votes.groupBy("a_row", "b_row", "half", "grow", *[c.alias(f"cell_{i}") for i, c in enumerate(cell)]).agg(F.size(F.collect_set(place)).alias("n"))
    return agreed.groupBy("a_row", "b_row").agg(F.max("n").alias("n")).where(F.col("n") >= inliers).select(F.col("a_row").alias("a"), F.col("b_row").alias("b"), "n")


def image_copies(media: DataFrame, *, id_col: str, media_col: str, inliers: int = INLIERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, class_id (the class's smallest id), class_size, and
    representative (true for one row of each class) of every row."""
    numbered = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]).withColumn("row", F.monotonically_increasing_id())
    # written once, so that row numbers hold and images aren't described again
    rows = stored(described(numbered, media_col="media"))
    crowd = _met(rows.select("row", F.inline("corners")))
    first = stored(_links(_matches(crowd), inliers))
    links = first.union(stored(_links(_across(crowd, components(first)), inliers)))
    classed = rows.drop("corners").join(components(links).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    classes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("one"))
    return met_evenly(classed, classes, "root").select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "class_id", "class_size", (F.col("row") == F.col("one.row")).alias("representative"))


def drawn(vectors: np.ndarray, side: int = 80) -> np.ndarray:
    """Images whose cosine coefficients of middle frequencies are given: by image, y and x."""
    n = int(np.sqrt(vectors.shape[1]))
    wave = np.cos(np.pi * (np.arange(side)[None, :] + 0.5) * (2 * np.arange(n)[:, None] + 5) / side)
    image = np.einsum("kij,iy,jx->kyx", vectors[:, : n * n].reshape(-1, n, n), wave, wave, optimize=True)
    return 127.5 + 110 * np.tanh(image / np.maximum(1e-9, image.std(axis=(1, 2), keepdims=True)))


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A copy of an image: cropped to three quarters, turned by quarters, brighter or darker, with
    less contrast."""
    rng = np.random.default_rng(seed)
    height, width = (s * 3 // 4 for s in image.shape)
    y, x = rng.integers(0, image.shape[0] - height + 1), rng.integers(0, image.shape[1] - width + 1)
    part = np.rot90(image[y : y + height, x : x + width], rng.integers(0, 4))
    return np.clip((part - 127.5) * rng.uniform(0.6, 0.9) + 127.5 + rng.uniform(-20, 20), 0, 255)


def drawn_media(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 20) -> DataFrame:
    """``id_col, edited, media``: the image drawn from each vector, and an edited copy of those
    whose id is divisible by ``copies``. A null vector has null media."""
    kind = vectors.schema[id_col].dataType
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, out = part["id"].to_pylist(), []
                for key, vector in zip(ids, part["vector"].to_pylist(), strict=True):
                    if not vector or None in vector:
                        out.append((key, False, None))
                        continue
                    image = drawn(np.array([vector], np.float64))[0]
                    out.append((key, False, encode_pgm(image)))
                    if key is not None and key % copies == 0:
                        out.append((key, True, encode_pgm(edited(image, key))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], names=["id", "edited", "media"])

    return own.mapInArrow(run, "id long, edited boolean, media binary").select(F.col("id").cast(kind).alias(id_col), "edited", "media")
