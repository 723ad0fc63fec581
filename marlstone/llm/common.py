"""What several operators of this subpackage share: batches of texts, and cached encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of an operator's function gets, unless one row holds more.
CHUNK = 2 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which ``column`` holds about ``most`` bytes, and a row at least."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), dtype=float)))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0.0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def map_texts(df: DataFrame, function: Callable[[list], dict], fields: list[T.StructField], *, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, and the columns that ``function`` makes of a list of texts.

    The function gets a few megabytes of whole texts at a time (null ones as None) and returns
    a list or Arrow array for each of ``fields``. Only the named columns are read.
    """
    # the text itself is handed over once, also where it is kept
    sources = ["_text" if c == text_col else f"_keep_{i}" for i, c in enumerate(keep)]
    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, sources, strict=True) if n != "_text"])
    kept = [T.StructField("_id", own.schema["_id"].dataType)] + [T.StructField(f"_keep_{i}", own.schema[n].dataType) for i, n in enumerate(sources)]
    made = [T.StructField(f"_made_{i}", f.dataType) for i, f in enumerate(fields)]
    schema = T.StructType(kept + made)
    arrow, names = to_arrow_schema(schema), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            out = function(part["_text"].to_pylist())
            columns = [part[n] for n in ("_id", *sources)]
            for name, field in zip(names, list(arrow)[len(kept) :], strict=True):
                column = out[name]
                columns.append(column if isinstance(column, pa.Array) and column.type == field.type else pa.array(column, type=field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = own.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_made_{i}").alias(n) for i, n in enumerate(names)])


class CachedEncoder:
    """Encodes texts piece by piece, each distinct piece once while it is cached.

    split: a text's pieces, each of which is encoded for itself. encode: of a list of pieces all
    ids one after another, and the number of ids of each. Where there are more than ``most``
    entries, those stay that more than one call has met. Pieces longer than ``longest`` are not
    kept. ids are little-endian unsigned integers of ``dtype``.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], *, dtype: str = "<u4", most: int = 400_000, longest: int = 64):
        self.split, self.encode, self.dtype, self.most, self.longest = split, encode, np.dtype(dtype), most, longest
        self.cache: dict[str, bytes] = {}
        self.again: set[str] = set()

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        cache = self.cache
        if len(cache) > self.most:
            kept = self.again if len(self.again) < self.most // 2 else ()
            cache = self.cache = {piece: cache[piece] for piece in kept}
            self.again = set()
        wanted = set().union(*cut)
        new = wanted.difference(cache)
        self.again.update(wanted.difference(new))
        extra = []
        if new:
            pieces = list(new)
            ids, sizes = self.encode(pieces)
            flat = ids.astype(self.dtype).tobytes()
            ends = (np.cumsum(sizes) * self.dtype.itemsize).tolist()
            at = 0
            for piece, end in zip(pieces, ends, strict=True):
                cache[piece] = flat[at:end]
                at = end
                if len(piece) > self.longest:
                    extra.append(piece)
        get = cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for piece in extra:
            del cache[piece]
        self.again.difference_update(extra)
        return out
