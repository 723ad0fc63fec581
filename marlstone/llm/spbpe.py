"""Byte-level BPE by sentencepiece, whose model is written directly from the ranks.

No training takes place: the model file is put together piece by piece. Byte b of a token is
character U+0100 + b of its piece, so every byte string is a string without white space; a
piece's score is its negative rank, so that sentencepiece merges the pair of the lowest rank
first, leftmost among equals, as byte-level BPE does. Normalisation is the identity. Pre-tokens
(matches of a regex) are encoded one by one, distinct ones once while they are cached. Decoding
is the inverse mapping of the pieces to bytes.

Defined results: null is the empty text, which has no ids; ids that are not ranks can't be
decoded and raise an error; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import CachedEncoder, map_texts

_FIRST = 0x100
_MAPPED = {b: chr(_FIRST + b) for b in range(256)}
NORMAL, UNKNOWN, UNUSED = 1, 2, 5


def mapped(token: bytes) -> str:
    """The piece of a token: a character for each byte."""
    return token.decode("latin-1").translate(_MAPPED)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - _FIRST for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary: piece number = rank, then the unknown piece.

    All 256 single bytes must have ranks. Ranks that no token has become unused pieces.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each single byte needs a rank")
    tokens = {rank: token for token, rank in ranks.items()}
    if len(tokens) < len(ranks):
        raise ValueError("two tokens share a rank")
    size = max(tokens) + 1

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    out = [piece(mapped(tokens[r]), -float(r), NORMAL) if r in tokens else piece(f"<unused{r}>", 0.0, UNUSED) for r in range(size)]
    out.append(piece("<unk>", 0.0, UNKNOWN))
    # trainer: BPE (3 = 2), size of the vocabulary (4), numbers of the unknown, first, last and padding piece (40 to 43)
    trainer = _number(3, 2) + _number(4, size + 1) + _number(40, size) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    # normaliser: identity, and neither a space in front, nor fewer spaces, nor other characters for them (3 to 5)
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _bytes(2, trainer) + _bytes(3, normalizer)


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> tuple[CachedEncoder, list[bytes]]:
    ranks = read_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
    pieces = [unmapped(p) if (p := model.id_to_piece(i))[0] != "<" else b"" for i in range(model.get_piece_size() - 1)]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode([mapped(w.encode("utf-8", "surrogatepass")) for w in words], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    return CachedEncoder(regex.compile(pattern).findall, encode), pieces


def _decoded(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_texts(docs: DataFrame, path: str, pattern: str, *, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the ids of every text as little-endian unsigned 32-bit integers.

    decode: also gives ``decoded``, the bytes that the ids stand for, as ``decode_ids`` does, but
    in the same worker, which needs half the memory of two in a row.
    """
    fields = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decode]

    def run(texts: list) -> dict:
        encoder, pieces = _codec(path, pattern)
        ids = encoder([t or "" for t in texts])
        return {"ids": ids} | ({"decoded": [_decoded(x, pieces) for x in ids]} if decode else {})

    return map_texts(docs, run, fields, id_col=id_col, text_col=text_col)


def decode_ids(coded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, decoded``: the bytes that the ids stand for, beside the ids."""

    def run(values: list) -> dict:
        pieces = _codec(path, pattern)[1]
        return {"decoded": [_decoded(v or b"", pieces) for v in values]}

    return map_texts(coded, run, [T.StructField("decoded", T.BinaryType())], id_col=id_col, text_col=ids_col, keep=(ids_col,))
