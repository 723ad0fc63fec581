"""The tokenizers library's ids of texts, each distinct piece encoded once while it is cached.

Texts are cut where the library's own pre-tokens certainly end, so that its ids of the pieces, one
after another, are those of the text. Bytes have classes: letters (ASCII and Latin-1), digits,
other printable ASCII, space, other ASCII white space; the apostrophe, control characters and
all else have none. Cuts are in front of each run of white space, between different classes of
characters other than white space, and behind a run that is one character other than the space.
Beside a character without a class there is no cut but before white space.

Tokenizers that drop white space (``bare``), whose pattern also takes digits one by one and which
lower-case, get pieces without it, each digit for itself, with A-Z in lower case unless the next
character is beyond Latin-1 (normal forms may join them).

The pieces that are kept are one Arrow array, in which Arrow finds a batch's distinct pieces.

A piece that is a single pre-token goes to the library's model with many others in a string, without
pre-tokenizer and normaliser; where each ends is told by its tokens' lengths. All others go to the
library as they are. Texts with white space beyond ASCII go there whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once: more than elsewhere, as each distinct piece is looked up once.
TOKEN_CHUNK = 10 << 20

#: White space as the tokenizers see it (the Unicode property) beyond ASCII.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NONE, _LETTER, _DIGIT, _OTHER, _SPACE, _WHITE = range(6)
#: Lead byte of U+00C0 to U+00FF, which are letters but for these two (their second bytes).
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)
#: Second byte of the first of them that is in lower case.
_LOWER = 0x9F
#: Pieces of a string that goes to the model.
_JOINED = 100


def _classes() -> np.ndarray:
    out = np.full(256, _NONE, np.uint8)
    for low, high, kind in ((33, 126, _OTHER), (65, 90, _LETTER), (97, 122, _LETTER), (48, 57, _DIGIT), (9, 13, _WHITE), (32, 32, _SPACE), (39, 39, _NONE)):
        out[low : high + 1] = kind
    return out


def _cuts(bare: bool) -> np.ndarray:
    """Whether a piece begins at the second of two classes, by 8 * first + second."""
    out = np.zeros((8, 8), bool)
    for a in range(6):
        out[a, [_SPACE, _WHITE]] = a < _SPACE
        out[a, [_LETTER, _DIGIT, _OTHER]] = _NONE < a < _SPACE
        out[a, a] = bare and a == _DIGIT
        if bare and a >= _SPACE:
            out[a] = True
    return out.ravel()


def byte_characters() -> str:
    """The characters by which byte-level vocabularies name the bytes 0 to 255: printable ones
    themselves, all others from U+0100 on in their order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


_CLASS = _classes()


def _kinds(flat: np.ndarray) -> np.ndarray:
    """The class of each byte of whole characters."""
    kind = _CLASS[flat]
    latin = np.flatnonzero(flat[:-1] == _LATIN)
    latin = latin[~np.isin(flat[latin + 1], _SIGNS)]
    kind[latin] = kind[latin + 1] = _LETTER
    return kind


def _parts(pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces, one after another, and their offsets."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    return np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class LibraryEncoder:
    """Ids of texts. Where there are more than ``most`` entries, those stay that more than one batch
    has met. Pieces of more than ``longest`` bytes are not kept."""

    def __init__(self, path: str, bare: bool, *, most: int = 700_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.bare, self.most, self.longest = Tokenizer.from_file(path), bare, most, longest
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.whole.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>") if bare else token)
        self.characters = np.frombuffer(byte_characters().encode("utf-16-le"), "<u2")
        self.cuts = _cuts(bare)
        self._empty()

    def _empty(self) -> None:
        # pieces that are kept, and where each of them stands among the entries
        self.known, self.slots = pa.array([], pa.binary()), np.zeros(0, np.int64)
        self.ends, self.again, self.held = np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, self.dtype)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and the number of each text's ids."""
        wide = [i for i, t in enumerate(texts) if not t.isascii() and _WIDE_SPACE.search(t)]
        if not wide:
            return self._by_pieces(texts)
        chosen = set(wide)
        plain = [i for i in range(len(texts)) if i not in chosen]
        out: list = [None] * len(texts)
        for numbers, (ids, sizes) in ((plain, self._by_pieces([texts[i] for i in plain])), (wide, self._library([texts[i] for i in wide]))):
            for i, own in zip(numbers, np.split(ids, np.cumsum(sizes)[:-1]), strict=True) if numbers else ():
                out[i] = own
        return np.concatenate([np.zeros(0, self.dtype), *out]), np.array([len(x) for x in out], np.int64)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' bytes, their offsets, and the number of pieces up to each text's end."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        flat = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes)
        kind = _kinds(flat)
        starts = np.zeros(len(flat), bool)
        starts[1:] = self.cuts[(kind[:-1] << 3) | kind[1:]]
        starts[(ends - sizes)[sizes > 0]] = True
        if self.bare:
            following = np.append(flat[1:], np.uint8(0))
            upper = (flat >= 65) & (flat <= 90) & ((following < 128) | (following == _LATIN))
            flat = flat + (upper.view(np.uint8) << 5)
            kept = kind < _SPACE
            before = np.concatenate([[0], np.cumsum(kept)])
            flat, starts, ends = flat[kept], starts[kept], before[ends]
        else:
            # behind one character that is white space, but not the space
            after = np.flatnonzero((kind[1:-1] == _WHITE) & (kind[:-2] < _SPACE) & (kind[2:] < _SPACE)) + 2
            starts[after] = True
        begin = np.flatnonzero(starts)
        return flat, np.append(begin, len(flat)).astype(np.int32), np.searchsorted(begin, ends)

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets, until = self._pieces(texts)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        slot = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        first, sizes = self.ends[slot], (self.ends[1:] - self.ends[:-1])[slot]
        ends = np.cumsum(sizes)
        place = np.repeat(first - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.held[place], np.diff(np.concatenate([[0], ends])[until], prepend=0)

    def _slots(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Where each of some distinct pieces stands among the entries."""
        if len(self.again) > self.most:
            self._shrink()
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy()
        old = at >= 0
        slot = np.zeros(len(pieces), np.int64)
        slot[old] = self.slots[at[old]]
        self.again[slot[old]] = True
        new = np.flatnonzero(~old)
        if len(new):
            fresh = pieces.take(pa.array(new))
            ids, sizes = self._encode(fresh)
            first = len(self.again)
            slot[new] = np.arange(first, first + len(new))
            kept = np.diff(_parts(fresh)[1]) <= self.longest
            self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(kept))])
            self.slots = np.concatenate([self.slots, first + np.flatnonzero(kept)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.held = np.concatenate([self.held, ids.astype(self.dtype)])
        return slot

    def _shrink(self) -> None:
        kept = self.again[self.slots]
        known, old, ends, held = self.known.filter(pa.array(kept)), self.slots[kept], self.ends, self.held
        self._empty()
        if len(old) and len(old) < self.most // 2:
            sizes = ends[old + 1] - ends[old]
            self.known, self.slots = known, np.arange(len(old))
            self.ends = np.concatenate([[0], np.cumsum(sizes)])
            self.again = np.zeros(len(old), bool)
            self.held = held[np.repeat(ends[old] - self.ends[:-1], sizes) + np.arange(self.ends[-1])]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def _one(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pieces are one pre-token for certain: after a space, if any, characters of one class."""
        kind = _kinds(flat)
        if self.bare:  # not yet in lower case
            kind[(flat >= 65) & (flat <= 90)] = _NONE
            upper = np.flatnonzero((flat[:-1] == _LATIN) & (flat[1:] < _LOWER))
            kind[upper] = kind[upper + 1] = _NONE
        begin, last = offsets[:-1], offsets[1:] - 1
        if not self.bare:
            begin = np.minimum(begin + (kind[begin] == _SPACE), last)
        changes = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        first = kind[begin]
        one = (changes[begin] == changes[last]) & (first > _NONE) & (first < _SPACE)
        return one & ((first != _DIGIT) | (begin == last)) if self.bare else one

    def _encode(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces, and their numbers."""
        one = self._one(*_parts(pieces))
        singles = pieces if one.all() else pieces.filter(pa.array(one))
        found = self._single(*_parts(singles)) if len(singles) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if len(singles) == len(pieces):
            return found
        rest = self._library([p.decode("utf-8", "surrogatepass") for p in pieces.filter(pa.array(~one)).to_pylist()])
        # all ids of the singles, then those of the others; taken in the pieces' order
        sizes, first = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[one], sizes[~one] = found[1], rest[1]
        first[one], first[~one] = np.cumsum(found[1]) - found[1], len(found[0]) + np.cumsum(rest[1]) - rest[1]
        ends = np.cumsum(sizes)
        return np.concatenate([found[0], rest[0]])[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def _single(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_encode`` of pieces that are one pre-token each."""
        n, lengths = len(offsets) - 1, np.diff(offsets)
        joined = np.full(len(flat) + n, ord(" "), "<u2")  # behind each piece, as no character of a byte is the space
        joined[np.arange(len(flat)) + np.repeat(np.arange(n), lengths)] = self.characters[flat]
        cuts = [*(offsets[:-1:_JOINED] + np.arange(0, n, _JOINED)).tolist(), len(joined)]
        strings = [joined[a : b - 1].tobytes().decode("utf-16-le") for a, b in pairwise(cuts)]
        found = [x.ids for x in self.single.encode_batch_fast(strings, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        covered = np.cumsum(self.bytes_of[ids])
        wanted = offsets[1:]
        ends = np.searchsorted(covered, wanted) + 1
        if not len(ids) or ends[-1] != len(ids) or (covered[ends - 1] != wanted).any():
            raise ValueError("the vocabulary's tokens don't tell where a piece ends")
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=4)
def library_encoder(path: str, bare: bool = False, most: int = 700_000) -> LibraryEncoder:
    return LibraryEncoder(path, bare, most=most)


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text's, and the numbers with it."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
