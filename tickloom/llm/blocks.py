"""Text columns of an Arrow batch as byte blocks: words, shingles and their hashes, without a Python loop per word.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased: digits, letters and every
character beyond ASCII. In UTF-8 all bytes of the latter are at least 0x80, so bytes are enough to split.
Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A value per byte, and the same with A-Z as a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
FOLDED_VALUES = BYTE_VALUES[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    up, down = _powers[0][:n], _powers[1][:n]
    if len(_powers[0]) > 8 * BLOCK_BYTES:  # made for one very long text; not kept
        _powers[:] = [_powers[0][: BLOCK_BYTES + 1].copy(), _powers[1][: BLOCK_BYTES + 1].copy()]
    return up, down


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and powers for `span_hashes`."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * down[:-1], out=sums[1:])
    return sums, up


def span_hashes(sums: np.ndarray, up: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[starts:ends]; equal spans have equal hashes wherever they lie."""
    return (sums[ends] - sums[starts]) * up[starts]


@dataclass
class Block:
    """Rows first to last of a batch; their text is data[offsets[i]:offsets[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_array(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_string())


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows of about `limit` bytes; a longer text is a block of its own, and whole."""
    texts = text_array(column)
    if not len(texts):
        return
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        begin, end = offsets[first], offsets[last]
        yield Block(first, last, data[begin:end], offsets[first : last + 1] - begin)
        first = last


@dataclass
class Words:
    """Words of a block in order; those of its i-th text are [bounds[i], bounds[i + 1])."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(block: Block) -> Words:
    starts, ends = runs(IS_WORD[block.data], block.offsets)
    sums, up = prefix_hashes(block.data, FOLDED_VALUES)
    return Words(mix(span_hashes(sums, up, starts, ends)), starts, ends, np.searchsorted(starts, block.offsets))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places near the end take what is left."""
    out = hashes.copy()
    for k in range(1, n):
        out *= _SHINGLE
        out[:-k or None] += mix(hashes[k:] + np.uint64(k)) if k < len(hashes) else np.uint64(0)
    return mix(out)


@dataclass
class Shingles:
    """Hashes of each text's shingles, text after text."""

    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingles(found: Words, size: int = 5) -> Shingles:
    """`size` words each; all words of a text with fewer are one shingle; a text without words has none."""
    counts = found.counts
    grams = gram_hashes(found.hashes, size)
    places = np.arange(len(grams)) - np.repeat(found.bounds[:-1], counts)
    fits = places <= np.repeat(counts, counts) - size
    for text in np.flatnonzero((counts > 0) & (counts < size)):
        first, n = found.bounds[text], counts[text]
        fits[first] = True
        grams[first] = gram_hashes(found.hashes[first : first + n], int(n))[0] ^ _ODD
    kept = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    return Shingles(grams[fits], np.concatenate([[0], np.cumsum(kept)]))


def hashed_cells(found: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of a multiset: the j-th copy of a shingle in a text is a cell of its own, sorted by text and shingle."""
    text = np.repeat(np.arange(len(found.counts)), found.counts)
    order = np.lexsort((found.hashes, text))
    text, hashes = text[order], found.hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(hashes))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    return text, mix(hashes + copy.astype(np.uint64) * _SHINGLE)
