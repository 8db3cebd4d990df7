"""Remove every byte of a text that lies in a string of 50 bytes which an earlier document holds too.

How the work is spread: a string's *anchor* is the 20 bytes in it with the least hash. It depends on the string
alone, so equal strings have equal anchors at equal places. Neighbouring strings share anchors; a *stretch* is
the text under the strings of one anchor, 50 to 80 bytes. Strings can only be equal if their stretches' anchors
are, so stretches are dealt out by anchor, and a task sorts the suffixes that begin in its stretches.

1. Texts are cut into shards of about 8 MB, stored compressed in the shared folder.
2. Each shard sends its distinct anchors, six bytes each, to buckets; a bucket answers with a flag per anchor:
   whether another document has it.
3. Each shard sends its distinct stretches under such anchors, with the smallest id that holds them in the
   shard. A bucket sorts their suffixes and answers with the smallest id for each string, where it is
   smaller than the one sent.
4. Each shard marks the strings whose smallest id is below the document's own.

An anchor or stretch that a third of all documents share is sent once per shard, whatever the documents'
number. If many shards share an anchor, or many stretches, its strings are dealt out singly by their own hash.

A shard's packs for all buckets are rows of one Arrow batch, and a bucket's packs are read from its buffers, so
that a pack, of which there are as many as shards times buckets, costs little beyond its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import BYTE_VALUES, blocks, mix, prefix_hashes, runs
from tickloom.llm.frames import partitions, quoted, stored

LENGTH = 50
ANCHOR = 20
SHARD_BYTES = 8 << 20
PIECE = 1 << 16
HOT_SHARDS = 4096
HOT_STRETCHES = 1 << 18
MOST_SPREAD = 1024
NO_ID = np.iinfo(np.int64).max

#: Stretches whose suffixes are sorted, or whose strings are marked, at once; whole anchors are not cut.
_AT_ONCE = 1 << 17
#: The numbers of stretches of a shard under one anchor are sent rounded down to one of these.
_COUNTS = 32 * (2 ** (np.arange(128) / 8) - 1)

_PLACE = np.uint64((1 << 24) - 1)
_KEY = np.uint64((1 << 48) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
#: The first k bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(data).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the number of each value among them, and the first place of each."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(ranked), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return ranked[heads], number, np.minimum.reduceat(order, heads)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as the i-th binary; bounds count bytes and begin with 0."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries without nulls, one after the other, and the size of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


# ---------------------------------------------------------------- suffix sorting


class HashedText:
    """Bytes that are hashed and compared in words of eight; up to `margin` bytes around them read as zero."""

    def __init__(self, data: np.ndarray, margin: int = 8) -> None:
        self.margin = margin + 8
        held = np.zeros(len(data) + 2 * self.margin, dtype=np.uint8)
        held[self.margin : self.margin + len(data)] = data
        self.data = held[self.margin : self.margin + len(data)]
        self._words = np.ndarray((len(held) - 7,), dtype="<u8", buffer=held, strides=(1,))

    def words(self, starts: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on; the first is the lowest."""
        return self._words[starts + self.margin].astype(np.uint64, copy=False)

    def first_bytes(self, starts: np.ndarray, lengths: np.ndarray | int) -> Iterator[np.ndarray]:
        """The first `lengths` bytes from each place on, word by word; bytes behind them are zero."""
        least, most = (int(f(lengths)) for f in (np.min, np.max))
        for k in range(0, most, 8):
            word = self.words(starts + k)
            yield word if k + 8 <= least else word & _FIRST[np.clip(np.asarray(lengths) - k, 0, 8)]

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64) + np.asarray(lengths).astype(np.uint64)
        if len(starts):
            for word in self.first_bytes(starts, lengths):
                out ^= word
                out *= _ODD
                out ^= out >> _HALF
        return mix(out)

    def differ(self, one: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), dtype=bool)
        if len(one):
            for a, b in zip(self.first_bytes(one, lengths), self.first_bytes(two, lengths)):
                out |= a != b
        return out

    def ahead(self, one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at `one` and `two`, at most `limit`."""
        return self._common(one, two, limit, 1)

    def behind(self, one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
        """Number of common bytes that end in front of `one` and `two`, at most `limit`."""
        return self._common(one, two, limit, -1)

    def _common(self, one: np.ndarray, two: np.ndarray, limit: int, way: int) -> np.ndarray:
        out = np.zeros(len(one), dtype=np.int64)
        open_ = np.arange(len(one))
        for k in range(0, limit, 8):
            at = k if way > 0 else -k - 8
            word = self.words(one[open_] + at) ^ self.words(two[open_] + at)
            if way < 0:
                word = word.byteswap()
            # Bytes up to the first one that differs.
            equal = sum((word & x == 0).astype(np.int64) for x in _FIRST[1:])
            out[open_] += equal
            open_ = open_[equal == 8]
            if not len(open_):
                break
        return np.minimum(out, limit)


def suffix_order(text: HashedText, starts: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """The order that sorts the suffixes at `starts` by their first `limit` bytes within each group.

    `groups` is ascending. Word after word, those that share all bytes so far are sorted by the next eight;
    a suffix that shares them with no other has its place. Stable.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    new = np.r_[True, groups[1:] != groups[:-1]]
    open_ = np.arange(n)
    for k in range(0, limit, 8):
        # Places in runs of two or more.
        open_ = open_[~(new[open_] & np.r_[new, True][open_ + 1])]
        if not len(open_):
            break
        run = np.cumsum(new[open_])
        word = text.words(starts[order[open_]] + k)
        if k + 8 > limit:
            word &= _FIRST[limit - k]
        word = word.byteswap()
        by = np.lexsort((word, run))
        order[open_] = order[open_][by]
        word = word[by]
        new[open_[1:]] |= word[1:] != word[:-1]
    return order


def least_of_equals(
    text: HashedText,
    first: np.ndarray,
    strings: np.ndarray,
    place: np.ndarray,
    ids: np.ndarray,
    length: int,
) -> np.ndarray:
    """For each string of each stretch the smallest id among the stretches that hold it.

    The suffixes that begin at the stretches' anchors are sorted. In front of a sorted suffix goes one byte after
    the other: sorting by that byte alone sorts the longer suffixes, as the order of the rest is kept. Behind each
    byte the neighbours are compared. The bytes that two of them share on both sides of their anchors are
    counted once, however many of their strings meet.
    """
    bounds = np.cumsum(strings) - strings
    out = np.repeat(ids, strings)
    anchor = min(ANCHOR, length)
    anchors = first + place
    by_anchor = text.hashes(anchors, anchor)
    order = np.argsort(by_anchor)
    new = np.r_[True, by_anchor[order[1:]] != by_anchor[order[:-1]], True]
    # Nothing can be equal under the anchor of one stretch.
    order = order[~(new[1:] & new[:-1])]
    heads = np.flatnonzero(np.r_[True, by_anchor[order[1:]] != by_anchor[order[:-1]]]) if len(order) else order
    cuts = heads[np.r_[True, np.diff(heads // _AT_ONCE) > 0]] if len(heads) else heads
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        part = np.sort(order[a:b])
        _least_of_part(text, anchors[part], strings[part], place[part], ids[part], bounds[part], length, out)
    return out


def _least_of_part(
    text: HashedText,
    anchors: np.ndarray,
    strings: np.ndarray,
    place: np.ndarray,
    ids: np.ndarray,
    bounds: np.ndarray,
    length: int,
    out: np.ndarray,
) -> None:
    lowest = place - strings + 1
    most = int(place.max())
    who = suffix_order(text, anchors, np.zeros(len(anchors), dtype=np.int64), length)
    partner = np.full(len(anchors), -1)
    ahead, behind = np.zeros((2, len(anchors)), dtype=np.int64)
    for spot in range(most + 1):  # bytes in front of the anchor
        if spot:
            who = who[place[who] >= spot]
            who = who[np.argsort(text.data[anchors[who] - spot], kind="stable")]
        mine = who[lowest[who] <= spot]
        one, two = mine[:-1], mine[1:]
        changed = np.flatnonzero(partner[two] != one)
        a, b = one[changed], two[changed]
        partner[b] = a
        ahead[b] = text.ahead(anchors[a], anchors[b], length)
        behind[b] = text.behind(anchors[a], anchors[b], most)
        same = (behind[two] >= spot) & (ahead[two] >= length - spot)
        if same.any():
            of_run = np.r_[same, False] | np.r_[False, same]
            of = mine[of_run]
            heads = np.flatnonzero(~np.r_[False, same][of_run])
            least = np.minimum.reduceat(ids[of], heads)
            out[bounds[of] + place[of] - spot] = np.repeat(least, np.diff(np.r_[heads, len(of)]))


# ---------------------------------------------------------------- anchors and stretches


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def string_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether a string of `length` bytes begins at each place, within one text."""
    out = np.ones(offsets[-1], dtype=bool)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    for k in range(1, length):
        out[np.maximum(offsets[1:][full] - k, offsets[:-1][full])] = False
    return out


def distinct(text: HashedText, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its kind for each stretch, and the first stretch of each kind; kinds differ in bytes."""
    _, kind, kinds = numbered(text.hashes(first, lengths))
    head = kinds[kind]
    copies = np.flatnonzero(head != np.arange(len(kind)))
    head = head[copies]
    differ = lengths[copies] != lengths[head]
    differ |= text.differ(first[copies], first[head], lengths[copies])
    alone = copies[differ]
    if len(alone):  # two contents with one hash: the others get a kind each
        kind[alone] = len(kinds) + np.arange(len(alone))
        kinds = np.concatenate([kinds, alone])
    return kind, kinds


class Stretches:
    """All stretches of a shard: first string, number of strings, anchor's place under the first, anchor's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.data, self.offsets, self.length = data, offsets, length
        anchor = min(ANCHOR, length)
        found: list[tuple[np.ndarray, ...]] = []
        strings = len(data) - length + 1
        begins = string_starts(offsets, length)
        for begin in range(0, max(strings, 0), PIECE):
            count = min(PIECE, strings - begin)
            piece = data[begin : begin + count + length - 1]
            sums, up = prefix_hashes(piece)
            hashes = mix((sums[anchor:] - sums[:-anchor]) * up[: len(piece) - anchor + 1])
            # The leftmost of equal hashes: its place is in the low bits.
            least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1)
            inside = begins[begin : begin + count]
            change = least[1:] != least[:-1]
            new, last = inside.copy(), inside.copy()
            new[1:] &= change | ~inside[:-1]
            last[:-1] &= change | ~inside[1:]
            first = np.flatnonzero(new)
            spot = (least[first] & _PLACE).astype(np.int64)
            found.append((begin + first, np.flatnonzero(last) - first + 1, spot - first, hashes[spot]))
        empty = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
        self.first, self.strings, self.place, self.hash = (
            (np.concatenate(x) for x in zip(*found)) if found else empty
        )
        self.text = np.searchsorted(offsets, self.first, side="right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return distinct(HashedText(self.data, self.length), self.first, self.strings + self.length - 1)


class Shard:
    def __init__(self, ids: bytes, sizes: bytes, body: bytes, length: int) -> None:
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))])
        self.data = unsqueeze(body, np.uint8)
        self.stretches = Stretches(self.data, self.offsets, length)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order of (bucket, key), the bucket of each, and the anchor of each stretch."""
        keys, of, _ = numbered(self.stretches.hash & _KEY)
        return keys, bucket_of(keys, buckets), of

    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kind of each stretch, the first stretch of each kind, and the smallest id that has the kind."""
        kind, kinds = self.stretches.distinct()
        least = np.full(len(kinds), NO_ID, dtype=np.int64)
        np.minimum.at(least, kind, self.ids[self.stretches.text])
        return kind, kinds, least


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of 48 bits in order have buckets in order."""
    return (((keys >> np.uint64(16)) * np.uint64(buckets)) >> _HALF).astype(np.int64)


def six_bytes(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def from_six_bytes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


# ---------------------------------------------------------------- the four steps

_SHARDS = "shard long, ids binary, sizes binary, body binary"


def _cut(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, sizes and bytes of the next shard
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1), max(shard_bytes // 8, 1)):
            if held and sum(len(x[2]) for x in held) + len(block.data) > shard_bytes:
                yield _shard_row(number, held)
                number, held = number + 1, []
            part = ids[block.first : block.last], np.diff(block.offsets), block.data
            held.append(tuple(x.astype(kind) for x, kind in zip(part, (np.int64, np.int64, np.uint8))))
    if held:
        yield _shard_row(number, held)


def _shard_row(number: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, sizes, data = (np.concatenate(x) for x in zip(*held))
    values = ids.tobytes(), sizes.tobytes(), squeeze(data)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in values)],
        ["shard", "ids", "sizes", "body"],
    )


def _shards(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Shard, pa.StructArray | None]]:
    """Each row's shard and its answers from the buckets."""
    for i in range(batch.num_rows):
        answers = batch.column(4)[i].values if batch.num_columns > 4 else None
        yield (
            batch.column(0)[i].as_py(),
            Shard(*(batch.column(k)[i].as_py() for k in (1, 2, 3)), length),
            answers,
        )


_ANCHORS = "bucket int, shard long, keys binary, held binary"


def _send_anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of anchors, with a byte for each: whether texts of the shard share it, and above that its count's place."""
    for batch in batches:
        for number, shard, _ in _shards(batch, length):
            keys, bucket, of = shard.anchors(buckets)
            if not len(keys):
                continue
            low = np.full(len(keys), len(shard.ids), dtype=np.int64)
            high = np.full(len(keys), -1, dtype=np.int64)
            np.minimum.at(low, of, shard.stretches.text)
            np.maximum.at(high, of, shard.stretches.text)
            counts = np.searchsorted(_COUNTS, np.bincount(of, minlength=len(keys)), side="right") - 1
            held = ((low != high) + 2 * counts).astype(np.uint8)
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            bounds = np.r_[heads, len(keys)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[heads].astype(np.int32)),
                    pa.array(np.full(len(heads), number), pa.int64()),
                    binaries(six_bytes(keys), bounds * 6),
                    binaries(held, bounds),
                ],
                ["bucket", "shard", "keys", "held"],
            )


_MARKS = "shard long, bucket int, flags binary"


def _answer_anchors(packs: pa.Table, hot_shards: int, hot_stretches: int) -> pa.Table:
    """A byte for each anchor sent: 0 if one document has it, 1 if more have, 2 if many shards or stretches have."""
    keys, sizes = buffers(packs["keys"])
    held, _ = buffers(packs["held"])
    _, of, _ = numbered(from_six_bytes(keys))
    count = np.bincount(of)
    stretches = np.bincount(of, weights=_COUNTS[held >> 1])
    shared = (count > 1) | (np.bincount(of, weights=held & 1) > 0)
    hot = (count > hot_shards) | (stretches > hot_stretches)
    flags = np.where(shared, 1 + hot, 0).astype(np.uint8)[of]
    bounds = np.concatenate([[0], np.cumsum(sizes // 6)])
    rows = np.flatnonzero(np.logical_or.reduceat(flags > 0, bounds[:-1]))
    take = packs.select(["shard", "bucket"]).take(pa.array(rows, pa.int64()))
    kept = np.concatenate([flags[bounds[i] : bounds[i + 1]] for i in rows]) if len(rows) else flags[:0]
    return pa.table(
        {
            "shard": take["shard"],
            "bucket": take["bucket"],
            "flags": binaries(kept, np.concatenate([[0], np.cumsum(sizes[rows] // 6)])),
        }
    )


_STRETCHES = "bucket int, shard long, n int, pack binary"


def _send_stretches(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, shard, marks in _shards(batch, length):
            if marks is not None and len(marks):
                yield from _stretches_of(number, shard, marks, length, buckets)


def _planes(x: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones, and so on: smaller when compressed."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _stretches_of(
    number: int, shard: Shard, marks: pa.StructArray, length: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """Packs of stretches: first string, number of strings, anchor's place, smallest id, and the bytes."""
    keys, bucket, of = shard.anchors(buckets)
    flags = np.zeros(len(keys), dtype=np.uint8)
    given, sizes = buffers(marks.field("flags"))
    begins = np.searchsorted(bucket, marks.field("bucket").to_numpy(zero_copy_only=False))
    flags[np.repeat(begins, sizes) + steps(sizes)] = given
    all_ = shard.stretches
    _, kinds, least = shard.kinds()
    chosen = np.flatnonzero(flags[of[kinds]])
    sent, least = kinds[chosen], least[chosen]
    first, strings, place = all_.first[sent], all_.strings[sent], all_.place[sent]
    goes = bucket[of[sent]]
    single = np.flatnonzero(flags[of[sent]] == 2)
    if len(single):  # string by string, each to the bucket of its own hash
        times = strings[single]
        step = steps(times)
        at = np.repeat(first[single], times) + step
        one = string_hashes(shard.data, at, length)
        rest = np.setdiff1d(np.arange(len(sent)), single)
        first = np.concatenate([first[rest], at])
        place = np.concatenate([place[rest], np.repeat(place[single], times) - step])
        least = np.concatenate([least[rest], np.repeat(least[single], times)])
        strings = np.concatenate([strings[rest], np.ones(len(at), dtype=np.int64)])
        goes = np.concatenate([goes[rest], bucket_of(one & _KEY, buckets)])
    if not len(goes):
        return
    order = np.lexsort((first, goes))
    first, strings, place, least, goes = first[order], strings[order], place[order], least[order], goes[order]
    heads = np.flatnonzero(np.r_[True, goes[1:] != goes[:-1]])
    packs, press = [], zstandard.ZstdCompressor(level=3)
    for a, b in zip(heads, np.r_[heads[1:], len(goes)]):
        lengths = strings[a:b] + length - 1
        parts = (
            _planes(first[a:b].astype(np.uint32)),
            strings[a:b].astype(np.uint8).tobytes(),
            place[a:b].astype(np.uint8).tobytes(),
            _planes(least[a:b]),
            shard.data[np.repeat(first[a:b], lengths) + steps(lengths)].tobytes(),
        )
        packs.append(press.compress(b"".join(parts)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(goes[heads].astype(np.int32)),
            pa.array(np.full(len(heads), number), pa.int64()),
            pa.array(np.diff(np.r_[heads, len(goes)]).astype(np.int32)),
            pa.array(packs, pa.binary()),
        ],
        ["bucket", "shard", "n", "pack"],
    )


def string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        out = mix(out ^ BYTE_VALUES[data[at + k]])
    return out


_LEAST = "shard long, n int, pack binary"


def _answer_stretches(packs: pa.Table, length: int) -> pa.Table:
    """Packs of stretches for which some string has a smaller id than the one sent: the smallest id for each string."""
    counts = packs["n"].to_numpy().astype(np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for n, pack in zip(counts, packs["pack"]):
        raw = unsqueeze(pack.as_py(), np.uint8)
        cuts = np.cumsum([4 * n, n, n, 8 * n])
        for part, x in zip(parts, np.split(raw, cuts)):
            part.append(x)
    at = [_from_planes(x, np.uint32) for x in parts[0]]
    strings, place = (np.concatenate(parts[k]).astype(np.int64) for k in (1, 2))
    ids = np.concatenate([_from_planes(x, np.int64) for x in parts[3]])
    text = HashedText(np.concatenate(parts[4]), length)
    del parts
    lengths = strings + length - 1
    first = np.cumsum(lengths) - lengths
    # Equal stretches become one before their suffixes are sorted.
    kind, kinds = distinct(text, first, lengths)
    least = np.full(len(kinds), NO_ID, dtype=np.int64)
    np.minimum.at(least, kind, ids)
    found = least_of_equals(text, first[kinds], strings[kinds], place[kinds], least, length)
    kind_at = np.cumsum(strings[kinds]) - strings[kinds]
    smaller = np.minimum.reduceat(found, kind_at)[kind] < ids
    bounds = np.concatenate([[0], np.cumsum(counts)])
    rows, sizes, out, press = [], [], [], zstandard.ZstdCompressor(level=3)
    for i in np.flatnonzero(np.logical_or.reduceat(smaller, bounds[:-1])):
        of = np.flatnonzero(smaller[bounds[i] : bounds[i + 1]])
        mine = bounds[i] + of
        times = strings[mine]
        values = found[np.repeat(kind_at[kind[mine]], times) + steps(times)]
        rows.append(i)
        sizes.append(len(of))
        out.append(press.compress(_planes(at[i][of]) + times.astype(np.uint8).tobytes() + _planes(values)))
    take = packs.select(["shard"]).take(pa.array(rows, pa.int64()))
    return pa.table({"shard": take["shard"], "n": pa.array(sizes, pa.int32()), "pack": pa.array(out, pa.binary())})


_KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _mark(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, shard, answers in _shards(batch, length):
            yield _kept(shard, covered(shard, answers, length))


def covered(shard: Shard, answers: pa.StructArray | None, length: int) -> np.ndarray:
    """Which bytes lie in a string with a smaller id than their text's."""
    n = len(shard.data)
    all_ = shard.stretches
    kind, kinds, least = shard.kinds()
    ids = shard.ids[all_.text]
    packs = [] if answers is None else [
        (size.as_py(), unsqueeze(pack.as_py(), np.uint8)) for size, pack in zip(answers.field("n"), answers.field("pack"))
    ]
    # The answered stretch, or the one that holds an answered string.
    places = [_from_planes(raw[: 4 * size], np.uint32).astype(np.int64) for size, raw in packs]
    stretch = [np.searchsorted(all_.first, at, side="right") - 1 for at in places]
    answered = np.zeros(len(kinds), dtype=bool)
    for of in stretch:
        answered[kind[of]] = True
    times = np.where(answered, all_.strings[kinds], 0)
    begins = np.cumsum(times) - times
    smallest = np.repeat(least, times)
    for (size, raw), at, of in zip(packs, places, stretch):
        strings = raw[4 * size : 5 * size].astype(np.int64)
        goes = begins[kind[of]] + at - all_.first[of]
        smallest[np.repeat(goes, strings) + steps(strings)] = _from_planes(raw[5 * size :], np.int64)
    change = np.zeros(n + 1, dtype=np.int32)
    whole = np.flatnonzero(~answered[kind] & (least[kind] < ids))
    change[all_.first[whole]] += 1
    change[all_.first[whole] + all_.strings[whole] + length - 1] -= 1
    single = np.flatnonzero(answered[kind])
    for i in range(0, len(single), _AT_ONCE):
        part = single[i : i + _AT_ONCE]
        times = all_.strings[part]
        step = steps(times)
        hit = smallest[np.repeat(begins[kind[part]], times) + step] < np.repeat(ids[part], times)
        at = (np.repeat(all_.first[part], times) + step)[hit]
        change[at] += 1
        change[at + length] -= 1
    return np.cumsum(change, dtype=np.int32)[:n] > 0


def _kept(shard: Shard, gone: np.ndarray) -> pa.RecordBatch:
    offsets = shard.offsets
    begins, ends = runs(gone, offsets)
    text = np.searchsorted(offsets, begins, side="right") - 1
    counts = np.bincount(text, minlength=len(shard.ids)) if len(begins) else np.zeros(len(shard.ids), dtype=int)
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(begins - offsets[text], pa.int64()), pa.array(ends - offsets[text], pa.int64())], ["start", "end"]
        ),
    )
    left = shard.data[~gone]
    sums = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = [left[a:b].tobytes() for a, b in zip(sums, sums[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard.ids, pa.int64(), mask=shard.ids == NO_ID),
            pa.array(np.diff(offsets), pa.int64()),
            spans,
            pa.array(kept, pa.binary()),
        ],
        ["doc_id", "n_bytes", "spans", "kept"],
    )


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    hot_shards: int = HOT_SHARDS,
    hot_stretches: int = HOT_STRETCHES,
) -> DataFrame:
    """doc_id, n_bytes, the removed spans (byte ranges, maximal, in order) and the kept bytes of every text.

    A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id.
    Strings are judged on the input, may overlap, and never cross texts.

    Null text is empty. A null id counts as larger than every id, so such a row loses what others hold and
    takes nothing from them. Rows with one id take nothing from each other. No rows give no rows.

    Texts are shuffled once, compressed; what else moves are packs of one shard for one bucket. There is a bucket for
    every two shards, so that a bucket's size does not grow with the input, or four for each shuffle partition up
    to `MOST_SPREAD` if that is more.
    """
    spark = docs.sparkSession
    given = docs.select(
        docs[quoted(id_col)].cast("long").alias("id"), docs[quoted(text_col)].cast("string").alias("text")
    )
    shards = stored(given.mapInArrow(lambda it: _cut(it, shard_bytes), _SHARDS), "shards")
    buckets = max(min(4 * partitions(spark), MOST_SPREAD), shards.count() // 2)

    def with_answers(packs: DataFrame) -> DataFrame:
        fields = [c for c in packs.columns if c != "shard"]
        lists = packs.groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias("answers"))
        return shards.join(lists, "shard", "left").select("shard", "ids", "sizes", "body", "answers")

    anchors = shards.mapInArrow(lambda it: _send_anchors(it, length, buckets), _ANCHORS)
    marks = anchors.groupBy("bucket").applyInArrow(lambda t: _answer_anchors(t, hot_shards, hot_stretches), _MARKS)
    sent = with_answers(marks).mapInArrow(lambda it: _send_stretches(it, length, buckets), _STRETCHES)
    least = sent.groupBy("bucket").applyInArrow(lambda t: _answer_stretches(t, length), _LEAST)
    return with_answers(least).mapInArrow(lambda it: _mark(it, length), _KEPT)
