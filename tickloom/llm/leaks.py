"""Benchmark passages in training documents, by suffix arrays of the training words.

Documents are read in shards of a few MB. In a shard the suffixes that can match (those whose first words
begin some benchmark window) are sorted into a suffix array of words, and every benchmark suffix is
binary-searched in it. What it finds is the verbatim matches, with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.blocks import Words, blocks, gram_hashes, mix, words
from tickloom.llm.frames import carried, quoted, stored

WINDOW = 10
LEAD = 4
SHARD_BYTES = 4 << 20
#: Benchmark text searched for in one pass over the documents; what is beyond takes further passes.
PASS_BYTES = 4 << 20
#: Flags of the bitmap that selects the documents for several passes (2 MB).
LEAD_MARKS = 1 << 24

_MATCH = "items array<string>, longest_words long, longest_item string, longest_at long"


class BenchmarkSuffixes:
    """All windows of all items, each once, with the (item, place) pairs where it starts."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.window = window
        names = sorted({"" if i is None else str(i) for i, _ in items})
        self.names = np.array(names, dtype=object)
        ranks = {name: k for k, name in enumerate(names)}
        rows, lengths, owners, places = [np.zeros((0, window), np.uint64)], [], [], []
        for item, text in items:
            found = next(blocks(pa.array([text], pa.string()))) if text else None
            hashes = words(found).hashes if found is not None else np.zeros(0, np.uint64)
            if not len(hashes):
                continue
            length = min(window, len(hashes))
            starts = np.arange(len(hashes) - length + 1)
            part = np.zeros((len(starts), window), np.uint64)
            part[:, :length] = hashes[starts[:, None] + np.arange(length)]
            rows.append(part)
            lengths.append(np.full(len(starts), length))
            owners.append(np.full(len(starts), ranks["" if item is None else str(item)]))
            places.append(starts)
        table = np.concatenate(rows)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, owners, places)]
        self.rows, of = np.unique(table, axis=0, return_inverse=True)
        of = of.ravel()
        order = np.argsort(of, kind="stable")
        self.owners, self.places = flat[1][order], flat[2][order]
        self.bounds = np.searchsorted(of[order], np.arange(len(self.rows) + 1))
        self.lengths = np.zeros(len(self.rows), np.int64)
        self.lengths[of] = flat[0]
        #: Hashes of the first words of windows, by their number.
        self.leads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(self.lengths, LEAD)):
            chosen = self.rows[np.minimum(self.lengths, LEAD) == n][:, :n]
            grams = np.unique([gram_hashes(r, int(n))[0] for r in chosen])
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.leads[int(n)] = (grams, seen)

    def candidates(self, found: Words) -> np.ndarray:
        """Places of words whose suffix begins like some window."""
        ends = np.repeat(found.bounds[1:], found.counts)
        keep = np.zeros(len(found.hashes), dtype=bool)
        for n, (grams, seen) in self.leads.items():
            hashes = gram_hashes(found.hashes, n)
            maybe = np.flatnonzero(seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[maybe + n <= ends[maybe]]
            keep[maybe[np.isin(hashes[maybe], grams)]] = True
        return np.flatnonzero(keep)

    def matches(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every occurrence in the shard."""
        at = self.candidates(found)
        if not len(at):
            return at, at
        ends = np.repeat(found.bounds[1:], found.counts)[at]
        reach = at[:, None] + np.arange(self.window)
        suffixes = np.where(reach < ends[:, None], found.hashes[np.minimum(reach, len(found.hashes) - 1)], 0)
        order = np.lexsort(suffixes.T[::-1])
        array = suffixes[order]
        low = self._search(array, strict=True)
        high = self._search(array, strict=False)
        times = high - low
        window = np.repeat(np.arange(len(self.rows)), times)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return window, at[order[np.repeat(low, times) + step]]

    def _search(self, array: np.ndarray, strict: bool) -> np.ndarray:
        """For every window the first suffix not before it (strict), or the first after all that begin with it."""
        low = np.zeros(len(self.rows), np.int64)
        high = np.full(len(self.rows), len(array), np.int64)
        beyond = np.arange(self.window) >= self.lengths[:, None]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            mine, other = self.rows[open_], array[middle]
            same = (mine == other) | beyond[open_]
            at = np.argmin(same, axis=1)
            line = np.arange(len(open_))
            smaller = ~same[line, at] & (other[line, at] < mine[line, at])
            if not strict:
                smaller |= same.all(axis=1)
            low[open_] = np.where(smaller, middle + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], middle)


def _find(texts: pa.Array, tests: BenchmarkSuffixes, shard_bytes: int) -> Iterator[tuple]:
    """(n_words, hit flags, items, longest words, longest item, longest place) of each text."""
    for block in blocks(texts, shard_bytes):
        found = words(block)
        window, at = tests.matches(found)
        n = len(found.hashes)
        length = tests.lengths[window]
        change = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
        hit = np.cumsum(change)[:n] > 0
        # Every (item, place in it) of each occurrence.
        times = np.diff(tests.bounds)[window]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        source = np.repeat(tests.bounds[window], times) + step
        owner, place, at, length = tests.owners[source], tests.places[source], np.repeat(at, times), np.repeat(length, times)
        text = np.searchsorted(found.bounds, at, side="right") - 1
        pairs = np.unique(text * len(tests.names) + owner) if len(at) else np.zeros(0, np.int64)
        pair_bounds = np.searchsorted(pairs, np.arange(len(found.counts) + 1) * max(len(tests.names), 1))
        best = _longest(text, owner, place, at, length)
        for i in range(len(found.counts)):
            mine = pairs[pair_bounds[i] : pair_bounds[i + 1]] % max(len(tests.names), 1)
            words_, item, where = best.get(i, (0, None, None))
            yield (
                int(found.counts[i]),
                hit[found.bounds[i] : found.bounds[i + 1]],
                list(tests.names[mine]),
                words_,
                None if item is None else tests.names[item],
                None if where is None else int(where - found.bounds[i]),
            )


def _longest(text, owner, place, at, length) -> dict[int, tuple[int, int, int]]:
    """The longest match of each text: neighbouring windows of one item on one diagonal make one match."""
    if not len(at):
        return {}
    order = np.lexsort((at, at - place, owner, text))
    text, owner, place, at, length = (x[order] for x in (text, owner, place, at, length))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (
        (text[1:] != text[:-1])
        | (owner[1:] != owner[:-1])
        | (at[1:] - place[1:] != at[:-1] - place[:-1])
        | (at[1:] != at[:-1] + 1)
    )
    head = np.flatnonzero(new)
    size = length[head] + np.diff(np.r_[head, len(at)]) - 1
    first = np.lexsort((owner[head], at[head], -size, text[head]))
    of = text[head][first]
    leading = first[np.r_[True, of[1:] != of[:-1]]]
    return {int(text[head[k]]): (int(size[k]), int(owner[head[k]]), int(at[head[k]])) for k in leading}


def _merge(old: tuple, new: tuple) -> tuple:
    """Results of two passes over one text; of equally long matches the earliest, then the smallest item, as in one pass."""
    longer = min(old, new, key=lambda x: (-x[3], x[5] or 0, x[4] or ""))
    return (new[0], old[1] | new[1], sorted({*old[2], *new[2]}), *longer[3:])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    pass_bytes: int = PASS_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """`row`, n_words, n_hit, items, contaminated and the longest match of every document.

    A window is `window` consecutive words of an item, or all words of an item with fewer. A document's word
    is hit if it lies in any occurrence of a window. items are the ids (as strings, sorted, each once) of
    items with such windows; longest_words, longest_item and longest_at (a word's number) tell the longest
    verbatim match, the earliest of equals, there the smallest item. Words are compared by 64-bit hashes.

    Null and empty texts have no words and no matches; items without words match nothing. Repeated rows are
    judged each for itself, repeated item ids are one item, and a null item id reads as an empty string.
    No documents give no rows; no items find nothing.

    longest_* tells of matches of whole windows; what is shorter than a window is no match.

    Documents are never shuffled: a pass sends at most about `pass_bytes` of benchmark text (measured before)
    to every task, and a larger benchmark takes as many passes as that needs, with the documents' hits kept
    in the shared folder between them. A single longer item is a pass of its own. Ahead of several passes the documents
    are read once with one bitmap of the first words of all windows; only those that have a mark in it go
    through the passes, the others are written once, without their texts.
    """
    spark = docs.sparkSession
    tests = benchmark.select(
        benchmark[quoted(item_col)].alias("item"), benchmark[quoted(item_text_col)].cast("string").alias("text")
    )
    size = tests.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    passes = max(1, -(-2 * size // pass_bytes)) if size > pass_bytes else 1
    kept = carried(docs, carry)
    state = docs.select(
        F.struct(*(docs[quoted(c)] for c in kept)).alias("row"), docs[quoted(text_col)].cast("string").alias("text")
    )
    clean = None
    if passes > 1:
        added = T._parse_datatype_string("n_words long, maybe boolean")
        marks = spark.sparkContext.broadcast(_lead_marks(tests, window))
        sifted = stored(state.mapInArrow(_sift(marks, shard_bytes), T.StructType([*state.schema.fields, *added.fields])), "leaks")
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(_MATCH).fields}
        nothing = {"items": F.array(), "longest_words": F.lit(0), "longest_item": F.lit(None), "longest_at": F.lit(None)}
        none = [nothing[c].cast(kind).alias(c) for c, kind in kinds.items()]
        clean = sifted.where("NOT maybe").select("row", "n_words", F.lit(0).cast("long").alias("n_hit"), *none)
        state = sifted.where("maybe").select("row", "text")
    for number in range(passes):
        chosen = tests.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == number) if passes > 1 else tests
        items = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in chosen.collect()])
        last = number == passes - 1
        added = T._parse_datatype_string(("n_words long, n_hit long, " if last else "hits binary, ") + _MATCH)
        schema = T.StructType([*state.schema.fields[: 1 if last else 2], *added.fields])
        state = state.mapInArrow(_pass(items, window, shard_bytes, last), schema)
        if not last:
            state = stored(state, "leaks")
    found = state if clean is None else state.union(clean)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _mark_spots(grams: np.ndarray, size: int) -> np.ndarray:
    return (mix(grams + np.uint64(size)) & np.uint64(LEAD_MARKS - 1)).astype(np.int64)


def _lead_marks(tests: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each of `LEAD_MARKS` hashes of the first words of any item's windows, and the numbers of such words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = BenchmarkSuffixes([(None, text) for text in batch.column(0).to_pylist()], window).leads
            spots = [_mark_spots(grams, n) for n, (grams, _) in leads.items()]
            spots = np.unique(np.concatenate(spots)) if spots else np.zeros(0, np.int64)
            sizes = [min(n, LEAD) for n in leads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[spots, np.full(len(sizes), -1)], pa.int64()), pa.array(np.r_[np.zeros(len(spots)), sizes], pa.int32())],
                ["spot", "size"],
            )

    found = tests.select("text").mapInArrow(run, "spot long, size int").distinct().toArrow()
    spot, size = found["spot"].to_numpy(), found["size"].to_numpy()
    marks = np.zeros(LEAD_MARKS, dtype=bool)
    marks[spot[spot >= 0]] = True
    return np.packbits(marks), np.unique(size[spot < 0])


def _sift(shared, shard_bytes: int):
    """Which texts hold the first words of some window; texts are kept of these only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sizes = shared.value
        marks = np.unpackbits(packed).astype(bool)
        for batch in batches:
            counts, maybe = [], []
            for block in blocks(batch.column(1), shard_bytes):
                found = words(block)
                ends = np.repeat(found.bounds[1:], found.counts)
                hit = np.zeros(len(found.hashes), dtype=bool)
                for n in sizes.tolist():
                    hit |= marks[_mark_spots(gram_hashes(found.hashes, n), n)] & (np.arange(len(ends)) + n <= ends)
                sums = np.concatenate([[0], np.cumsum(hit)])[found.bounds]
                counts.append(found.counts)
                maybe.append(np.diff(sums) > 0)
            flags = pa.array(np.concatenate(maybe) if maybe else [], pa.bool_())
            texts = pc.if_else(flags, batch.column(1), pa.scalar(None, batch.column(1).type))
            n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, n_words, flags], ["row", "text", "n_words", "maybe"])

    return run


def _pass(items, window: int, shard_bytes: int, last: bool):
    """The map of one pass; its batches hold row, text and, after the first pass, the hits so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = BenchmarkSuffixes(items.value, window)
        for batch in batches:
            found = list(_find(batch.column(1), tests, shard_bytes))
            if batch.num_columns > 2:
                before = zip(*(batch.column(k).to_pylist() for k in range(2, 7)))
                found = [
                    _merge((n[0], np.unpackbits(np.frombuffer(o[0], np.uint8), count=n[0]).astype(bool), *o[1:]), n)
                    for o, n in zip(before, found)
                ]
            n_words, hits, named, size, item, at = zip(*found)
            names = ["items", "longest_words", "longest_item", "longest_at"]
            columns = [
                pa.array(named, pa.list_(pa.string())),
                pa.array(size, pa.int64()),
                pa.array(item, pa.string()),
                pa.array(at, pa.int64()),
            ]
            if last:
                columns = [pa.array(n_words, pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), *columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "n_words", "n_hit", *names])
            else:
                packed = pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), packed, *columns], ["row", "text", "hits", *names]
                )

    return run
