"""The best documents for each item by a lexical score, found by a search down two trees at once.

A document is a sparse vector of what its terms may add to a score, an item one of its terms' weights; the score is
their product. Documents of a block and items lie in trees whose nodes hold the greatest value of each coordinate
below them. The product of two nodes is then at least that of any document and item below them, so a
pair whose product is under the weakest of the scores that its items have to beat is left out with all that lies below,
and the result is still exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.blocks import IS_WORD, Block, blocks, words
from tickloom.llm.frames import quoted, stored

BEST = 10
#: Item text searched for in one pass over the documents; what is beyond takes further passes.
PASS_BYTES = 4 << 20
#: Documents, about, whose scores give the first bounds.
SEEDS = 20_000
#: Items in a node of the lowest, and of the next, level of their tree; documents in the same of theirs.
ITEM_LEVELS = (8, 64)
DOC_LEVELS = (16, 256)
PIECE_BYTES = 4 << 20
SALTS = 32

_MARKS = 1 << 20


def _pieces(block: Block) -> Iterator[tuple[int, Block]]:
    """The block, or a long text in pieces cut between its words, each with the number of its first text."""
    if len(block.data) <= PIECE_BYTES or len(block.offsets) > 2:
        yield block.first, block
        return
    first, size = 0, len(block.data)
    while first < size:
        last = min(first + PIECE_BYTES, size)
        # On to the end of the word that the cut lies in.
        while last < size:
            beyond = np.flatnonzero(~IS_WORD[block.data[last : last + PIECE_BYTES]])
            if len(beyond):
                last += int(beyond[0])
                break
            last = min(last + PIECE_BYTES, size)
        data = block.data[first:last]
        yield block.first, Block(block.first, block.last, data, np.array([0, len(data)]))
        first = last


def item_terms(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The terms of all items, as sorted hashes, and of each item the numbers of its terms with their repeats."""
    hashes = []
    for text in texts:
        parts = [words(piece).hashes for block in blocks(pa.array([text], pa.string())) for _, piece in _pieces(block)]
        hashes.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return known, [np.unique(np.searchsorted(known, h), return_counts=True) for h in hashes]


def term_vectors(texts: pa.Array, known: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and bounds, numbers and repeats of its `known` terms."""
    totals = np.zeros(len(texts), dtype=np.int64)
    keys, times = [], []
    for block in blocks(texts):
        both = []
        for first, piece in _pieces(block):
            found = words(piece)
            totals[first : first + len(found.counts)] += found.counts
            maybe = np.flatnonzero(marks[(found.hashes & np.uint64(_MARKS - 1)).astype(np.int64)])
            hashes = found.hashes[maybe]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[at] == hashes if len(known) else np.zeros(0, dtype=bool)
            both.append((first + found.text_of_word()[maybe[same]]) * len(known) + at[same])
        key, n = np.unique(np.concatenate(both), return_counts=True)
        keys.append(key)
        times.append(n)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    n = np.concatenate(times) if times else np.zeros(0, np.int64)
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) * max(len(known), 1))
    return totals, bounds, key % max(len(known), 1), n


def marks_of(known: np.ndarray) -> np.ndarray:
    marks = np.zeros(_MARKS, dtype=bool)
    marks[(known & np.uint64(_MARKS - 1)).astype(np.int64)] = True
    return marks


@dataclass
class Vectors:
    """Sparse rows: those of row i are at [bounds[i], bounds[i + 1])."""

    bounds: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        counts = (self.bounds[1:] - self.bounds[:-1])[rows]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[rows], counts)
        return Vectors(bounds, self.terms[at], self.values[at])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of each row's values; along the first axis, if there are more."""
        out = np.zeros((len(self), *values.shape[1:]), dtype=values.dtype)
        filled = np.flatnonzero(self.bounds[1:] > self.bounds[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(values, self.bounds[filled], axis=0)
        return out

    def maxima(self, size: int) -> Vectors:
        """A row for each `size` rows, with the greatest value of each coordinate."""
        counts = self.bounds[1:] - self.bounds[:-1]
        node = np.repeat(np.arange(len(self)) // size, counts)
        order = np.lexsort((self.terms, node))
        node, terms, values = node[order], self.terms[order], self.values[order]
        new = np.ones(len(node), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])
        heads = np.flatnonzero(new)
        top = np.maximum.reduceat(values, heads) if len(heads) else values
        return Vectors(np.searchsorted(node[heads], np.arange(-(-len(self) // size) + 1)), terms[heads], top)

    def by_heaviest(self, weight: np.ndarray) -> np.ndarray:
        """An order in which rows with one heaviest term are neighbours. `weight` holds one number per value."""
        counts = self.bounds[1:] - self.bounds[:-1]
        row = np.repeat(np.arange(len(self)), counts)
        order = np.lexsort((self.terms, -weight, row))
        heads = np.full(len(self), -1)
        filled = np.flatnonzero(counts)
        heads[filled] = self.terms[order][self.bounds[filled]]
        heaviest = np.zeros(len(self), dtype=weight.dtype)
        heaviest[filled] = weight[order][self.bounds[filled]]
        return np.lexsort((-heaviest, heads))


class Items:
    """The items' tree. `weights` are those of the terms; terms without weight are left out."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, best: int):
        counts = np.array([len(t) for t, _ in terms], dtype=np.int64)
        flat = np.concatenate([t for t, _ in terms]) if terms else np.zeros(0, np.int64)
        value = (np.concatenate([n for _, n in terms]) if terms else np.zeros(0, np.int64)) * weights[flat]
        row = np.repeat(np.arange(len(terms)), counts)[value > 0]
        flat, value = flat[value > 0], value[value > 0]
        vectors = Vectors(np.searchsorted(row, np.arange(len(terms) + 1)), flat, value)
        self.numbers = vectors.by_heaviest(value)
        self.best, self.weights = best, weights
        low = vectors.take(self.numbers)
        middle = low.maxima(ITEM_LEVELS[0])
        self.levels = [middle.maxima(ITEM_LEVELS[1] // ITEM_LEVELS[0]), middle, low]

    def __len__(self) -> int:
        return len(self.numbers)


class Search:
    """The best documents of every item among the blocks it was given."""

    def __init__(self, items: Items, least: np.ndarray):
        self.items = items
        #: What a score must reach; by the items' order in the tree.
        self.least = least[items.numbers].copy()
        self.found: list[list[tuple]] = [[] for _ in range(len(items))]
        self.scratch = np.zeros(len(items.weights))
        self.places = np.full(len(items.weights), -1, dtype=np.int64)
        self._renew()

    def _renew(self) -> None:
        """The least score to reach below each node."""
        low, mid = self.least, ITEM_LEVELS[0]
        groups = np.minimum.reduceat(low, np.arange(0, len(low), mid)) if len(low) else low
        up = ITEM_LEVELS[1] // mid
        self.bars = [np.minimum.reduceat(groups, np.arange(0, len(groups), up)) if len(groups) else groups, groups, low]

    def _bounds(self, docs: Vectors, node: int, level: int, nodes: np.ndarray) -> np.ndarray:
        """The products of a node of documents and nodes of items."""
        own = slice(docs.bounds[node], docs.bounds[node + 1])
        terms = docs.terms[own]
        self.scratch[terms] = docs.values[own]
        chosen = self.items.levels[level].take(nodes)
        out = chosen.sums(chosen.values * self.scratch[chosen.terms])
        self.scratch[terms] = 0.0
        # Products of doubles may be off in their last places.
        return out * (1 + 1e-9) + 1e-6

    def block(self, docs: Vectors, ranks: np.ndarray, keys: pa.Array) -> None:
        """Search documents; `ranks` is the order of their keys, which decides between equal scores."""
        order = docs.by_heaviest(docs.values * self.items.weights[docs.terms])
        order = order[(docs.bounds[1:] > docs.bounds[:-1])[order]]
        if not len(order) or not len(self.items):
            return
        docs, ranks, keys = docs.take(order), ranks[order], keys.take(pa.array(order))
        leaves = docs.maxima(DOC_LEVELS[0])
        branches = leaves.maxima(DOC_LEVELS[1] // DOC_LEVELS[0])
        root = branches.maxima(len(branches))
        tree = (root, branches, leaves)
        self._descend(tree, 0, np.array([0]), np.arange(len(self.items.levels[0])), docs, ranks, keys)

    def _descend(self, tree, level, nodes, above, docs, ranks, keys) -> None:
        """Pairs of `nodes` of documents and of the item nodes `above`, the most promising first."""
        todo = []
        for node in nodes.tolist():
            bound = self._bounds(tree[level], node, level, above)
            open_ = bound >= self.bars[level][above]
            if open_.any():
                todo.append((-float((bound[open_] / self.bars[level][above][open_]).max()), node, above[open_], bound[open_]))
        for _, node, alive, bound in sorted(todo, key=lambda t: t[:2]):
            alive = alive[bound >= self.bars[level][alive]]  # the bars may have risen
            if not len(alive):
                continue
            if level == 2:
                self._leaf(node, alive, docs, ranks, keys)
                continue
            size = len(tree[0].bounds) and (len(tree[1]) if level == 0 else DOC_LEVELS[1] // DOC_LEVELS[0])
            below = np.arange(node * size, min((node + 1) * size, len(tree[level + 1])))
            step = ITEM_LEVELS[1] // ITEM_LEVELS[0] if level == 0 else ITEM_LEVELS[0]
            items = (alive[:, None] * step + np.arange(step)).ravel()
            items = items[items < len(self.items.levels[level + 1])]
            self._descend(tree, level + 1, below, items, docs, ranks, keys)

    def _leaf(self, leaf: int, items: np.ndarray, docs: Vectors, ranks: np.ndarray, keys: pa.Array) -> None:
        """The exact scores of a leaf's documents for some items."""
        first = leaf * DOC_LEVELS[0]
        last = min(first + DOC_LEVELS[0], len(docs))
        own = slice(docs.bounds[first], docs.bounds[last])
        terms = np.unique(docs.terms[own])
        self.places[terms] = np.arange(len(terms))
        table = np.zeros((len(terms), last - first), dtype=np.int64)
        of = np.repeat(np.arange(last - first), np.diff(docs.bounds[first : last + 1]))
        table[self.places[docs.terms[own]], of] = docs.values[own]
        chosen = self.items.levels[2].take(items)
        at = self.places[chosen.terms]
        row = np.repeat(np.arange(len(items)), np.diff(chosen.bounds))[at >= 0]
        values, at = chosen.values[at >= 0], at[at >= 0]
        self.places[terms] = -1
        held = Vectors(np.searchsorted(row, np.arange(len(items) + 1)), at, values)
        scores = held.sums(values[:, None] * table[at])
        for line in np.flatnonzero((scores >= self.least[items][:, None]).any(axis=1)).tolist():
            item, best = int(items[line]), self.items.best
            near = np.flatnonzero(scores[line] >= self.least[item])
            near = near[np.lexsort((ranks[first + near], -scores[line][near]))][:best]
            names = keys.take(pa.array(first + near)).to_pylist()
            new = [(-s, k is None, 0 if k is None else k) for s, k in zip(scores[line][near].tolist(), names)]
            self.found[item] = sorted(self.found[item] + new)[:best]
            if len(self.found[item]) == best:
                self.least[item] = max(self.least[item], -self.found[item][-1][0])
        self._renew()


def _values(totals: np.ndarray, times: np.ndarray, bounds: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What each term of each document adds to a score, per weight."""
    if documents * 75 * int(totals.max(initial=0)) >= 1 << 62:
        lengths = np.array([25 + 75 * n * documents // terms for n in totals.tolist()], dtype=np.int64)
    else:
        lengths = 25 + 75 * totals * documents // terms
    return 1_000_000_000 * times // (1000 * times + 8 * np.repeat(lengths, np.diff(bounds)))


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
    seeds: int = SEEDS,
) -> DataFrame:
    """item_id, rank, doc_id and score of the `best` documents of each item whose score is above 0.

    Terms are runs of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]` with A-Z lower-cased, compared by 64-bit hashes. N is the
    number of documents with a term, L of all their terms, n of one document's; df counts documents with a term, tf
    its places in one. With w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 25 + 75 n N div L, a score is the sum of
    w * (10**9 tf div (1000 tf + 8 m)) over the item's terms with their repeats; div rounds down.

    Equal scores are ranked by ascending id, a null id last. Every row is a document and every row of `items` an item,
    also where ids repeat. Null and empty texts have no terms: such documents count for nothing, such items find
    nothing. No documents or no items give no rows.

    A pass takes at most about `pass_bytes` of item text (measured before) to every task. It reads the texts once and
    stores of each document what it has of the pass's terms; weights and search read only that. About `seeds`
    documents are searched first: the scores they reach bound all others from the start, so tasks return few rows.
    """
    spark = docs.sparkSession
    given = docs.select(docs[quoted(id_col)].alias("key"), docs[quoted(text_col)].cast("string").alias("text"))
    tests = items.select(items[quoted(item_col)].alias("item"), items[quoted(item_text_col)].cast("string").alias("text"))
    key, item = given.schema["key"], tests.schema["item"]
    size = tests.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    passes = -(-2 * size // pass_bytes) if size > pass_bytes else 1
    made = []
    for number in range(passes):
        chosen = tests.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == number) if passes > 1 else tests
        rows = chosen.collect()
        known, terms = item_terms([r["text"] for r in rows])
        if len(known):
            names = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(rows)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", item.dataType)]))
            found = _pass(given, known, terms, best, seeds)
            if found is not None:
                made.append(found.join(F.broadcast(names), "number").select("item_id", "rank", F.col("key").alias("doc_id"), "score"))
    if not made:
        none = T.StructType([T.StructField("item_id", item.dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", key.dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], none)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _pass(given: DataFrame, known: np.ndarray, terms: list, best: int, seeds: int) -> DataFrame | None:
    """number, rank, key and score of the best documents of the items of one pass."""
    spark, key = given.sparkSession, given.schema["key"]
    sent = spark.sparkContext.broadcast(known)
    schema = T.StructType([key, *T._parse_datatype_string("n long, terms array<int>, times array<int>").fields])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_of(sent.value)
        for batch in batches:
            totals, bounds, numbers, times = term_vectors(batch.column(1), sent.value, marks)
            at = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (numbers, times)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals), *lists], schema.names)
            yield out.filter(pa.array(totals > 0))

    held = stored(given.mapInArrow(vectors, schema), "vectors")
    documents, total = held.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    weights = np.zeros(len(known), dtype=np.int64)
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    tree = spark.sparkContext.broadcast(Items(terms, weights, best))

    def search(rows: DataFrame, least) -> DataFrame:
        fields = T.StructType([T.StructField("number", T.IntegerType()), key, T.StructField("score", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = Search(tree.value, least.value)
            for batch in batches:
                names, n, lists, repeats = batch.columns
                at = lists.offsets.to_numpy().astype(np.int64)
                numbers = lists.values.to_numpy().astype(np.int64)[at[0] : at[-1]]
                times = repeats.values.to_numpy().astype(np.int64)[at[0] : at[-1]]
                bounds = at - at[0]
                values = _values(n.to_numpy(), times, bounds, documents, total)
                # Terms that nearly every document has weigh nothing.
                kept = tree.value.weights[numbers] > 0
                bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
                ranks = pc.rank(names, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy()
                state.block(Vectors(bounds, numbers[kept], values[kept]), ranks.astype(np.int64), names)
            found = [(i, None if null else k, -s) for i, own in zip(tree.value.numbers.tolist(), state.found) for s, null, k in own]
            if found:
                i, k, s = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, names.type), pa.array(s, pa.int64())], fields.names)

        return rows.mapInArrow(run, fields)

    def top(rows: DataFrame) -> DataFrame:
        """The best of each item; first within parts of its candidates, so that no task has to sort all of them."""
        order = (F.desc("score"), F.asc_nulls_last("key"))
        part = Window.partitionBy("number", "salt").orderBy(*order)
        few = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part))
        whole = Window.partitionBy("number").orderBy(*order)
        return few.where(F.col("rank") <= best).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= best).drop("salt")

    least = np.ones(len(terms), dtype=np.int64)
    if documents > seeds:
        some = held.sample(seeds / documents, seed=1)
        reached = top(search(some, spark.sparkContext.broadcast(least))).where(F.col("rank") == best)
        for row in reached.select("number", "score").collect():
            least[row["number"]] = row["score"]
    return top(search(held, spark.sparkContext.broadcast(least)))
