"""Near-copies by DartMinHash signatures of weighted shingles, joined by bands and verified on the texts.

A text is a multiset of five-word shingles; an element with weight w takes the region [0, w) of its line.
Hashed darts fall on every line as a Poisson process in (place, rank, coordinate). A coordinate of the
signature is the earliest dart, by rank, that hits the text's regions, so two texts agree in a coordinate with a
chance equal to their weighted Jaccard similarity. A text of weight W has hits on all t coordinates at a rank
of about ln(t) / W, so only some t * ln(t) darts are thrown for it, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import FOLDED_VALUES, blocks, hashed_cells, mix, prefix_hashes, shingles, span_hashes, words
from tickloom.llm.components import components
from tickloom.llm.frames import map_texts, quoted, stored
from tickloom.session import session_conf

SIZE = 5
SIMILARITY = 0.8
#: Two texts at 0.8 share one of 20 bands of 4 with a chance of 0.99997.
BANDS = 20
ROWS = 4

#: Keys of a band that are compared with each other directly.
DIRECT = 32
COUNTERS = 1 << 20
#: Ranges of counters, and groups of tasks, by which the tasks' sums are added up.
PARTS = 64
SPREAD = 256
#: Parts that the rows of a class are dealt to.
SALTS = 32
#: Longs of 64 parity bits in a text's sketch.
PARITY = 4

_RANK = np.uint64(0xA24BAED4963EE407)
_DART = np.uint64(0x9FB21C651E98DF25)
_PARITY = np.uint64(0xC2B2AE3D27D4EB4F)
_SLACK = 2.3


def throw_darts(
    text: np.ndarray, cells: np.ndarray, texts: int, coordinates: int, share: np.ndarray | None = None
) -> np.ndarray:
    """Signatures (texts x coordinates) from unit cells of element lines, each (text, cell hash).

    `share` is the part of a cell that the region covers, for weights that are not whole numbers; 1 if None.
    A text without cells has a signature of zeros.
    """
    part = np.ones(len(cells)) if share is None else share
    weight = np.bincount(text, weights=part, minlength=texts)
    best = np.full(texts * coordinates, np.inf)
    signature = np.zeros(texts * coordinates, dtype=np.uint64)
    todo = weight > 0
    limit = np.zeros(texts)
    limit[todo] = (np.log(coordinates) + _SLACK) / weight[todo]
    while todo.any():
        chosen = np.flatnonzero(todo[text])
        keys, ranks, darts = [], [], []
        active, rank, number = chosen, np.zeros(len(chosen)), np.zeros(1, np.uint64)
        while len(active):
            number += np.uint64(1)
            chance = (mix(cells[active] + _RANK * number) >> np.uint64(11)) * 2.0**-53
            rank = rank - np.log1p(-chance) / coordinates
            early = rank < limit[text[active]]
            active, rank = active[early], rank[early]
            dart = mix(cells[active] + _DART * number)
            place = (dart >> np.uint64(40)) * 2.0**-24
            inside = place < part[active]
            hit = active[inside]
            coordinate = (dart[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(coordinates)
            keys.append(text[hit] * coordinates + coordinate.astype(np.int64))
            ranks.append(rank[inside])
            darts.append(dart[inside])
        key, rank, dart = (np.concatenate(x) for x in (keys, ranks, darts))
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        signature[key[first]] = dart[first]
        empty = np.isinf(best.reshape(texts, coordinates)).any(axis=1)
        todo &= empty
        limit[todo] *= 2
    return signature.reshape(texts, coordinates)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each signature; it holds the band's number."""
    out = np.zeros((len(signatures), bands), dtype=np.uint64)
    out += np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * _DART + signatures[:, k : bands * rows : rows])
    return out.view(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])[bounds]
    return total[1:] - total[:-1]


def sign_texts(texts: pa.Array, size: int, bands: int, rows: int) -> dict[str, pa.Array]:
    keys: list[bytes] = []
    weights, all_bands, counts = [], [], []
    for block in blocks(texts):
        text, cells = hashed_cells(shingles(words(block), size))
        n = len(block.offsets) - 1
        weight = np.bincount(text, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(weight)])
        # The multiset's hash: two sums over its cells. Without words, the whole text's.
        one, two = _sums(mix(cells ^ _RANK), bounds), _sums(mix(cells ^ _DART), bounds)
        bare = np.flatnonzero(weight == 0)
        if len(bare):
            starts, ends = block.offsets[bare], block.offsets[bare + 1]
            for k, out in ((1, one), (2, two)):
                sums, up = prefix_hashes(block.data, mix(FOLDED_VALUES + np.uint64(k)))
                out[bare] = mix(span_hashes(sums, up, starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1)
        raw = np.stack([one, two], axis=1).astype(">u8").tobytes()
        keys += [raw[16 * i : 16 * i + 16] for i in range(n)]
        signed = weight > 0
        made = band_keys(throw_darts(text, cells, n, bands * rows), bands, rows)[signed]
        weights.append(weight)
        all_bands.append(made.ravel())
        counts.append(signed * bands)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, int)
    flat = np.concatenate(all_bands) if all_bands else np.zeros(0, np.int64)
    return {
        "key": pa.array(keys, pa.binary()),
        "weight": pa.array(np.concatenate(weights) if weights else [], pa.int64()),
        "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
    }


def similarities(one: pa.Array, two: pa.Array, size: int = SIZE) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts, exactly."""
    out = np.zeros(len(one))
    for i in range(0, len(one), 256):
        sides = []
        for column in (one.slice(i, 256), two.slice(i, 256)):
            parts, base = [], 0
            for block in blocks(column):
                text, cells = hashed_cells(shingles(words(block), size))
                parts.append((text + base, cells))
                base += len(block.offsets) - 1
            sides.append(tuple(np.concatenate(x) for x in zip(*parts)))
        n = len(one.slice(i, 256))
        text = np.concatenate([sides[0][0], sides[1][0]])
        cells = np.concatenate([sides[0][1], sides[1][1]])
        order = np.lexsort((cells, text))
        text, cells = text[order], cells[order]
        # Cells are distinct within a text, so one that comes twice is in both.
        twice = (text[1:] == text[:-1]) & (cells[1:] == cells[:-1])
        shared = np.bincount(text[1:][twice], minlength=n)
        total = np.bincount(text, minlength=n) - shared
        out[i : i + n] = np.where(total > 0, shared / np.maximum(total, 1), 0.0)
    return out


def _close(one: str, two: str, similarity: float):
    """Weights that allow the similarity."""
    return F.least(one, two) >= F.greatest(one, two) * F.lit(similarity)


def prefix_tokens(
    text: np.ndarray, cells: np.ndarray, weight: np.ndarray, common: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, place) of the cells that any partner of a text must share one of.

    Cells are put in one order for all texts, rare ones first by the counters `common`. Two texts with weights
    v and w and the similarity t share at least t / (1 + t) * (v + w) cells, so their first common cell leaves
    as many places in both. The lightest partner allowed, of weight t * w, asks for the fewest, so that cell lies among
    the first w + 1 less that number; whether it leaves enough places for the partner it meets is told by its place.
    """
    spot = (cells & np.uint64(len(common) - 1)).astype(np.int64)
    order = np.lexsort((cells, common[spot], text))
    text, cells = text[order], cells[order]
    bounds = np.concatenate([[0], np.cumsum(weight)])
    place = np.arange(len(cells)) - bounds[text]
    lightest = np.ceil(similarity * weight - 1e-9)
    need = np.ceil(similarity / (1 + similarity) * (weight + lightest) - 1e-9)
    chosen = place < (weight - need + 1)[text]
    return text[chosen], cells[chosen], place[chosen]


def token_spots(cells: np.ndarray) -> np.ndarray:
    """Where a token is counted; unrelated to where its cell is."""
    return (mix(cells ^ _RANK) & np.uint64(COUNTERS - 1)).astype(np.int64)


def parities(text: np.ndarray, cells: np.ndarray, texts: int) -> np.ndarray:
    """PARITY longs for each text: bit i is the parity of its cells that hash to i.

    A cell that only one of two texts has changes one bit, so they differ in at least as many cells as bits.
    """
    bits = 64 * PARITY
    spot = (mix(cells ^ _PARITY) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(text * bits + spot, minlength=texts * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(texts, bits), axis=1).view(np.int64)


def _counters(rows: DataFrame, spots) -> np.ndarray:
    """How many of the rows' hashes fall on each of 2**20 counters.

    `spots` gives arrays of counter numbers for a batch. A task adds up its own and sends a pack for each of `PARTS`
    ranges of counters. These meet by range and by one of `SPREAD` groups of tasks, then by range, so what a task
    holds is at most a pack (some 200 KB) for every `SPREAD` tasks. The counters' fixed number comes to the driver.
    """
    width = COUNTERS // PARTS

    def add(batches):
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for found in spots(batch):
                sums += np.bincount(found, minlength=COUNTERS)
        parts = [k for k in range(PARTS) if sums[k * width : (k + 1) * width].any()]
        packs = [_packed(sums[k * width : (k + 1) * width]) for k in parts]
        group = np.full(len(parts), TaskContext.get().partitionId() % SPREAD)
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array(group, pa.int32()), pa.array(packs, pa.binary())], ["part", "group", "pack"]
        )

    def total(table: pa.Table) -> pa.Table:
        sums = np.zeros(width, dtype=np.int64)
        for pack in table["pack"]:
            at, times = _unpacked(pack.as_py())
            sums[at] += times
        return pa.table({"part": table["part"][:1], "pack": pa.array([_packed(sums)], pa.binary())})

    kind = "part int, pack binary"
    packs = rows.mapInArrow(add, "part int, group int, pack binary").groupBy("part", "group").applyInArrow(total, kind)
    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in packs.groupBy("part").applyInArrow(total, kind).collect():
        at, times = _unpacked(row["pack"])
        out[row["part"] * width + at] = times
    return out


def _packed(sums: np.ndarray) -> bytes:
    """The counters that are not zero: their places, then what they hold."""
    at = np.flatnonzero(sums)
    return at.astype("<i4").tobytes() + sums[at].astype("<i8").tobytes()


def _unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(pack) // 12
    return np.frombuffer(pack, "<i4", n), np.frombuffer(pack, "<i8", n, 4 * n)


def prefix_pairs(members: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, wa, b, wb): pairs of keys under different labels that may reach the similarity; none that does is left out.

    `members` has band, key, label and weight. Only keys outside their band's largest label are searched
    for, among all. Cells that many texts share stand last in the order, so in a group of edited copies the
    index holds what is special to each of them. A token, one per key and cell, goes into the index only if it can meet
    one of the other side: a searched key's if any other key has it, another key's if a searched one has it. Order
    and marks use 2**20 counters, so their size is fixed. Each token carries its text's parities, from
    which the join itself sees most pairs that differ in too many cells.
    """
    spark = members.sparkSession
    sizes = members.groupBy("band", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("size", "label")).alias("l")).select("band", F.col("l.label").alias("main"))
    keys = (
        members.join(largest, "band")
        .groupBy("key", "label", "weight")
        .agg(F.max(F.col("label") != F.col("main")).alias("outside"))
    )
    held = stored(keys.join(texts, "key"), "members")

    def cells_of(column: pa.Array):
        for block in blocks(column):
            text, cells = hashed_cells(shingles(words(block), size))
            yield block, text, cells

    def cell_spots(batch: pa.RecordBatch):
        for _, _, cells in cells_of(batch.column(0)):
            yield (cells & np.uint64(COUNTERS - 1)).astype(np.int64)

    common = np.maximum(_counters(held.select("text"), cell_spots), 1)
    shared = spark.sparkContext.broadcast(common.astype(np.int32) if common.max() < 1 << 31 else common)

    def tokens_of(column: pa.Array):
        for block, text, cells in cells_of(column):
            weight = np.bincount(text, minlength=len(block.offsets) - 1)
            yield block, text, cells, weight, prefix_tokens(text, cells, weight, shared.value, similarity)

    def prefix_spots(batch: pa.RecordBatch):
        for *_, found in tokens_of(batch.column(0)):
            yield token_spots(found[1])

    own = _counters(held.where("outside").select("text"), prefix_spots)
    other = _counters(held.where("NOT outside").select("text"), prefix_spots)
    # What a searched key's token, and what another key's, has to find set.
    marks = spark.sparkContext.broadcast((own + other > 1, own > 0))

    names = ["cell", "place", *(f"bits{k}" for k in range(PARITY))]
    kind = "row struct<key:binary,label:binary,weight:long,outside:boolean>, cell long, place int"
    kind += "".join(f", bits{k} long" for k in range(PARITY))

    def run(batches):
        for batch in batches:
            outside = batch.column(0).field("outside").to_numpy(zero_copy_only=False).astype(bool)
            for block, text, cells, weight, (of, cell, place) in tokens_of(batch.column(1)):
                spot = token_spots(cell)
                searched, among = marks.value
                keep = np.where(outside[of + block.first], searched[spot], among[spot])
                of, cell, place = of[keep], cell[keep], place[keep]
                columns = [batch.column(0).take(pa.array(of + block.first)), pa.array(cell.view(np.int64)), pa.array(place, pa.int32())]
                parity = parities(text, cells, len(weight))[of]
                columns += [pa.array(np.ascontiguousarray(parity[:, k])) for k in range(PARITY)]
                yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    given = held.select(F.struct("key", "label", "weight", "outside").alias("row"), "text")
    tokens = stored(given.mapInArrow(run, kind).select("row.*", *names), "tokens")

    def side(rows: DataFrame, name: str) -> DataFrame:
        columns = {"key": name, "label": f"l{name}", "weight": f"w{name}", "place": f"p{name}"}
        columns |= {f"bits{k}": f"{name}{k}" for k in range(PARITY)}
        return rows.select("cell", *(F.col(c).alias(n) for c, n in columns.items()))

    left_over = F.least(F.col("wa") - F.col("pa"), F.col("wb") - F.col("pb"))
    need = F.lit(similarity / (1 + similarity)) * (F.col("wa") + F.col("wb")) - 1e-9
    # Texts that share at least t / (1 + t) of v + w cells differ in at most (1 - t) / (1 + t) of them.
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(PARITY)), F.lit(0))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("wa") + F.col("wb")) + 1e-9
    pairs = side(tokens.where("outside"), "a").join(side(tokens, "b"), "cell")
    pairs = pairs.where("la <> lb").where(_close("wa", "wb", similarity)).where(left_over >= need).where(differ <= most)
    return pairs.select("a", "wa", "b", "wb")


def near_copies(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SIZE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and class_id of every row, in columns of these names: class_id is the smallest id of the texts that links join to this one.

    A link is a weighted Jaccard similarity of the texts' shingles of at least `similarity`. All words of a text
    with fewer than `size` are one shingle. Texts without words are only linked to the same text (but for
    the case of A-Z); null is the empty text.

    Texts with the same shingles become one key first, so exact copies take no part in the search, however
    many there are. Of the keys that share a band, all are compared with the most central one, which shares
    most bands with others: in a group of copies that is their origin. Where a band still holds several
    components, its keys are compared across these: in a band of at most `DIRECT` keys directly, else by
    `prefix_pairs`, which finds the same links without pairing all keys. So a band in which all are linked
    takes one comparison per key, and no link between keys that share a band is lost.

    Rows with one id and different texts are classed by text. Null ids have classes, but do not name one
    unless a class has no other (then class_id is null). No rows give no rows.
    """
    found = copy_classes(docs, similarity, size, bands, rows, id_col, text_col)
    classes = found.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    # A class may hold a third of all rows: they go to `SALTS` places, and the classes, one row each, to all of these.
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "print"), F.lit(SALTS)).cast("int"))
    return salted.join(classes, ["label", "salt"]).select("doc_id", "class_id")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near-copies: of each class (see `near_copies`) the row with the smallest id stays,
    a null id last; of rows with one id, that with the least hash of its text; of equal rows, one."""
    found = copy_classes(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("bare"), "doc_id", "print")).alias("w"))
    kept = kept.select(_name(F.col("w.doc_id")).alias("kept_id"), F.col("w.print").alias("kept_print"))
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(docs[quoted(c)] for c in docs.columns)).alias("row"),
        _name(docs[quoted(id_col)]).alias("kept_id"),
        F.xxhash64(text).alias("kept_print"),
    )
    # Equal rows meet in one partition by the join's keys, so the second step needs no shuffle.
    return rows.join(kept, ["kept_id", "kept_print"]).dropDuplicates(["kept_id", "kept_print"]).select("row.*")


def _name(ident):
    return F.coalesce(ident.cast("string"), F.lit("null"))


def copy_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SIZE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, print (a hash of the text) and label (of the class, see `near_copies`) of every row."""
    spark = docs.sparkSession
    given = docs.select(docs[quoted(id_col)].alias("doc_id"), F.coalesce(docs[quoted(text_col)].cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("print", F.xxhash64("text"))
    signed = stored(
        map_texts(
            given,
            lambda texts: sign_texts(texts, size, bands, rows),
            "key binary, weight long, bands array<long>",
            carry=["doc_id", "print"],
        ).select("row.*", "key", "weight", "bands"),
        "signed",
    )
    held = signed.groupBy("key").agg(
        F.first("weight").alias("weight"),
        F.first("bands").alias("bands"),
        F.min(F.struct("doc_id", "print")).alias("least"),
    )
    held = stored(held.where(F.size("bands") > 0), "keys")
    banded = held.select("key", "weight", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(banded.join(shared, "band"), "bands")
    central = crowded.groupBy("key").agg(F.sum("n").alias("central"))
    crowded = stored(crowded.join(central, "key"), "bands")

    found = held.join(crowded.select("key").distinct(), "key", "left_semi").select(
        "key", F.col("least.doc_id").alias("id"), F.col("least.print").alias("print")
    )
    texts = given.join(found, given["doc_id"].eqNullSafe(found["id"]) & (given["print"] == found["print"]))
    texts = stored(texts.select("key", "text").dropDuplicates(["key"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, with weights wa, wb) that are similar; texts of a hot key are split by adaptive execution."""
        likely = pairs.where(_close("wa", "wb", similarity))
        both = (
            likely.select("a", "b")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("two")), "b")
            .join(texts.select(F.col("key").alias("a"), F.col("text").alias("one")), "a")
        )

        def run(batches):
            for batch in batches:
                near = similarities(batch.column(2), batch.column(3), size) >= similarity
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

        made = both.select("a", "b", "one", "two").mapInArrow(run, "a binary, b binary")
        with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
            return stored(made, "links")

    # The least key of a band's most central members: a group of copies has its common origin there.
    pivots = crowded.groupBy("band").agg(F.max(F.struct("central", F.col("key").alias("a"), F.col("weight").alias("wa"))).alias("p"))
    pairs = crowded.join(pivots, "band").where("key <> p.a").select("p.a", "p.wa", F.col("key").alias("b"), F.col("weight").alias("wb"))
    links = linked(pairs.distinct())
    labels = components(links)

    member = crowded.join(labels, "key", "left").select(
        "band", "n", "key", "weight", F.coalesce("label", "key").alias("label")
    )
    several = member.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    mixed = stored(member.join(several.select("band"), "band", "left_semi"), "mixed")
    few = mixed.where(F.col("n") <= DIRECT)
    left = few.select("band", F.col("key").alias("a"), F.col("weight").alias("wa"), F.col("label").alias("la"))
    right = few.select("band", F.col("key").alias("b"), F.col("weight").alias("wb"), F.col("label").alias("lb"))
    direct = left.join(right, "band").where("la < lb").where(_close("wa", "wb", similarity)).select("a", "wa", "b", "wb")
    indexed = prefix_pairs(mixed.where(F.col("n") > DIRECT), texts, similarity, size)
    rest = direct.union(indexed).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("wa", "wb").alias("wa"), F.greatest("wa", "wb").alias("wb")
    )
    links = links.union(linked(rest.distinct()))
    labels = components(links)

    named = signed.join(labels, "key", "left")
    return named.select("doc_id", "print", F.coalesce("label", "key").alias("label"))
