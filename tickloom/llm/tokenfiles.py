"""Token ids in Parquet: a list per document, in id order, in row groups and pages small enough to read a part.

A folder of token files holds

    rows/    key, part, first, n_tokens, ids, row       one row per document
    parts/   part, base, n_tokens                       one row per file of `rows`

`ids` is dictionary-encoded (a page of bit-packed places in the row group's dictionary), the ascending numbers are
delta-encoded. `first` counts from the file's beginning, so files are written at once without knowing of each
other; `base` is what the files before hold. Row groups, pages and the page index come from Spark's own writer, so
a reader that asks for some columns, some keys or some places of the token stream fetches those pages only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.blocks import Block, blocks, mix
from tickloom.llm.frames import quoted, row_of

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
#: Pieces that a task remembers, and the longest of them in bytes.
REMEMBERED = 3 << 18
LONGEST = 64
CHUNK_BYTES = 3 << 20
LONG_PIECE = 1 << 16

# What a byte may be: one of the four blanks, an ASCII mark, an ASCII letter, the first byte of two that are a letter
# (U+00C0 to U+023F and U+0400 to U+047F but for the two of `_TIMES`), the first byte of other white space, or ink.
_BLANK, _MARK, _LETTER, _LEAD, _SUSPECT, _INK = (np.uint8(1 << k) for k in range(6))
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(b" \t\r\n")] |= _BLANK
_KINDS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] |= _MARK
_KINDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] |= _LETTER
_KINDS[[*range(0xC3, 0xC9), 0xD0, 0xD1]] |= _LEAD
_KINDS[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] |= _SUSPECT
_KINDS[33:127] |= _INK
_TIMES = (0x97, 0xB7)
# The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
# Beside the four blanks, what any version of Unicode may count as white space; the same as bounds of three bytes.
_OTHER_SPACE = [(0x0B, 0x0C), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E)]
_OTHER_SPACE += [(0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_SPACE_FROM = np.array([int.from_bytes(chr(a).encode().ljust(3, b"\x00")) for a, _ in _OTHER_SPACE])
_SPACE_TO = np.array([int.from_bytes(chr(b).encode().ljust(3, b"\xff")) for _, b in _OTHER_SPACE])
# Between a mark that is no letter, digit, space or apostrophe and a letter.
_MARK_LETTER = re.compile(
    r"(?<=[!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"
    r"(?=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])"
)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> dict[str, int]:
    return {t.content: i for i, t in _tokenizer(path).get_added_tokens_decoder().items() if t.special}


@cache
def _word_tokenizer(path: str):
    """The file's model for words, written in byte-level letters, between spaces; the letter of a byte; the bytes of an id.

    None where the file does more with a word of letters than to give it to its model, byte by byte.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = _tokenizer(path)
    model, before, added = whole.model, whole.pre_tokenizer, whole.get_added_tokens_decoder().values()
    if not isinstance(model, models.BPE) or not isinstance(before, pre_tokenizers.ByteLevel) or whole.normalizer is not None:
        return None
    if before.add_prefix_space or not before.use_regex or not all(t.special for t in added):
        return None
    if model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
        return None
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.arange(256, dtype="<u4")
    letters[np.setdiff1d(np.arange(256), printed)] = 256 + np.arange(256 - len(printed))
    vocabulary = whole.get_vocab(with_added_tokens=False)
    if not {chr(c) for c in letters.tolist()} <= vocabulary.keys():
        return None
    sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for piece, i in vocabulary.items():
        sizes[i] = len(piece)
    words = Tokenizer(model)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return words, letters, sizes


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - ends + lengths, lengths)
    places += np.arange(len(places))
    return places


class Remembered:
    """Ids of pieces by the hashes of their bytes; `told`, their size and bytes, is compared, too."""

    def __init__(self):
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.told = np.zeros((0, 4), dtype=np.uint64)
        self.starts, self.lengths = np.zeros((2, 0), dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def find(self, hashes: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The place of each; -1 for one that is not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.told[at] == told).all(axis=1), at, -1)

    def add(self, hashes: np.ndarray, told: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Ascending hashes; one that is there already stays what it is."""
        at = np.searchsorted(self.hashes, hashes)
        new = np.searchsorted(self.hashes, hashes, side="right") == at
        at, lengths, ids = at[new], lengths[new], ids[_places(starts[new], lengths[new])]
        self.hashes = np.insert(self.hashes, at, hashes[new])
        self.told = np.insert(self.told, at, told[new], axis=0)
        self.starts = np.insert(self.starts, at, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.ids = np.concatenate([self.ids, ids])


class TextEncoder:
    """Ids of texts by a tokenizer whose words are ` ?letters`, ` ?digits`, ` ?marks` or white space.

    No word of such a tokenizer holds white space behind something else, or a mark behind a letter, so a text may be
    cut in front of each run of blanks and between a letter and a mark; the pieces' ids, one after the other, are
    the text's. Pieces of a block are found and told apart by their bytes in whole arrays, and one that came before is
    not encoded again. A piece ` ?letters` is one word, and goes to the tokenizer's model without a search for words.
    Where a text has other white space, it is cut behind ASCII signs and letters only; one
    with a special token's name is encoded as it is. A long text without blanks is cut between marks and letters; memory grows with the
    longest run of letters, not with the text.
    """

    def __init__(self, path: str):
        self.path = path
        # Pieces seen lately and those seen before; the latter are forgotten when there are too many of the former.
        self.known, self.before = Remembered(), Remembered()
        # The same for pieces of more than 24 bytes.
        self.longer: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The same, many pieces in one call: a special token's name between two keeps them apart."""
        if not _special(self.path):
            return self._encode(pieces)
        name, mark = next(iter(_special(self.path).items()))
        out: list[bytes] = []
        for i in range(0, len(pieces), 1000):
            (joined,) = self._encode([name.join(pieces[i : i + 1000])])
            at = 4 * np.flatnonzero(np.frombuffer(joined, dtype="<u4") == mark)
            starts, ends = [0, *(at + 4).tolist()], [*at.tolist(), len(joined)]
            out += [joined[a:b] for a, b in zip(starts, ends)]
        return out

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each ` ?letters` in `data`, and all ids. A byte-level id stands for its bytes, so sizes part the words."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        words, letters, bytes_of = _word_tokenizer(self.path)
        ends = np.cumsum(sizes + 1)
        signs = letters[data[_places(starts, sizes + 1)]]
        signs[ends - 1] = ord(" ")
        edges = [0, *ends[999:-1:1000].tolist(), len(signs)]
        ids = []
        for a, b in zip(edges, edges[1:]):
            (found,) = words.encode_batch_fast([signs[a : b - 1].tobytes().decode("utf-32-le")], add_special_tokens=False)
            ids.append(np.array(found.ids, dtype="<u4"))
        ids = np.concatenate(ids)
        upto = np.searchsorted(np.cumsum(bytes_of[ids]), np.cumsum(sizes)) + 1
        return np.diff(upto, prepend=0), ids

    def _alone(self, piece: bytes, plain: bool) -> bytes:
        """The ids of a piece that is not looked up with others; one that is `plain` must not be cut."""
        if len(piece) <= LONGEST and not plain:
            if piece not in self.longer:
                if 2 * len(self.longer) > REMEMBERED:
                    self.longer = {}
                self.longer[piece] = self._encode([piece.decode()])[0]
            return self.longer[piece]
        text = piece.decode()
        parts = _MARK_LETTER.split(text) if len(piece) > LONG_PIECE and not plain else [text]
        return b"".join(self._encode([part])[0] for part in parts)

    def _odd(self, block: Block, raw: bytes, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with a special token's name, and those with white space other than blanks."""
        named, spaced = np.zeros((2, len(block.offsets) - 1), dtype=bool)
        for name in (name.encode() for name in _special(self.path)):
            if name in raw:
                named |= [name in raw[i:j] for i, j in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
        at = np.flatnonzero(kinds & _SUSPECT)
        three = sum(block.data[np.minimum(at + k, len(raw) - 1)].astype(np.int64) << (16 - 8 * k) for k in range(3))
        at = at[three <= _SPACE_TO[np.searchsorted(_SPACE_FROM, three, side="right") - 1]]
        spaced[np.searchsorted(block.offsets, at, side="right") - 1] = True
        return named, spaced

    def _ids_of(self, hashes: np.ndarray, told: np.ndarray, starts: np.ndarray, word: np.ndarray, data: np.ndarray):
        """Where the ids of distinct pieces begin, their numbers, and the ids: remembered ones and those made now.

        Hashes ascend; `word` tells which pieces are ` ?letters`.
        """
        if 2 * len(self.known.hashes) > REMEMBERED:
            self.known, self.before = Remembered(), self.known
        sizes = told[:, 0].astype(np.int64)
        begin, lengths = np.zeros((2, len(hashes)), dtype=np.int64)
        parts, flat, missing = [], [], np.arange(len(hashes))
        for held in (self.known, self.before):
            at = held.find(hashes[missing], told[missing])
            found, at, missing = missing[at >= 0], at[at >= 0], missing[at < 0]
            lengths[found] = held.lengths[at]
            parts.append(found)
            flat.append(held.ids[_places(held.starts[at], held.lengths[at])])
        word = word & (_word_tokenizer(self.path) is not None)
        words, others = missing[word[missing]], missing[~word[missing]]
        lengths[words], ids = self._encode_words(data, starts[words], sizes[words])
        made = self._encode_pieces([data[i:j].tobytes().decode() for i, j in zip(starts[others].tolist(), (starts + sizes)[others].tolist())])
        lengths[others] = [len(x) // 4 for x in made]
        ids = np.concatenate([*flat, ids, np.frombuffer(b"".join(made), dtype="<u4")])
        order = np.concatenate([*parts, words, others])
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        new = np.sort(order[len(parts[0]) :])
        self.known.add(hashes[new], told[new], begin[new], lengths[new], ids)
        return begin, lengths, ids

    def block(self, block: Block, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; each text's end in `end_id`, if given."""
        data, offsets, raw = block.data, block.offsets, block.data.tobytes()
        texts = len(offsets) - 1
        kinds = _KINDS[data]
        plain, spaced = self._odd(block, raw, kinds)
        blank, letter = kinds & _BLANK != 0, kinds & (_LETTER | _LEAD) != 0
        letter[1:] |= kinds[:-1] & _LEAD != 0
        times = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == _TIMES[0]) | (data[1:] == _TIMES[1])))
        letter[times] = letter[times + 1] = False
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (blank[1:] & ~blank[:-1]) | ((kinds[1:] & _MARK != 0) & letter[:-1])
        for k in np.flatnonzero(spaced).tolist():  # only behind what is surely no white space
            cut[offsets[k] + 1 : offsets[k + 1]] &= kinds[offsets[k] : offsets[k + 1] - 1] & _INK != 0
        for k in np.flatnonzero(plain).tolist():
            cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1] if len(data) else starts[:0], starts[1:]
        size = ends - starts
        others = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(~letter, dtype=np.int32)])
        others = others[ends] - others[starts]  # bytes of a piece that are of no letter
        word = (others == (data[starts] == ord(" "))) & (others < size)
        del kinds, blank, letter, cut, others
        of_text = np.searchsorted(offsets, starts, side="right") - 1

        # Up to 24 bytes are three numbers: the first eight, the next eight, the last eight.
        few = (size <= 24) & ~plain[of_text]
        short = np.flatnonzero(few)
        padded = np.concatenate([data, np.zeros(32, dtype=np.uint8)])
        eight = np.ndarray(len(data) + 24, "<u8", padded.data, strides=(1,))
        at, z = starts[short], size[short]
        one = eight[at] & _FIRST[np.minimum(z, 8)]
        two = np.where(z > 16, eight[at + 8], np.uint64(0))
        last = np.where(z > 8, eight[np.maximum(at + z - 8, 0)], np.uint64(0))
        key = mix(one + mix(last + mix(two + z.astype(np.uint64))))
        hashes, of = np.unique(key, return_inverse=True)
        first = np.zeros(len(hashes), dtype=np.int64)
        first[of] = np.arange(len(of))  # any of those with the hash
        told = np.stack([z[first].astype(np.uint64), one[first], two[first], last[first]], axis=1)
        same = (z == z[first][of]) & (one == one[first][of]) & (two == two[first][of]) & (last == last[first][of])
        del eight, one, two, last, key
        begin, lengths, ids = self._ids_of(hashes, told, at[first], word[short[first]], padded)
        del padded, hashes, told, first, at, z

        piece = np.zeros(len(starts), dtype=np.int64)
        piece[short] = of
        few[short[~same]] = False  # other bytes under an equal hash
        alone = np.flatnonzero(~few)
        piece[alone] = len(lengths) + np.arange(len(alone))
        more = [self._alone(raw[starts[k] : ends[k]], bool(plain[of_text[k]])) for k in alone.tolist()]
        held = np.searchsorted(starts, offsets)
        if end_id is not None:
            piece = np.insert(piece, held[1:], len(lengths) + len(more))
            held = held + np.arange(texts + 1)
            more.append(int(end_id).to_bytes(4, "little"))
        added = np.array([len(x) // 4 for x in more], dtype=np.int64)
        begin = np.concatenate([begin, len(ids) + np.cumsum(added) - added])
        lengths = np.concatenate([lengths, added])
        flat = np.concatenate([ids, np.frombuffer(b"".join(more), dtype="<u4")])
        counts = lengths[piece]
        begin, bounds = begin[piece], np.concatenate([[0], np.cumsum(counts)])
        del starts, ends, size, of_text, few, short, of, same, piece
        return np.diff(bounds[held]), flat[_places(begin, counts)]

    def __call__(self, text: str) -> list[int]:
        return [i for b in blocks(pa.array([text], pa.string())) for i in self.block(b)[1].tolist()]


@cache
def shared_encoder(path: str) -> TextEncoder:
    """One for all tasks that a Python worker runs, one after the other."""
    return TextEncoder(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text and write the ids in ascending order of the documents' ids.

    Null ids come first; rows with one id are in the order of their texts' hashes, so the order depends on the
    rows alone. Null texts are empty; `end_id` closes every document (None: no end). Columns to `carry` (none if
    None) are kept in the struct `row`, whatever their names. An empty table gives files without rows.

    One shuffle deals the documents out by ranges of ids, so a file holds consecutive documents, and an id held
    by many rows is spread by its texts. Rows that are equal in both do lie in one file, and a batch of them is
    encoded once.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))
    given = docs.select(docs[quoted(id_col)].alias("key"), text.alias("text"), row_of(docs, carry or []).alias("row"))
    given = given if carry else given.drop("row")
    dealt = given.withColumn("print", F.xxhash64("text")).repartitionByRange("key", "print").sortWithinPartitions("key", "print")
    fields = [
        dealt.schema["key"],
        T.StructField("part", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        *([dealt.schema["row"]] if carry else []),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        encoder = shared_encoder(vocabulary)
        for whole in batches:
            for block in blocks(whole["text"], CHUNK_BYTES):
                batch = whole.slice(block.first, block.last - block.first)
                counts, ids = encoder.block(block, end_id)
                ends = total + np.cumsum(counts)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                columns = [
                    batch["key"],
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    pa.array(ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
                ]
                total = int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns + ([batch["row"]] if carry else []), [f.name for f in fields])

    made = dealt.mapInArrow(run, T.StructType(fields))
    writer = made.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.page.row.count.limit", page_rows).option("parquet.dictionary.page.size", 4 << 20)
    for column in ("key", "part", "first", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{path}/rows")
    # One row per file, and only the two small columns of each are read.
    rows = spark.read.schema(made.schema).parquet(f"{path}/rows")
    parts = sorted(map(tuple, rows.groupBy("part").agg(F.sum("n_tokens")).collect()))
    bases = accumulate((n for _, n in parts), initial=0)
    table = [(part, base, n) for (part, n), base in zip(parts, bases)]
    spark.createDataFrame(table, "part int, base long, n_tokens long").coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, ids: bool = True, low=None, high=None) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids and row (if they were written) of the documents.

    Without `ids` only the small columns are read. `low` and `high` bound the keys, both ends included: row
    groups and pages outside are skipped by their statistics.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if low is not None:
        rows = rows.where(F.col("key") >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col("key") <= F.lit(high))
    return _placed(spark, path, rows, ids)


def read_token_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The same for the documents that hold places `first` up to, not including, `last` of the token stream.

    The files that hold them are found in `parts`, and within the last of these the pages by `first`.
    """
    if first >= last:
        return read_token_files(spark, path).limit(0)
    held = spark.read.parquet(f"{path}/parts").where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    ends = held.agg(F.min(F.struct("part", "base")).alias("low"), F.max(F.struct("part", "base")).alias("high")).first()
    if ends["low"] is None:
        return read_token_files(spark, path).limit(0)
    (low, below), (high, above) = ends["low"], ends["high"]
    # Files between the two are wanted whole; bounds on plain columns reach the files' statistics.
    wanted = (F.col("part") >= low) & (F.col("part") <= high)
    wanted &= (F.col("part") < high) | (F.col("first") < last - above)
    wanted &= (F.col("part") > low) | (F.col("first") + F.col("n_tokens") > first - below)
    rows = spark.read.parquet(f"{path}/rows")
    return _placed(spark, path, rows.where(wanted), True)


def _placed(spark: SparkSession, path: str, rows: DataFrame, ids: bool) -> DataFrame:
    parts = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "base"))
    columns = ["key", (F.col("base") + F.col("first")).alias("start"), "n_tokens"]
    columns += [c for c in ("ids", "row") if c in rows.columns and (ids or c == "row")]
    return rows.join(parts, "part").select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """key, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), from the ids that were read."""
    import zlib

    fields = T.StructType([*(tokens.schema[c] for c in ("key", "start")), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch["key"], batch["start"], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, fields.names)

    return tokens.select("key", "start", "ids").mapInArrow(run, fields)
