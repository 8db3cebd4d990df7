"""Drop lines that many documents share; the document with the largest id that holds one keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import quoted, row_of

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is much faster than translate(); they agree where every character is one byte.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _LOWER)
    )


def _hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """`row`, n_lines, n_dropped and kept_text of every document.

    A line counts by its key (`line_key`) if that has `min_chars` code points. A key in `min_docs` documents
    or more loses its lines everywhere but in the largest id that holds it, which keeps all of them. Keys
    are compared by a 128-bit hash.

    Null or empty text is one empty line. Rows with one id are one document when counting, and each keeps
    or loses its own lines. A null id is no document: such a row counts for nothing and never keeps a
    common line. No rows give no rows.

    Lines are reduced to (hash, id) before the first shuffle and counted in two steps, so a line in a third
    of all documents sends one row per task. The join of the common keys back to their lines is a plain
    sort-merge join, in which adaptive execution splits a hot key. Texts are shuffled once, by id.
    """
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))
    held = docs.select(docs[quoted(id_col)].alias("id"), F.explode(F.split(text, "\n")).alias("line")).select(
        "id", line_key(F.col("line")).alias("key")
    )
    one, two = _hash(F.col("key"))
    held = held.where(F.char_length("key") >= min_chars).select("id", one.alias("one"), two.alias("two")).distinct()
    common = (
        held.groupBy("one", "two")
        .agg(F.count("id").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("one", "two", "keeper")
    )
    dropped = (
        held.join(common, ["one", "two"])
        .where(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
        .groupBy("id")
        .agg(F.collect_list(F.struct("one", "two")).alias("gone"))
    )
    given = docs.select(row_of(docs, carry).alias("row"), docs[quoted(id_col)].alias("given"), text.alias("body"))

    def stays(line: Column) -> Column:
        one, two = _hash(line_key(line))
        return ~F.array_contains("gone", F.struct(one.alias("one"), two.alias("two")))

    lines = F.split("body", "\n")
    joined = given.join(dropped, given["given"].eqNullSafe(dropped["id"]), "left")
    left = F.when(F.col("gone").isNotNull(), F.filter(lines, stays))
    return joined.select("row", "body", F.size(lines).cast("long").alias("n_lines"), left.alias("left")).select(
        "row",
        "n_lines",
        F.when(F.col("left").isNull(), F.lit(0).cast("long"))
        .otherwise(F.col("n_lines") - F.size("left"))
        .alias("n_dropped"),
        F.when(F.col("left").isNull(), F.col("body")).otherwise(F.array_join("left", "\n")).alias("kept_text"),
    )
