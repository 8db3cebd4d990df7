"""Bottom-k sketches of word shingles: small strings that tell resemblance, containment and distinct counts.

A fingerprint holds the k smallest 48-bit hashes of a text's distinct five-word shingles, in order, as base64
of six bytes each. With fewer than k shingles it holds all of them and every estimate is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import blocks, shingles, words
from tickloom.llm.features import sampled
from tickloom.llm.frames import map_texts, partitions, quoted

K = 128
SIZE = 5
#: Rows per range, about, whose ids set the ranges' ends.
SAMPLED = 200
_SPAN = float(1 << 48)


def encode(values: np.ndarray) -> str:
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode("ascii")


def decode(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def sketches(texts: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, in order."""
    out: list[np.ndarray] = []
    for block in blocks(texts):
        found = shingles(words(block), size)
        values = found.hashes >> np.uint64(16)
        text = np.repeat(np.arange(len(found.counts)), found.counts)
        # Only hashes below a bound set by the text's size can be among its smallest; the rest is not sorted.
        many = found.counts[text]
        bound = np.minimum(1.0, (2.0 * k + 64) / np.maximum(many, 1)) * _SPAN
        below = values < bound
        enough = np.bincount(text[below], minlength=len(found.counts)) >= 1.5 * k
        below |= ~enough[text]
        text, values = text[below], values[below]
        order = np.lexsort((values, text))
        text, values = text[order], values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        text, values = text[new], values[new]
        bounds = np.searchsorted(text, np.arange(len(found.counts) + 1))
        for i in range(len(found.counts)):
            got = values[bounds[i] : bounds[i + 1]]
            if enough[i] and len(got) < k:  # many copies among the small ones: sort the whole text
                got = np.unique(found.hashes[found.bounds[i] : found.bounds[i + 1]] >> np.uint64(16))
            out.append(got[:k])
    return out


def union(one: np.ndarray, two: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(one, two)[:k]


def resemblance(one: np.ndarray, two: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two texts without words are alike, one without is like no other."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    both = np.concatenate([one, two])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    # The k smallest of the union: each value that occurs twice stands for one.
    total = min(k, len(both) - len(twice))
    distinct_before = twice - np.arange(len(twice))
    return float(np.count_nonzero(distinct_before < total)) / total


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / _SPAN)


def containment(one: np.ndarray, two: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second holds."""
    if not len(one):
        return 1.0
    shared = resemblance(one, two, k) * distinct(union(one, two, k), k)
    return min(1.0, shared / distinct(one, k))


def fingerprint_documents(
    docs: DataFrame, k: int = K, size: int = SIZE, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """`row`, fingerprint and n_shingles (estimated) of every text; null is empty, without words the
    fingerprint is empty. No shuffle."""

    def function(texts: pa.Array) -> dict[str, pa.Array]:
        made = sketches(texts, k, size)
        return {
            "fingerprint": pa.array([encode(x) for x in made], pa.string()),
            "n_shingles": pa.array([distinct(x, k) for x in made], pa.float64()),
        }

    return map_texts(docs, function, "fingerprint string, n_shingles double", text_col, carry)


def merge_parts(parts: DataFrame, key: str, k: int = K, salts: int = 32) -> DataFrame:
    """(key, fingerprint) of the union of each key's fingerprints, from columns `key` and `fingerprint`.

    Merged within Arrow batches, then by key and salt, then by key, so that no task holds more than a salt's
    share of a hot key. Null fingerprints are empty ones; null is a key like any other.
    """
    # Names of our own, so that the key may be called anything.
    parts = parts.select(parts[quoted(key)].alias("own"), parts["fingerprint"].cast("string").alias("sketch"))
    schema = parts.schema

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        names = list(frame.columns[:2])
        rows = []
        for value, group in frame.groupby(names[0], dropna=False, sort=False):
            sketch = np.unique(np.concatenate([decode(x) for x in group[names[1]]]))[:k]
            rows.append((None if pd.isna(value) else value, encode(sketch)))
        return pd.DataFrame(rows, columns=names)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield merged(frame)

    step = parts.mapInPandas(partial, schema)
    salted = step.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
    step = salted.groupBy("own", "salt").applyInPandas(merged, schema)
    out = step.groupBy("own").applyInPandas(merged, schema)
    return out.select(F.col("own").alias(key), F.col("sketch").alias("fingerprint"))


def _tops(given: DataFrame, parts: int) -> np.ndarray:
    """The largest key of each of about `parts` ranges with about as many rows each.

    They are quantiles of the keys of about `SAMPLED` rows per range, chosen by a hash of the key and counted
    before they come to the driver, so what any task or the driver gets does not grow with the rows.
    """
    total, largest = given.agg(F.count("*"), F.max("key")).first()
    if not total:
        return np.zeros(1, dtype=np.int64)
    bound = SAMPLED * parts
    found = sampled(given.select("key"), F.col("key"), total, bound).groupBy("key").agg(F.count("*").alias("n")).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    sums = np.cumsum(n[order])
    shares = np.arange(1, parts) / parts * (sums[-1] if len(sums) else 0)
    at = np.searchsorted(sums, shares) if len(sums) else np.zeros(0, np.int64)
    return np.unique(np.append(keys[order][at], largest).astype(np.int64))


def fingerprint_edits(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last floor(n_chars / 2) code points are
    replaced by the first as many (or all) of the next document, by descending doc_id, the first after the last.

    Reads doc_id and text. A null id comes after all others; rows with one id are ordered by their text; a
    single row is its own next. Null text is empty. No rows give no rows.

    Texts are shuffled once, into ranges of ids whose ends a bounded sample of the ids sets; as they only place the rows,
    the result does not depend on it. The largest id of a range
    also goes to the range above it, where it follows the smallest; so a range needs nothing from its
    neighbours and rows are never numbered globally.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    tops = _tops(given, partitions(spark))
    ranges = len(tops)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        """The range of a key, negative in a second entry if the key is the largest of that range."""
        at = np.searchsorted(tops, keys.to_numpy(), side="left")
        top = tops[np.minimum(at, ranges - 1)] == keys.to_numpy()
        return pd.Series([[a, -1 - (a + 1) % ranges] if t else [a] for a, t in zip(at, top)])

    ordered = (
        given.withColumn("place", F.explode(places("key")))
        .withColumn("border", F.col("place") < 0)
        .withColumn("place", F.when(F.col("border"), -1 - F.col("place")).otherwise(F.col("place")))
        .repartitionById(ranges, F.col("place"))
        .sortWithinPartitions("border", F.desc("key"), "text")
        .select("doc_id", "text", "border")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            texts = batch.column(1)
            items = list(
                zip(batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2).to_pylist(), sketches(texts, k, size))
            )
            if last is not None:
                items.insert(0, last)
            last = items[-1]
            pairs = [(a, b) for a, b in zip(items, items[1:]) if not a[2]]
            if pairs:
                yield edits(pairs)

    def edits(pairs: list) -> pa.RecordBatch:
        changed = []
        for (_, text, _, _), (_, following, _, _) in pairs:
            half = len(text) // 2
            changed.append(text[: len(text) - half] + following[:half])
        made = sketches(pa.array(changed, pa.large_string()), k, size)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in changed], pa.string()),
                pa.array([encode(a[3]) for a, _ in pairs], pa.string()),
                pa.array([encode(x) for x in made], pa.string()),
                pa.array([resemblance(a[3], x, k) for (a, _), x in zip(pairs, made)], pa.float64()),
                pa.array([resemblance(a[3], b[3], k) for a, b in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
