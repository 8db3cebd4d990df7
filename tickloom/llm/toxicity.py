"""Severity of toxic language by cumulative-link ordinal regression on hashed words.

P(severity <= k) = sigmoid(threshold[k] - w . x): one weight vector for all grades, and ordered thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import Block, blocks, words
from tickloom.llm.features import counted, fit, sampled
from tickloom.llm.frames import map_texts, quoted

_BITS = 18
SAMPLE = 10_000
#: Grades of severity: 0 is clean; a toxic document's grade grows with its number of telling words.
GRADES = 4
#: Features of fewer sampled documents than this are left out; weights are drawn to 0 by this much.
HELD = 3
PENALTY = 1e-3
#: Numbers of telling words from which grades 2 and 3 begin.
_STEPS = (3, 6)
#: A word tells if it is in this many toxic documents of the sample, and this many times as often as in clean ones.
_LEAST, _TIMES = 4, 20.0


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the hashed words of a block's texts."""
    found = words(block)
    return counted(found.text_of_word(), (found.hashes >> np.uint64(64 - _BITS)).astype(np.int64), _BITS)


def _value(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def grades(of: np.ndarray, feature: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity of labelled documents: 0 if clean, else 1 to 3 by how many telling words they hold."""
    many = np.bincount(feature, weights=toxic[of], minlength=1 << _BITS)
    few = np.bincount(feature, weights=~toxic[of], minlength=1 << _BITS)
    ratio = ((many + 0.5) / (toxic.sum() + 1)) / ((few + 0.5) / ((~toxic).sum() + 1))
    telling = (many >= _LEAST) & (ratio >= _TIMES)
    hits = np.bincount(of, weights=counts * telling[feature], minlength=len(toxic))
    return np.where(toxic, 1 + sum((hits >= step).astype(int) for step in _STEPS), 0)


def probabilities(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(severity = k), a row for each z."""
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - z[:, None], -500, 500)))
    edges = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
    return np.maximum(np.diff(edges, axis=1), 1e-12)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
) -> dict:
    """Weights and thresholds from about `sample` labelled documents, chosen by a hash of their id.

    Labels that are null, or whose id is null or unknown, are left out. An id that is labelled twice is toxic if
    any label says so. Features in fewer than three documents of the sample are left out.
    """
    marked = (
        labels.select(labels[quoted(id_col)].alias("id"), labels[quoted(toxic_col)].cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = sampled(marked, F.col("id").cast("string"), marked.count(), sample)
    given = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text"))
    # The sample is bounded: at most some ten thousand ids and flags.
    given = given.join(F.broadcast(chosen), "id")

    def sparse(texts: pa.Array) -> dict[str, pa.Array]:
        lists, times = [], []
        for block in blocks(texts):
            text, feature, counts = features(block)
            bounds = np.searchsorted(text, np.arange(len(block.offsets)))
            lists += [feature[a:b] for a, b in zip(bounds, bounds[1:])]
            times += [counts[a:b] for a, b in zip(bounds, bounds[1:])]
        return {"feature": pa.array(lists, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.int32()))}

    rows = (
        map_texts(given, sparse, "feature array<int>, times array<int>", carry=["id", "toxic"])
        .select("row.id", "row.toxic", "feature", "times")
        .toPandas()
        .sort_values("id", kind="stable")
    )
    weights, thresholds = np.zeros(1 << _BITS), np.arange(GRADES - 1, dtype=float) + 3.0
    toxic = rows["toxic"].to_numpy(int) > 0
    if len(rows) and toxic.any() and not toxic.all():
        of = np.repeat(np.arange(len(rows)), [len(x) for x in rows["feature"]])
        feature = np.concatenate(list(rows["feature"])).astype(np.int64)
        counts = np.concatenate(list(rows["times"])).astype(float)
        grade = grades(of, feature, counts, toxic)
        held = np.bincount(feature, minlength=1 << _BITS)[feature] >= HELD
        of, feature, value = of[held], feature[held], _value(counts[held])
        used, column = np.unique(feature, return_inverse=True)

        def unpack(x: np.ndarray) -> np.ndarray:
            """Thresholds in order: the first, and steps that are positive by construction."""
            return np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))

        def gradient(x: np.ndarray) -> np.ndarray:
            w, free = x[: len(used)], x[len(used) :]
            cut = unpack(free)
            z = np.bincount(of, weights=w[column] * value, minlength=len(rows))
            edges = np.concatenate([[-np.inf], cut, [np.inf]])
            high = 1 / (1 + np.exp(-np.clip(edges[grade + 1] - z, -500, 500)))
            low = 1 / (1 + np.exp(-np.clip(edges[grade] - z, -500, 500)))
            chance = np.maximum(high - low, 1e-12)
            slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
            dz = (slope_high - slope_low) / len(rows)
            g = np.zeros_like(x)
            g[: len(used)] = np.bincount(column, weights=value * dz[of], minlength=len(used)) + PENALTY * w
            dcut = np.zeros(GRADES + 1)
            np.add.at(dcut, grade + 1, -slope_high / len(rows))
            np.add.at(dcut, grade, slope_low / len(rows))
            dcut = dcut[1:GRADES]
            tail = np.cumsum(dcut[::-1])[::-1]
            g[len(used) :] = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
            return g

        x = fit(gradient, np.concatenate([np.zeros(len(used)), [2.0], np.zeros(GRADES - 2)]), steps=150, rate=0.1)
        weights[used], thresholds = x[: len(used)], unpack(x[len(used) :])
    return {"weights": weights.astype(np.float32), "thresholds": thresholds}


def rate_toxicity(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row`, severity (expected grade, 0 to 3), grade (the likeliest) and toxic (P(grade > 0) of a half or more).

    Whole texts are rated, each row for itself, without a shuffle. Null and empty texts have no features, so
    they get what the thresholds say. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["thresholds"]))

    def function(texts: pa.Array) -> dict[str, pa.Array]:
        weights, thresholds = shared.value
        parts = [np.zeros((0, GRADES))]
        for block in blocks(texts):
            text, feature, counts = features(block)
            z = np.bincount(text, weights=weights[feature] * _value(counts), minlength=len(block.offsets) - 1)
            parts.append(probabilities(z, thresholds))
        chances = np.concatenate(parts)
        return {
            "severity": pa.array(chances @ np.arange(GRADES) / chances.sum(axis=1), pa.float64()),
            "grade": pa.array(chances.argmax(axis=1) if len(chances) else [], pa.int64()),
            "toxic": pa.array(chances[:, 0] < 0.5, pa.bool_()),
        }

    return map_texts(docs, function, "severity double, grade long, toxic boolean", text_col, carry)
