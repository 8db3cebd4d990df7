"""Hashed sparse features of texts, and bounded samples to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import LOWER, Block


def byte_grams(block: Block, size: int, bits: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed gram) of the runs of `size` bytes inside each text of a block."""
    data = (LOWER[block.data] if fold else block.data).astype(np.uint32)
    places = len(data) - size + 1
    if places <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(places, dtype=np.uint32)
    for k in range(size):
        value = value * np.uint32(0x01000193) + data[k : k + places]
    value *= np.uint32(0x9E3779B1)
    lengths = np.diff(block.offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[:places]
    inside = np.arange(places) + size <= block.offsets[1:][text]
    return text[inside], (value[inside] >> np.uint32(32 - bits)).astype(np.int64)


def counted(text: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature), sorted, with their counts."""
    both, counts = np.unique((text.astype(np.int64) << bits) | feature, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), counts


def normalised(text: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """Values scaled so that each text's are of length 1."""
    norm = np.sqrt(np.bincount(text, weights=values * values, minlength=texts))
    return values / np.maximum(norm[text], 1e-12)


def sample_hash(key: Column) -> Column:
    """A number below 2**30 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))


def sample_limit(total: int, bound: int) -> int:
    """The limit below which the hashes of about `bound` of `total` rows lie (all, if there are fewer)."""
    return 1 << 30 if total <= bound else int(bound / total * (1 << 30))


def sampled(rows: DataFrame, key: Column, total: int, bound: int) -> DataFrame:
    """About `bound` of `total` rows (all, if there are fewer), chosen by a hash of the key.

    The choice does not depend on order or partitions; the number varies by a few times its square root.
    """
    return rows if total <= bound else rows.where(sample_hash(key) < sample_limit(total, bound))


def fit(
    gradient, start: np.ndarray, steps: int = 200, rate: float = 0.5
) -> np.ndarray:
    """Minimise by Adam with a falling rate; `gradient` maps weights to their gradient."""
    at = start.astype(float).copy()
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        g = gradient(at)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        speed = rate * (1 - step / (steps + 1))
        at -= speed * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return at
