"""A quality classifier without labels: heuristic labellers vote, expectation-maximisation estimates how far each
can be trusted, and the votes' posterior trains a linear scorer on hashed features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import Block, blocks, runs, shingles, words
from tickloom.llm.features import byte_grams, counted, fit, normalised, sampled
from tickloom.llm.frames import map_texts, quoted

#: Common words of four languages.
COMMON_WORDS = (
    "the of and to in is that for it as with was by on at are this be from or "
    "der die das und ist nicht ein eine zu den von mit sich auf für "
    "le la les de des et un une est dans pour que qui sur "
    "el los las del y en se que por con una su para"
).split()

LABELLERS = ("symbols", "capitals", "digits", "repetition", "variety", "layout", "common", "length", "tails", "runs", "echo")
_BITS = 16
SAMPLE = 6000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Signs that prose has few of.
_SIGN = np.zeros(256, bool)
_SIGN[np.frombuffer(b"#$%&*|<>=+@\\^_`~{}[]/!", dtype=np.uint8)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hash_of_words(texts: list[str]) -> np.ndarray:
    column = pa.array([" ".join(texts)])
    return np.unique(words(next(blocks(column))).hashes)


_COMMON = _hash_of_words(COMMON_WORDS)


def vote(block: Block) -> np.ndarray:
    """Votes (texts x labellers): 1 good, 0 bad, 2 none.

    symbols, capitals, digits: their share of the text. repetition: five-word shingles that occur before in
    the text. variety: distinct words among all. layout: blank space among all characters. common: share of
    common words. length: of the words. tails: pre-tokens that end in a sign. runs: signs that stand alone or
    repeat the two before. A text too short for a measure gets no vote.
    """
    data, offsets = block.data, block.offsets
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1).astype(float)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])[offsets]
        return (sums[1:] - sums[:-1]).astype(float)

    found = words(block)
    counts = found.counts.astype(float)
    some = np.maximum(counts, 1)
    text = found.text_of_word()
    letters = total(_LETTER[data])
    grams = shingles(found)
    single = np.repeat(np.arange(n), grams.counts)
    distinct_grams = np.bincount(counted_text(single, grams.hashes), minlength=n)
    repeated = 1 - distinct_grams / np.maximum(grams.counts, 1)
    distinct = np.bincount(counted_text(text, found.hashes), minlength=n) / some
    common = np.bincount(text[np.isin(found.hashes, _COMMON)], minlength=n) / some
    mean = np.bincount(text, weights=found.ends - found.starts, minlength=n) / some

    of_word, _, times = counted(text, (found.hashes >> np.uint64(44)).astype(np.int64), 20)
    echo = np.zeros(n)
    np.maximum.at(echo, of_word, times)
    echo /= some

    ink = ~_SPACE[data]
    begins, ends = runs(ink, offsets)
    of_ink = np.searchsorted(offsets, begins, side="right") - 1
    tokens = np.bincount(of_ink, minlength=n)
    tails = np.bincount(of_ink[_SIGN[data[ends - 1]]], minlength=n) / np.maximum(tokens, 1)
    alone = np.bincount(of_ink[(ends - begins == 1) & _SIGN[data[begins]]], minlength=n) / np.maximum(tokens, 1)
    thrice = np.zeros(len(data), bool)
    thrice[2:] = _SIGN[data[2:]] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    thrice = total(thrice) / np.maximum(tokens, 1)

    votes = np.full((n, len(LABELLERS)), 2, dtype=np.int8)

    def judge(place: int, enough: np.ndarray, bad: np.ndarray, good: np.ndarray) -> None:
        votes[enough & good, place] = 1
        votes[enough & bad, place] = 0

    signs, spaces, digits = total(_SIGN[data]) / sizes, total(_SPACE[data]) / sizes, total(_DIGIT[data]) / sizes
    capitals = total(_UPPER[data]) / np.maximum(letters, 1)
    judge(0, sizes >= 20, signs > 0.04, signs < 0.02)
    judge(1, letters >= 30, capitals > 0.3, capitals < 0.15)
    judge(2, sizes >= 50, digits > 0.2, digits < 0.1)
    judge(3, grams.counts >= 30, repeated > 0.3, repeated < 0.15)
    judge(4, (counts >= 40) & (counts <= 4000), distinct < 0.2, distinct > 0.3)
    judge(5, sizes >= 100, (spaces < 0.05) | (spaces > 0.4), (spaces > 0.1) & (spaces < 0.25))
    judge(6, counts >= 20, common < 0.05, common > 0.12)
    judge(7, counts >= 20, (mean < 2) | (mean > 14), (mean > 3) & (mean < 10))
    judge(8, tokens >= 10, tails > 0.25, tails < 0.1)
    judge(10, counts >= 30, echo > 0.15, echo < 0.12)
    judge(9, tokens >= 10, (alone > 0.15) | (thrice > 0.25), (alone < 0.05) & (thrice < 0.05))
    return votes


def counted_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, hash)."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new]


def pattern_numbers(votes: np.ndarray) -> np.ndarray:
    """A number for each row of votes, in base 3."""
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def patterns_of(numbers: np.ndarray, labellers: int) -> np.ndarray:
    return (numbers[:, None] // 3 ** np.arange(labellers, dtype=np.int64)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: posterior of good for each, P(vote | class) and P(good).

    Starts from the votes' majority. Votes are independent given the class; a labeller that abstains says nothing.
    """
    good, bad = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    # One vote against is what a labeller is for, so the start leans on it.
    posterior = (good + 0.5) / (good + 2.0 * bad + 1.0)
    shown = np.stack([(patterns == v) for v in range(2)], axis=2).astype(float)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weights[1].sum() + 1) / (weights.sum() + 2)
        table = np.einsum("cp,pjv->cjv", weights, shown) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        likelihood = np.einsum("pjv,cjv->cp", shown, np.log(table))
        odds = likelihood[1] - likelihood[0] + np.log(prior) - np.log1p(-prior)
        after = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(after - posterior).max(initial=0) < 1e-9
        posterior = after
        if done:
            break
    return posterior, table, prior


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): hashed runs of three bytes, damped counts, of length 1 for each text."""
    text, feature, counts = counted(*byte_grams(block, 3, _BITS), _BITS)
    return text, feature, normalised(text, np.sqrt(counts), len(block.offsets) - 1)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Labellers' estimates from the votes on all documents, and scorer weights from about `sample` of them.

    The patterns of votes are at most 3**11 rows whatever the input, so their counts come to the driver.
    """
    given = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text"))

    def votes(texts: pa.Array) -> dict[str, pa.Array]:
        found = [pattern_numbers(vote(b)) for b in blocks(texts)]
        return {"pattern": pa.array(np.concatenate(found) if found else [], pa.int64())}

    seen = map_texts(given.withColumn("one", F.lit(1)), votes, "pattern long", carry=["one"])
    table = seen.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    numbers, counts = table["pattern"].to_numpy(np.int64), table["n"].to_numpy(float)
    posterior, accuracy, prior = estimate(patterns_of(numbers, len(LABELLERS)), counts) if len(numbers) else (np.zeros(0), None, 0.5)

    def sparse(texts: pa.Array) -> dict[str, pa.Array]:
        pattern, lists, values = [], [], []
        for block in blocks(texts):
            text, feature, value = features(block)
            bounds = np.searchsorted(text, np.arange(len(block.offsets)))
            pattern.append(pattern_numbers(vote(block)))
            lists += [feature[a:b] for a, b in zip(bounds, bounds[1:])]
            values += [value[a:b].astype(np.float32) for a, b in zip(bounds, bounds[1:])]
        return {
            "pattern": pa.array(np.concatenate(pattern) if pattern else [], pa.int64()),
            "feature": pa.array(lists, pa.list_(pa.int32())),
            "value": pa.array(values, pa.list_(pa.float32())),
        }

    chosen = sampled(given, F.coalesce(F.col("id").cast("string"), F.col("text"), F.lit("")), int(counts.sum()), sample)
    rows = map_texts(chosen.withColumn("one", F.lit(1)), sparse, "pattern long, feature array<int>, value array<float>", carry=["one"]).select("pattern", "feature", "value").toPandas()
    target = dict(zip(numbers, posterior))
    weights = np.zeros((1 << _BITS) + 1)
    if len(rows):
        label = np.array([target[p] for p in rows["pattern"]])
        of = np.repeat(np.arange(len(rows)), [len(x) for x in rows["feature"]])
        feature = np.concatenate(list(rows["feature"])).astype(np.int64)
        value = np.concatenate(list(rows["value"])).astype(float)

        def gradient(w: np.ndarray) -> np.ndarray:
            z = np.bincount(of, weights=w[feature] * value, minlength=len(rows)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / len(rows)
            g = 1e-5 * w
            g[:-1] += np.bincount(feature, weights=value * error[of], minlength=1 << _BITS)
            g[-1] += error.sum()
            return g

        weights[-1] = np.log(prior / (1 - prior))
        weights = fit(gradient, weights, steps=120, rate=0.4)
    return {"target": target, "weights": weights.astype(np.float32), "accuracy": accuracy, "prior": prior}


def score(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row`, posterior (of the votes), score (of the scorer) and keep (score of at least a half).

    Null and empty texts have no features, so their score is the scorer's constant, and no votes. Every row is
    judged for itself. No rows give no rows. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model["target"], model["weights"]))

    def function(texts: pa.Array) -> dict[str, pa.Array]:
        target, weights = shared.value
        posterior, scores = [], []
        for block in blocks(texts):
            posterior += [target.get(p, 0.5) for p in pattern_numbers(vote(block)).tolist()]
            text, feature, value = features(block)
            z = np.bincount(text, weights=weights[feature] * value, minlength=len(block.offsets) - 1) + weights[-1]
            scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        scores = np.concatenate(scores) if scores else np.zeros(0)
        return {
            "posterior": pa.array(posterior, pa.float64()),
            "score": pa.array(scores, pa.float64()),
            "keep": pa.array(scores >= 0.5, pa.bool_()),
        }

    return map_texts(docs, function, "posterior double, score double, keep boolean", text_col, carry)


def classify_quality(
    docs: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """`score` with a model that is trained on the same documents."""
    return score(docs, train(docs, sample, id_col, text_col), text_col, carry)
