"""Language identification that fuses the text's likelihood with what its page declares and where it lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import IS_WORD, Block, blocks
from tickloom.llm.features import byte_grams, sample_hash, sample_limit
from tickloom.llm.frames import map_texts, quoted, stored

_BITS = 16
GRAM = 4
IS_LETTER = IS_WORD.copy()
IS_LETTER[48:58] = False
#: Rows of each label.
SAMPLE = 6000
#: Neighbouring grams overlap, so a text counts as at most this many independent ones.
EVIDENCE = 40.0
#: Rows that a level's own counts must outweigh in the level above.
SMOOTHING = 10.0
#: A text fits no language if its mean log-likelihood is this far below that of evenly spread grams.
MARGIN = 3.0
#: A text fits a language with few grams only if its mean is this far above that of grams the language has never shown.
RARE_MARGIN = 0.3
#: Added to the count of every gram.
UNSEEN = 0.2
BROADCAST_BYTES = 8 << 20
#: Languages whose likelihoods (2**18 bytes each) are sent and held together.
SLICE = 64
#: Likelihoods (texts x languages) that a worker holds at once.
HELD = 1 << 20


def document_evidence(docs: DataFrame) -> dict[str, Column]:
    """Evidence columns of `documents`: declared language, host (the source) and its family in place of a suffix."""
    return {
        "declared": F.lower(docs["lang"]),
        "host": docs["source"],
        "suffix": F.regexp_extract(docs["source"], "^[^0-9]*", 0),
    }


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    """Evidence columns of web pages: the html element's lang, the host, and the host's last label."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return {
        "declared": F.nullif(F.lower(declared), F.lit("")),
        "host": F.nullif(host, F.lit("")),
        "suffix": F.nullif(F.regexp_extract(host, r"([^.]*)$", 1), F.lit("")),
    }


def visible_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def train(rows: DataFrame, text: Column, label: Column, key: Column, sample: int = SAMPLE) -> dict:
    """Gram counts of each language from about `sample` rows of its label (all, if there are fewer).

    Rows are chosen by a hash of `key`, so those with equal keys are taken or left together; a language has one at
    least, whatever its share. So about labels x `sample` rows are read at any size of the input.
    Every label of a row with a gram is a language; the rows' labels need not be right for each row. The counts, at
    most languages x 2**16, stay in the shared folder; only the labels come to the driver.
    """
    given = rows.select(label.alias("label"), text.cast("string").alias("text"), key.cast("string").alias("key"))
    given = given.where(F.col("label").isNotNull() & (F.octet_length("text") >= GRAM))
    given = given.select("label", "text", sample_hash(F.coalesce("key", "text")).alias("hash"))
    sizes = given.groupBy("label").agg(F.count("*").alias("n"), F.min("hash").alias("least")).orderBy("label").collect()
    names = [r["label"] for r in sizes]
    limits = [(r["label"], k, max(sample_limit(r["n"], sample), r["least"] + 1)) for k, r in enumerate(sizes)]
    limits = rows.sparkSession.createDataFrame(limits, "label string, language int, limit long")
    small = sum(len(name) + 32 for name in names) <= BROADCAST_BYTES
    chosen = given.join(F.broadcast(limits) if small else limits, "label").where("hash < limit").select("language", "text")
    counted = chosen.mapInArrow(_counted, "language int, gram int, n long")
    counts = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    return {"names": names, "counts": stored(counts, "grams")}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of a task's texts, for at most `SLICE` languages at a time."""
    held: dict[int, np.ndarray] = {}

    def given_back() -> Iterator[pa.RecordBatch]:
        for language, counts in held.items():
            gram = np.flatnonzero(counts)
            arrays = [np.full(len(gram), language, np.int32), gram.astype(np.int32), counts[gram]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["language", "gram", "n"])
        held.clear()

    for batch in batches:
        languages = batch.column(0).to_numpy()
        for block in blocks(batch.column(1)):
            text, grams = byte_grams(block, GRAM, _BITS, fold=True)
            owner = languages[block.first : block.last][text]
            order = np.argsort(owner, kind="stable")
            owner, grams = owner[order], grams[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
            for start, end in zip(starts, np.r_[starts[1:], len(owner)].astype(int)):
                language = int(owner[start])
                if language not in held and len(held) == SLICE:
                    yield from given_back()
                counts = np.bincount(grams[start:end], minlength=1 << _BITS)
                held[language] = held[language] + counts if language in held else counts
    yield from given_back()


def slices(model: dict) -> list[Broadcast]:
    """Log-likelihoods of the grams (rows) under `SLICE` languages each; the driver holds one slice at a time."""
    counts, languages = model["counts"], len(model["names"])
    made = []
    for first in range(0, languages, SLICE):
        size = min(SLICE, languages - first)
        table = counts.where(F.col("language").between(first, first + size - 1)).toPandas()
        dense = np.full((1 << _BITS, size), UNSEEN)
        dense[table["gram"].to_numpy(np.int64), table["language"].to_numpy(np.int64) - first] += table["n"].to_numpy(float)
        made.append(counts.sparkSession.sparkContext.broadcast(np.log(dense / dense.sum(axis=0)).astype(np.float32)))
    return made


def floors(model: dict) -> list[float]:
    """The mean log-likelihood that a text of each language has to exceed.

    For a language with many grams that is `MARGIN` below evenly spread ones. One with few has so flat a model that
    any text would pass; there it is a little above the mean of a text of which it knows nothing.
    """
    totals = np.zeros(len(model["names"]))
    for r in model["counts"].groupBy("language").agg(F.sum("n").alias("n")).collect():
        totals[r["language"]] = r["n"]
    unknown = np.log(UNSEEN / (UNSEEN * (1 << _BITS) + totals))
    return np.maximum(-np.log(1 << _BITS) - MARGIN, unknown + RARE_MARGIN).tolist()


def likelihoods(block: Block, shared: list[Broadcast]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-likelihood of each text's grams under each language, and the number of grams.

    Of several slices a worker holds one at a time and reads them again for each block.
    """
    text, grams = byte_grams(block, GRAM, _BITS, fold=True)
    n = len(block.offsets) - 1
    counts = np.bincount(text, minlength=n)
    columns = []
    for part in shared:
        logs = part.value
        columns += [np.bincount(text, weights=logs[:, k][grams], minlength=n) for k in range(logs.shape[1])]
        if len(shared) > 1 and getattr(part, "_path", None):
            del part._value
    means = np.stack(columns, axis=1) if columns else np.zeros((n, 0))
    return means / np.maximum(counts, 1)[:, None], counts


def identify_languages(
    docs: DataFrame,
    evidence: dict[str, Column],
    model: dict,
    text: Column | None = None,
    carry: list[str] | None = None,
    least: float = 0.5,
) -> DataFrame:
    """`row`, language, posterior and accepted of every row.

    The posterior of a language is in proportion to its likelihood of the text (damped to `EVIDENCE` grams),
    times P(declared | language), times its prior on the host. Both are estimated over all rows from grouped
    counts of the language that the text alone suggests: the host's counts are smoothed by its suffix's, and
    these by all rows'. Text without grams leaves the decision to the other evidence.

    A row is rejected if the best posterior is below `least`, if its text has no letters, or if the text
    fits its language far worse than evenly spread grams would (see `floors`). Null evidence is a value like any other (null text is
    empty); a language that no row declares can't be found. Repeated rows count repeatedly and are judged alike.
    No rows give no rows; without languages every row is rejected.

    Texts are read twice and never shuffled; the likelihoods reach the tasks in slices of `SLICE` languages, of which
    a worker holds one. Work and the priors' tables grow with the number of languages. Hosts and declared values are joined by broadcast if their
    measured size allows, else by a shuffle in which adaptive execution splits a hot host.
    """
    names, shared = model["names"], slices(model)
    text = docs["text"] if text is None else text
    kept = docs.columns if carry is None else list(carry)
    given = docs.select(
        F.struct(*(docs[quoted(c)] for c in kept)).alias("given"),
        *(F.coalesce(evidence[c].cast("string"), F.lit("")).alias(c) for c in ("declared", "host", "suffix")),
        text.cast("string").alias("text"),
    )

    def function(texts: pa.Array) -> dict[str, pa.Array]:
        means, grams, letters = [np.zeros((0, len(names)))], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for block in blocks(texts):
            mean, count = likelihoods(block, shared)
            means.append(mean)
            grams.append(count)
            letters.append(np.diff(np.concatenate([[0], np.cumsum(IS_LETTER[block.data])])[block.offsets]) > 0)
        mean, count = np.concatenate(means), np.concatenate(grams)
        flat = pa.array(mean.ravel(), pa.float64())
        return {
            "mean": pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * mean.shape[1], pa.int32()), flat),
            "grams": pa.array(count, pa.int64()),
            "letters": pa.array(np.concatenate(letters), pa.bool_()),
            "best": pa.array(mean.argmax(axis=1) if names else np.zeros(len(mean), np.int32), pa.int32()),
        }

    fields, most = "mean array<double>, grams long, letters boolean, best int", max(1, HELD // max(len(names), 1))
    scored = map_texts(given, function, fields, carry=["given", "declared", "host", "suffix"], most=most)
    if not names:
        return scored.select(
            F.col("row.given").alias("row"),
            F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"),
        )

    def counted(texts: pa.Array) -> dict[str, pa.Array]:
        found = function(texts)
        return {"grams": found["grams"], "best": found["best"]}

    seen = map_texts(
        given.select("declared", "host", "suffix", "text"), counted, "grams long, best int",
        carry=["declared", "host", "suffix"], most=most,
    ).where("grams > 0")
    seen = seen.groupBy("row.declared", "row.host", "row.suffix", "best").agg(F.count("*").cast("double").alias("n"))
    seen = stored(seen, "evidence")

    total = np.zeros(len(names))
    for r in seen.groupBy("best").agg(F.sum("n").alias("n")).collect():
        total[r["best"]] = r["n"]
    share = (total + 1) / (total.sum() + len(names))

    def vector(values: np.ndarray) -> Column:
        return F.lit([float(x) for x in values])

    def level(by: list[str]) -> DataFrame:
        """Counts n of every language, in order, and their sum."""
        entries = seen.groupBy(*by, "best").agg(F.sum("n").alias("n")).groupBy(*by)
        entries = entries.agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("found"), F.sum("n").alias("sum"))
        every = F.sequence(F.lit(0), F.lit(len(names) - 1))
        return entries.withColumn("n", F.transform(every, lambda k: F.coalesce(F.col("found")[k], F.lit(0.0)))).drop("found")

    def smoothed(above: Column) -> Column:
        return F.zip_with("n", above, lambda c, a: (c + SMOOTHING * a) / (F.col("sum") + SMOOTHING))

    suffixes = level(["suffix"]).select("suffix", smoothed(vector(share)).alias("above"))
    hosts = level(["host", "suffix"]).join(suffixes, "suffix").select("host", "suffix", smoothed(F.col("above")).alias("prior"))
    spread = F.col("sum") / float(max(total.sum(), 1.0))
    says = F.zip_with("n", vector(total), lambda c, t: (c + SMOOTHING * spread) / (t + SMOOTHING))
    declared = level(["declared"]).select("declared", says.alias("says"))
    hosts, declared = _small(hosts, len(names)), _small(declared, len(names))

    least_mean = F.lit(floors(model))
    damped = F.least(F.col("grams").cast("double"), F.lit(EVIDENCE))
    joined = (
        scored.select("row.*", "mean", "grams", "letters")
        .join(hosts, ["host", "suffix"], "left")
        .join(declared, "declared", "left")
        .withColumn("prior", F.coalesce("prior", vector(share)))
        .withColumn("says", F.coalesce("says", vector(np.ones(len(names)))))
    )
    logs = F.zip_with("mean", "prior", lambda m, p: m * damped + F.ln(p))
    logs = F.zip_with(logs, "says", lambda x, s: x + F.ln(s))
    fused = joined.select("given", "mean", "grams", "letters", logs.alias("logs"))
    top = F.array_max("logs")
    at = F.array_position("logs", top).cast("int")
    fused = fused.select(
        F.col("given").alias("row"),
        F.element_at(F.lit(names), at).alias("language"),
        (1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))).alias("posterior"),
        (F.element_at("mean", at) > F.element_at(least_mean, at)).alias("fits"),
        "letters",
    )
    accepted = (F.col("posterior") >= least) & F.col("fits") & F.col("letters")
    return fused.select("row", "language", "posterior", accepted.alias("accepted"))


def _small(table: DataFrame, languages: int) -> DataFrame:
    """The table, to be broadcast if it is small; stored first, so that its size is known."""
    table = stored(table, "priors")
    return F.broadcast(table) if table.count() * (64 + 8 * languages) <= BROADCAST_BYTES else table
