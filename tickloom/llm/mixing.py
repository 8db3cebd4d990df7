"""Mix sources to target weights by Poisson replication of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import partitions, quoted, row_of

#: The table of distribution values is broadcast if it is at most this large.
BROADCAST_BYTES = 8 << 20
_BITS = 52


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """`row`, copy (1, 2, ...) and shuffle_key of every copy of every document, in a global random order.

    A source's share of the result is its weight over the sum of weights: from `weights` (a source that is
    missing there has weight 0), else its number of rows to `power`. The mean repetition rate of its
    documents is share * total / rows, with `total` rows wanted (as many as given, if None). A document's
    number of copies is the Poisson distribution of that mean, inverted at a number that the seed and the
    document's id set; so it does not depend on order, partitions or other documents.

    Null is a source of its own (weight key None). Rows with one id are repeated alike. A null id is
    replaced by the text. Null text stays null. No rows give no rows. The rows are sorted by shuffle_key
    over all partitions, ties by copy.

    Sources are counted with partial sums. The distribution's values are joined by broadcast if their
    measured size allows, else by a shuffle in which adaptive execution splits a hot source. Texts are
    shuffled once, to the partition that their uniform key names, so no sampling pass is needed.
    """
    spark = docs.sparkSession
    source = docs[quoted(source_col)].cast("string")
    counted = docs.select(source.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            same = F.col("source").isNull() if name is None else F.col("source") == name
            weight = F.when(same, F.lit(float(value))).otherwise(weight)
    counted = counted.withColumn("weight", weight)
    whole = counted.agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows"), F.count("*").alias("n")).first()
    wanted = float(total if total is not None else whole["rows"] or 0)
    rate = F.col("weight") / F.lit(float(whole["weight"] or 1.0)) * F.lit(wanted) / F.col("rows")
    rates = counted.select("source", rate.alias("rate"))
    values = distribution(rates)
    size = rates.agg(F.sum(_reach(F.col("rate")) * 8 + 64).alias("bytes")).first()["bytes"] or 0
    if size <= BROADCAST_BYTES:
        values = F.broadcast(values)

    ident = F.coalesce(docs[quoted(id_col)].cast("string"), F.concat(F.lit("text "), docs[quoted(text_col)]), F.lit(""))
    given = docs.select(row_of(docs, carry).alias("row"), ident.alias("ident"), source.alias("given"))
    copies = F.size(F.filter("at_most", lambda p: p <= F.col("u"))).cast("long")
    parts = partitions(spark)
    return (
        given.join(values, F.col("given").eqNullSafe(F.col("source")))
        .select("row", "ident", "at_most", unit(F.lit(seed), "ident").alias("u"))
        .select("row", "ident", copies.alias("copies"))
        .where("copies > 0")
        .select("row", "ident", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select("row", "copy", F.md5(F.concat_ws(":", F.lit(seed), "ident", F.col("copy").cast("string"))).alias("shuffle_key"))
        .repartitionById(parts, _slot(F.col("shuffle_key"), parts))
        .sortWithinPartitions("shuffle_key", "copy")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents' own columns with copy and shuffle_key, which take the place of given columns of these names."""
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    return mix_sources(docs, carry=kept, **options).select("row.*", "copy", "shuffle_key")


def _slot(key: Column, parts: int) -> Column:
    share = F.conv(F.substring(key, 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)
    return F.floor(share * parts).cast("int")


def _reach(rate: Column) -> Column:
    """A number of copies that the distribution exceeds with a chance below 2**-53."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30)


def distribution(rates: DataFrame) -> DataFrame:
    """(source, at_most): the chances of at most 0, 1, 2, ... copies under each source's rate, ascending.

    Chances are summed from logarithms, so a large rate does not underflow.
    """
    steps = rates.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), _reach(F.col("rate")))).alias("k"))
    logs = F.expr("sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)")
    chance = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("logs"))).otherwise(
        F.when(F.col("k") == 0, 1.0).otherwise(0.0)
    )
    chances = steps.withColumn("logs", logs).select("source", "k", chance.alias("p"))
    summed = chances.select("source", F.expr("sum(p) OVER (PARTITION BY source ORDER BY k)").alias("at_most"))
    return summed.groupBy("source").agg(F.sort_array(F.collect_list("at_most")).alias("at_most"))
