"""Connected components of links between keys, as DataFrame steps; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import stored


def components(links: DataFrame) -> DataFrame:
    """(key, label) of every end of a link (columns a, b); label is the least key that it is linked to.

    Each round every label joins its least neighbour, follows that one's own choice, and links become links
    between the new labels, until none is left. Stars, which near-copies mostly form, take two rounds.
    Self links and repeated links do no harm; no links give no rows. Each round is stored.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    labels = stored(both.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("label", F.col("key")), "labels")
    edges = stored(both, "edges")
    while not edges.isEmpty():
        ways = edges.union(edges.select("b", "a"))
        choice = ways.groupBy(F.col("a").alias("own")).agg(F.min("b").alias("next"))
        choice = stored(choice.select("own", F.least("own", "next").alias("next")), "choice")
        # A choice is never above the label itself, so following it again keeps within the component.
        further = choice.select(F.col("own").alias("next"), F.col("next").alias("last"))
        jump = choice.join(further, "next").select("own", "last")
        labels = stored(
            labels.join(jump, labels["label"] == jump["own"], "left").select(
                "key", F.coalesce("last", "label").alias("label")
            ),
            "labels",
        )
        left = jump.select(F.col("own").alias("a"), F.col("last").alias("x"))
        right = jump.select(F.col("own").alias("b"), F.col("last").alias("y"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "edges",
        )
    return labels
