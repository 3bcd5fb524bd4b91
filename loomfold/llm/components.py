"""Connected components by label propagation with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, tag: str = "components") -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``edges`` (a, b), as a table of ``scratch`` named ``tag``.

    A round takes the smallest label among the neighbours and then the label of that label, so chains shrink by halves.
    Minima are combined before they are exchanged, so a node with very many links is no burden to one task. A round's table
    goes when the next one is written. Links with a null end and links of an id with itself count for nothing.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    labels, number = scratch.table(first, f"{tag}-0"), 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "m").alias("next"))
        # the label of the label; labels are ids, so each has one
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = scratch.table(hooked.join(jump, "next").select("id", F.col("component").alias("was"), F.least("next", "beyond").alias("component")), f"{tag}-{number + 1}")
        del near, hooked, jump
        scratch.free(f"{tag}-{number}")
        labels, number = moved.select("id", "component"), number + 1
        if moved.where("was <> component").limit(1).count() == 0:
            scratch.free(f"{tag}-edges")
            return labels
