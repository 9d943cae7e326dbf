"""Connected components by alternating star contraction, with every round's links written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with v < u. large: each node passes its larger neighbours its least; else each node passes its
    smaller neighbours, and itself, its least. Sums per node are combined map-side and go back by a join."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct()
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(out.select("u", F.col("m").alias("v"))).where("v < u").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each node of links (a, b) that is not the least of its component, with that least node."""
    now = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links-0")
    mark = None
    for n in range(1, 200):
        now = scratch.save(_star(_star(now, True), False), f"links-{n}")
        scratch.drop(f"links-{n - 1}")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if new == mark:
            return now
        mark = new
    raise RuntimeError("links did not settle")
