"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v), u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (u, v) between comparable ids to rows (u, root); every node but a component's least has a row.

    Each round is written to the shared folder; rounds end when a round changes nothing, after about the logarithm
    of the longest path. Loops and repeated edges have no effect; no edges give no rows.
    """
    one = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = written(one, name)
    sign = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == sign or not seen[0]:
            return now.select("u", F.col("v").alias("root"))
        sign = seen
        now = written(_stars(now), name)
