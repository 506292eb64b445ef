"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, scratch


def _toward_smallest(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest of u and everything that u links to."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return attach(links, least, ["u"], "n", links.count()).withColumn("m", F.least("u", "m"))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that can be reached.

    Each round makes every neighbour larger than a node point to the smallest node around it, then every node and
    its smaller neighbours to the smallest of them. Stars of a few nodes with many links join by broadcast of
    those nodes' minima. Tables are cut in each round; nothing but a count and a checksum reaches the driver.
    Null ends and loops are left out. The number of rounds grows with the logarithm of the longest path; past
    `most_rounds` it raises, rather than return components that are not whole.
    """
    with scratch(links.sparkSession):
        edges = cut(
            links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        )
        seen = None
        for _ in range(most_rounds):
            both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
            large = _toward_smallest(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = cut(large.distinct())
            small = _toward_smallest(large)
            edges = cut(
                small.select("u", F.col("m").alias("v"))
                .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                .where("u <> v")
                .distinct()
            )
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError("components did not settle")
        roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
        return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), outlive=True)
