"""Connected components of a link table, as Spark joins.

Alternating star contraction: every round first hooks the larger neighbours
of a node to its smallest neighbour, then every node to the smallest of its
smaller neighbours. The number of rounds grows with the logarithm of the
links. Each round is written to the shared folder; nothing but two numbers
per round reaches the driver. A node with very many links costs one partial
minimum per task; its links are joined by a join that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = down.join(least, F.col("a") == F.col("n"))
    hooked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hooked.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link, and the smallest node reachable.

    Links with a null end, or from a node to itself, are no links."""
    edges = settle(links.select(F.col(a).alias("a"), F.col(b).alias("b"))
                   .where("a is not null and b is not null and a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        edges = settle(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
