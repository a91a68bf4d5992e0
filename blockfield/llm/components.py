"""Connected components of a link table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.llm.shared import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links already point from the larger id (a) to the smaller one (b)."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest id reachable.

    Each round joins and groups links on both ends and writes them to the shared folder; the number of rounds grows
    with the logarithm of the longest path.  Self links, repeated links and links with a null end are ignored; an empty
    table gives an empty one.  Only counts come to the driver.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = staged(links.where(F.col("a") != F.col("b")).select(a, b).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = staged(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
