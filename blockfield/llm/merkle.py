"""Merkle manifest of a bundle's records: digest trees as grouped pivots over slots.

A level of a tree is a table of nodes (tree, place, digest).  Eight neighbours are one parent: conditional aggregates spread
their digests into the slot columns s0 .. s7 of the parent's row, and the digest of the joined columns is the parent's.  On
the way down a node's siblings are the same columns without its own slot.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.shared import partitions, staged

FANOUT = 8
STEP = "struct<left:string,right:string>"


def field_text(field: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = (F.col(field) if isinstance(field, str) else field).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*fields: str | Column) -> Column:
    """Lowercase hex sha256 of a record's fields."""
    return F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256)


def proof_digest(path: str) -> Column:
    """Digest of the siblings of all levels, from the leaf's run up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def folded_root(path: str, leaf: str | Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]).cast("binary"), 256))


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add tree (number of the group, null first), place (from 0 in its group by ``order``, nulls first) and n (its rows).

    Rows are dealt out by ranges of (group, order, row), so a group that holds most rows, or one record repeated, spreads; rows
    are numbered in every range, and ranges by the counts of the ranges before them.
    """
    spark, by = rows.sparkSession, [F.col(c).asc_nulls_first() for c in (*order, "_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions(spark), F.col(group).asc_nulls_first(), *by)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_count"))
    inside = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_count").over(inside.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = counts.select("_group").distinct().select("_group", (F.row_number().over(Window.orderBy(F.col("_group").asc_nulls_first())) - 1).cast("bigint").alias("tree"))
    ahead = counts.select("_group", "_in", before.alias("_before"), F.sum("_count").over(inside).alias("n"))
    ahead = ahead.join(numbers.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    here = F.row_number().over(Window.partitionBy("_part", group).orderBy(*by)) - 1
    found = ranged.withColumn("_here", here).join(ahead, (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("place", F.col("_here") + F.col("_before")).drop("_row", "_part", "_here", "_group", "_in", "_before", "_count")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, place, n, s0 .., digest) of the runs of ``fanout`` nodes (tree, place, n, digest); trees of one node have none."""
    slot = F.col("place") % fanout
    spread = [F.max(F.when(slot == k, F.col("digest"))).alias(f"s{k}") for k in range(fanout)]
    up = F.floor(F.col("place") / fanout).alias("place")
    grouped = nodes.where("n > 1").groupBy("tree", up).agg(F.ceil(F.max("n") / fanout).alias("n"), *spread)
    return grouped.withColumn("digest", F.sha2(F.concat_ws("", *[f"s{k}" for k in range(fanout)]).cast("binary"), 256))


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above the leaves, written one by one; their number is the logarithm of the largest tree."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = staged(parents(nodes, fanout))
        out.append(nodes)
        most = -(-most // fanout)
    return out


def _siblings(fanout: int) -> Column:
    """The run's digests left and right of the node in slot ``_slot``."""
    join = lambda ks: F.concat_ws("", *[f"s{k}" for k in ks])
    step = F.when(F.col("_slot") == 0, F.struct(F.lit("").alias("left"), join(range(1, fanout)).alias("right")))
    for k in range(1, fanout):
        step = step.when(F.col("_slot") == k, F.struct(join(range(k)).alias("left"), join(range(k + 1, fanout)).alias("right")))
    return step.cast(STEP)


def with_paths(leaves: DataFrame, above: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add path, the siblings of every level up to the root; ``tops`` (tree, path) goes on from each tree's own root."""
    tops = tops.select(F.col("tree").alias("_tree"), F.col("path").alias("path"))
    over = None
    for nodes in [*above[::-1], leaves]:
        alone = nodes.where("n = 1").join(tops, F.col("tree") == F.col("_tree")).drop("_tree")
        if over is not None:
            runs = over.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), *[f"s{k}" for k in range(fanout)], F.col("path").alias("_path"))
            low = nodes.where("n > 1").select(*[F.col(c).alias(f"_own_{c}") for c in nodes.columns])
            met = low.join(runs, (F.col("_own_tree") == F.col("_tree")) & (F.floor(F.col("_own_place") / fanout) == F.col("_place")))
            met = met.withColumn("_slot", F.col("_own_place") % fanout)
            path = F.concat(F.array(_siblings(fanout)), F.col("_path")).alias("path")
            alone = alone.unionByName(met.select(*[F.col(f"_own_{c}").alias(c) for c in nodes.columns], path))
        over = alone
    return over


def merkle_manifest(records: DataFrame, fields: tuple[str, ...], key: str = "frame_id", group: str = "artifact", fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, group, leaf, subroot, root, path ARRAY<STRUCT<left, right>>, *carry) of records, one row per row.

    ``leaf`` is the digest of the record's fields.  In a group leaves ascend by key (null first), then by digest; while a
    level has several nodes, every ``fanout`` neighbours become one, the last run with as many as are left, even one.  The
    node that remains is the group's subroot, a lone leaf itself; the subroots, ordered by group (null first, by bytes),
    give the root in the same way.  ``path`` holds, from the leaf's run up to the root, the digests left and right of the
    node, joined; it is empty for a single record.  Null fields are told from empty ones; repeated rows are leaves of their
    own; a null group is a group; other columns than those named are not read; an empty table gives an empty one.
    """
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_none"))
    rows = records.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("_of"), leaf_digest(*fields).alias("digest"), held.alias("_carry"))
    leaves = staged(placed(rows, "_of", "_key", "digest"))
    above = levels(leaves.select("tree", "place", "n", "digest"), fanout)
    roots = leaves.select("tree", "n", "digest")
    for level in above:
        roots = roots.union(level.select("tree", "n", "digest"))
    roots = staged(roots.where("n = 1").select("tree", F.col("digest").alias("subroot")))
    trees = roots.agg(F.count(F.lit(1)).alias("n"))
    tops = staged(roots.crossJoin(F.broadcast(trees)).select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), "n", F.col("subroot").alias("digest")))
    over = levels(tops, fanout)
    root = (over[-1] if over else tops).where("n = 1").select(F.lit(0).cast("bigint").alias("tree"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    ways = with_paths(tops, over, root.select("tree", "path"), fanout).select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "path")
    ways = staged(ways.crossJoin(F.broadcast(root.select("root"))))
    named = with_paths(leaves, above, ways.select("tree", "path"), fanout).join(ways.select(F.col("tree").alias("_tree"), "subroot", "root"), F.col("tree") == F.col("_tree"))
    return named.select(F.col("_key").alias(key), F.col("_of").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"_carry.{c}") for c in carry])
