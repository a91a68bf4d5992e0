"""Raster scans inside a frame without sorting a whole frame in one task.

A block row has at most 8192 blocks and a frame at most 8192 block rows, so a running total is a window inside
block rows plus a window over the per-row totals.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions.fixed import lit


def raster_scan(cells: DataFrame, amount: Column, offset: str, previous: list = ()) -> DataFrame:
    """Add the exclusive raster running total of ``amount`` as ``offset`` and the frame's total as ``offset``_total.

    Every column named in ``previous`` is also carried over from the preceding raster cell as ``prev_<name>``.
    """
    row = Window.partitionBy("frame_id", "by").orderBy("bx")
    frame = Window.partitionBy("frame_id").orderBy("by")
    staged = cells.withColumn("_amount", amount)
    summary = staged.groupBy("frame_id", "by").agg(
        F.sum("_amount").alias("_row_total"), *[F.max_by(c, "bx").alias(f"_tail_{c}") for c in previous]
    )
    before = (Window.unboundedPreceding, -1)
    summary = summary.select(
        "frame_id", "by",
        F.coalesce(F.sum("_row_total").over(frame.rowsBetween(*before)), lit(0)).alias("_row_base"),
        F.sum("_row_total").over(Window.partitionBy("frame_id")).alias(f"{offset}_total"),
        *[F.lag(f"_tail_{c}").over(frame).alias(f"_tail_{c}") for c in previous],
    )
    staged = staged.withColumn("_local", F.coalesce(F.sum("_amount").over(row.rowsBetween(*before)), lit(0)))
    for c in previous:
        staged = staged.withColumn(f"_lag_{c}", F.lag(c).over(row))
    return staged.join(summary, ["frame_id", "by"]).select(
        *cells.columns, (F.col("_row_base") + F.col("_local")).alias(offset), f"{offset}_total",
        *[F.coalesce(F.col(f"_lag_{c}"), F.col(f"_tail_{c}")).alias(f"prev_{c}") for c in previous],
    )


def neighbours(cells: DataFrame, values: list, x: str = "bx", y: str = "by") -> DataFrame:
    """Add west (w_), north (n_) and northwest (nw_) values; null outside the grid."""
    across = Window.partitionBy("frame_id", y).orderBy(x)
    down = Window.partitionBy("frame_id", x).orderBy(y)
    own = F.struct(*values)
    wide = cells.withColumn("_w", F.lag(own).over(across)).withColumn("_up", F.lag(F.struct(own.alias("n"), F.col("_w").alias("nw"))).over(down))
    return wide.select(
        *cells.columns,
        *[F.col(f"_w.{v}").alias(f"w_{v}") for v in values],
        *[F.col(f"_up.n.{v}").alias(f"n_{v}") for v in values],
        *[F.col(f"_up.nw.{v}").alias(f"nw_{v}") for v in values],
    )
