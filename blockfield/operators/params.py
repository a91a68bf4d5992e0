"""Frame parameters: distance lookup with a default row, and experiment overrides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C

SHAPE_COST_COLUMNS = ["distance_q8", "cost1_q16", "dct_multiplier_q16", "rect_multiplier_q16"]


def literal_table(spark, columns, rows) -> DataFrame:
    """A small fixed table of BIGINT columns."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def _with_default_row(frames: DataFrame, columns, rows) -> DataFrame:
    """Left join a six-row table on distance_q8; an unknown distance takes the row of distance 1.0."""
    default = next(row for row in rows if row[0] == C.DEFAULT_DISTANCE_Q8)
    renamed = [f"_{c}" for c in columns]
    table = literal_table(frames.sparkSession, renamed, rows)
    joined = frames.join(F.broadcast(table), F.col("distance_q8") == F.col("_distance_q8"), "left")
    filled = [
        F.coalesce(F.col(f"_{c}"), F.lit(v).cast("bigint")).alias(c) for c, v in list(zip(columns, default))[1:]
    ]
    return joined.select(*frames.columns, *filled, F.col("_distance_q8").isNotNull().alias("supported"))


def with_distance(frames: DataFrame) -> DataFrame:
    """Distance-derived parameters; ``supported`` tells whether the distance itself was in the table."""
    return _with_default_row(frames, C.DISTANCE_COLUMNS, C.DISTANCE_ROWS)


def with_shape_cost(frames: DataFrame) -> DataFrame:
    return _with_default_row(frames, SHAPE_COST_COLUMNS, C.SHAPE_COST_ROWS)


def ac_scale(frames: DataFrame) -> DataFrame:
    """Scale, reciprocal and raw quant of the fixed path: zero overrides mean "use the distance's value"."""
    by_distance = F.col("fixed_point_scale") == 0
    by_default = F.col("fixed_raw_quant") == 0
    pick = lambda when, own, other: F.when(when, own).otherwise(F.col(other).cast("bigint"))
    return with_distance(frames).select(
        "frame_id",
        pick(by_distance, F.col("scale_q16"), "fixed_point_scale").alias("scale_q16"),
        pick(by_distance & by_default, F.col("inv_qac_q16"), "fixed_inv_qac_q16").alias("inv_qac_q16"),
        pick(by_default, F.lit(C.DEFAULT_RAW_QUANT).cast("bigint"), "fixed_raw_quant").alias("raw_quant"),
    )
