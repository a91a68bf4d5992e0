"""Adaptive quantization: contrast, erosion, masks, modulation, final map, raw quant.

Everything runs on block-column rows partitioned by (frame_id, stripe); the windows and groupings below all
contain those two keys, so none of them moves data again.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions import masks
from blockfield.functions.fixed import clamp, half_up_shift, int_div, lit
from blockfield.operators.geometry import BLOCK_KEYS, with_geometry
from blockfield.operators.params import with_distance

XYB_MIN_Q12, XYB_MAX_Q12 = -(8 << 12), (8 << 12) - 1
CELLS = ["c0", "c1", "c2", "c3"]
STRIPE_CELLS = C.TILE // 4


def neighbour_samples(columns: DataFrame) -> DataFrame:
    """One row per pixel with its four neighbours (X and Y, Q12).

    Left and right stop at the frame edge, up and down at the stripe edge, where a pixel is its own neighbour.
    """
    across = Window.partitionBy("frame_id", "stripe", "by").orderBy("bx", "col")
    down = Window.partitionBy("frame_id", "stripe", "bx", "col").orderBy("by")
    staged = columns.select(
        *BLOCK_KEYS, "col", F.col("x_q12").alias("xs"), F.col("y_q12").alias("ys"), F.col("b_q12").alias("bs")
    ).select(
        "*",
        *[F.coalesce(F.lag(c).over(across), F.col(c)).alias(f"l{c}") for c in ("xs", "ys")],
        *[F.coalesce(F.lead(c).over(across), F.col(c)).alias(f"r{c}") for c in ("xs", "ys")],
        *[F.coalesce(F.lag(F.col(c)[7]).over(down), F.col(c)[0]).alias(f"u{c}") for c in ("xs", "ys")],
        *[F.coalesce(F.lead(F.col(c)[0]).over(down), F.col(c)[7]).alias(f"d{c}") for c in ("xs", "ys")],
    )

    def sample(i: int) -> Column:
        up = lambda c: F.col(c)[i - 1] if i else F.col(f"u{c}")
        below = lambda c: F.col(c)[i + 1] if i < 7 else F.col(f"d{c}")
        fields = {"row": lit(i), "cx": F.col("xs")[i], "cy": F.col("ys")[i], "cb": F.col("bs")[i]}
        for axis in ("x", "y"):
            s = f"{axis}s"
            fields |= {f"l{axis}": F.col(f"l{s}")[i], f"r{axis}": F.col(f"r{s}")[i], f"u{axis}": up(s), f"d{axis}": below(s)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return staged.select(*BLOCK_KEYS, "col", F.inline(F.array(*[sample(i) for i in range(8)])))


def contrast_pixels(samples: DataFrame) -> DataFrame:
    """Add ``contrast_q16`` to neighbour samples."""
    lim = lambda c: clamp(F.col(c), XYB_MIN_Q12, XYB_MAX_Q12)
    spread = lambda a: F.shiftleft(lim(f"c{a}"), 2) - (lim(f"l{a}") + lim(f"r{a}") + lim(f"u{a}") + lim(f"d{a}"))
    return (
        samples.withColumn("_adjusted", F.greatest(lim("cy") + masks.GAMMA_OFFSET_Q12, lit(0)))
        .withColumn("_gamma", masks.contrast_gamma(F.col("_adjusted")))
        .withColumn("_sx", half_up_shift(spread("x") * F.col("_gamma"), 10))
        .withColumn("_sy", half_up_shift(spread("y") * F.col("_gamma"), 10))
        .withColumn("contrast_q16", masks.contrast_sample(F.col("_sx"), F.col("_sy")))
        .drop("_adjusted", "_gamma", "_sx", "_sy")
    )


def block_statistics(columns: DataFrame) -> DataFrame:
    """Every per-block pixel sum in one pass.

    c0..c3 are the four 4x4 contrast cells in raster order; edge_sum, red_sum, blue_sum and ratio_sum feed the
    high-frequency, color and gamma modulation.
    """
    px = contrast_pixels(neighbour_samples(columns))
    cell = F.shiftleft(F.shiftright("row", 2), 1) + F.shiftright("col", 2)
    edges = F.when(F.col("col") < 7, F.abs(F.col("cy") - F.col("ry"))).otherwise(lit(0)) + F.when(
        F.col("row") < 7, F.abs(F.col("cy") - F.col("dy"))
    ).otherwise(lit(0))
    luma = F.col("cy") + masks.GAMMA_INPUT_OFFSET_Q12
    ratio = masks.inverse_gamma_ratio(luma - F.col("cx")) + masks.inverse_gamma_ratio(luma + F.col("cx"))
    sums = px.groupBy(*BLOCK_KEYS).agg(
        *[F.sum(F.when(cell == i, F.col("contrast_q16"))).alias(CELLS[i]) for i in range(4)],
        F.sum(edges).alias("edge_sum"),
        F.sum(masks.red_coverage(F.col("cx"))).alias("red_sum"),
        F.sum(masks.blue_coverage(F.col("cy"), F.col("cb"))).alias("blue_sum"),
        F.sum(ratio).alias("ratio_sum"),
    )
    cells = [F.least(half_up_shift(F.col(c), 2), lit(masks.INT31_MAX)).alias(c) for c in CELLS]
    return sums.select(*BLOCK_KEYS, *cells, "edge_sum", "red_sum", "blue_sum", "ratio_sum")


def contrast_map(columns: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, cell, cell_x, cell_y, contrast_q16) over the quarter-resolution grid."""
    stats = block_statistics(columns).join(with_geometry(frames).select("frame_id", "x_blocks"), "frame_id")
    cells = F.array(*[F.struct(lit(i).alias("i"), F.col(c).alias("contrast_q16")) for i, c in enumerate(CELLS)])
    return (
        stats.select("frame_id", "bx", "by", "x_blocks", F.inline(cells))
        .withColumn("cell_x", F.col("bx") * 2 + F.col("i") % 2)
        .withColumn("cell_y", F.col("by") * 2 + int_div(F.col("i"), 2))
        .select("frame_id", (F.col("cell_y") * F.col("x_blocks") * 2 + F.col("cell_x")).alias("cell"),
                "cell_x", "cell_y", "contrast_q16")
    )


def erosion(stats: DataFrame) -> DataFrame:
    """Add ``erosion_q16``: per cell the centre plus the four smallest of its 3x3 neighbourhood, over 20."""
    down = Window.partitionBy("frame_id", "stripe", "bx").orderBy("by")
    across = Window.partitionBy("frame_id", "stripe", "by").orderBy("bx")
    rows = stats.select(
        "*",
        F.coalesce(F.lag("c2").over(down), F.col("c0")).alias("u0"),
        F.coalesce(F.lag("c3").over(down), F.col("c1")).alias("u1"),
        F.coalesce(F.lead("c0").over(down), F.col("c2")).alias("d0"),
        F.coalesce(F.lead("c1").over(down), F.col("c3")).alias("d1"),
    )
    near, far = F.array("u0", "c0", "c2", "d0"), F.array("u1", "c1", "c3", "d1")
    rows = rows.select(
        "*", F.coalesce(F.lag(far).over(across), near).alias("_l"), F.coalesce(F.lead(near).over(across), far).alias("_r")
    )
    grid = [[F.col("_l")[r], near[r], far[r], F.col("_r")[r]] for r in range(4)]

    def smallest(i: int, j: int) -> Column:
        around = F.array(*[grid[r][c] for r in range(i, i + 3) for c in range(j, j + 3)])
        return F.slice(F.array_sort(around), 1, 4)

    rows = rows.select("*", *[smallest(i, j).alias(f"_s{2 * i + j}") for i in (0, 1) for j in (0, 1)])
    total = sum((F.col(CELLS[i]) + sum((F.col(f"_s{i}")[n] for n in range(1, 4)), F.col(f"_s{i}")[0]) for i in range(1, 4)),
                F.col("c0") + F.col("_s0")[0] + F.col("_s0")[1] + F.col("_s0")[2] + F.col("_s0")[3])
    return rows.withColumn("erosion_q16", F.least(int_div(total + 10, 20), lit(masks.INT31_MAX))).select(
        *stats.columns, "erosion_q16"
    )


def neighbourhood(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, cell_x, cell_y, around): the sorted nine values of every cell's 3x3 window.

    The window is clamped at the frame's edges and at the 16-cell stripe, so a cell there meets its own row or column
    again and nine values always exist.  Every cell asks for nine coordinates; one equi-join answers.
    """
    shape = with_geometry(frames).select("frame_id", (F.col("x_blocks") * 2).alias("_w"), (F.col("y_blocks") * 2).alias("_h"))
    x, y = F.col("cell_x"), F.col("cell_y")
    low = y - y % STRIPE_CELLS
    high = F.least(low + STRIPE_CELLS, F.col("_h")) - 1
    offsets = F.array(*[F.struct(lit(i).alias("_ox"), lit(j).alias("_oy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = cells.select("frame_id", "cell_x", "cell_y").join(shape, "frame_id").select("*", F.inline(offsets)).select(
        "frame_id", "cell_x", "cell_y", F.least(F.greatest(x + F.col("_ox"), lit(0)), F.col("_w") - 1).alias("_x"),
        F.least(F.greatest(y + F.col("_oy"), low), high).alias("_y"))
    given = cells.select("frame_id", F.col("cell_x").alias("_x"), F.col("cell_y").alias("_y"), "contrast_q16")
    met = asked.join(given, ["frame_id", "_x", "_y"])
    return met.groupBy("frame_id", "cell_x", "cell_y").agg(F.array_sort(F.collect_list("contrast_q16")).alias("around"))


def with_masks(eroded: DataFrame) -> DataFrame:
    e = F.col("erosion_q16")
    return eroded.withColumn("mask_q16", masks.strategy_mask(e)).withColumn("seed_q24", masks.nonlinear_mask(e))


def modulate(masked: DataFrame, frames: DataFrame) -> DataFrame:
    """Add the cumulative hf_q24, color_q24 and gamma_q24 seeds plus the frame parameters used later."""
    params = with_distance(frames).select(
        "frame_id", "distance_q8", "fixed_raw_quant", "aq_scale_q24", "aq_dampen_q24", "aq_inv_global_q24"
    )
    return (
        masked.join(params, "frame_id")
        .withColumn("hf_q24", masks.hf_modulation(F.col("seed_q24"), F.col("edge_sum")))
        .withColumn("color_q24", masks.color_modulation(F.col("hf_q24"), F.col("distance_q8"), F.col("red_sum"), F.col("blue_sum")))
        .withColumn("gamma_q24", masks.gamma_modulation(F.col("color_q24"), F.col("ratio_sum")))
    )


def final_fields(modulated: DataFrame) -> DataFrame:
    """Add ``aq_map_q24`` and ``raw_quant``; a nonzero fixed_raw_quant overrides the adaptive byte."""
    adaptive = masks.raw_quant(F.col("aq_map_q24"), F.col("aq_inv_global_q24"))
    fixed = F.col("fixed_raw_quant").cast("bigint")
    return modulated.withColumn(
        "aq_map_q24", masks.final_map(F.col("gamma_q24"), F.col("aq_scale_q24"), F.col("aq_dampen_q24"))
    ).withColumn("raw_quant", F.when(fixed == 0, adaptive).otherwise(fixed))


def aq_blocks(columns: DataFrame, frames: DataFrame) -> DataFrame:
    """The whole chain, one row per block."""
    return final_fields(modulate(with_masks(erosion(block_statistics(columns))), frames)).select(
        *BLOCK_KEYS, "erosion_q16", "mask_q16", "seed_q24", "hf_q24", "color_q24", "gamma_q24", "aq_map_q24", "raw_quant"
    )
