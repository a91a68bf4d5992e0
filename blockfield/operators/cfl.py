"""Luma-to-chroma regression per 64x64 tile."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.fixed import (
    clamp, floor_shift, half_away_div, int_div, lit, lookup, mul_floor_shift,
)
from blockfield.operators.geometry import with_geometry

REGRESSION = {"x": (C.INV_SQUARE_X_Q16, False), "b": (C.INV_SQUARE_B_Q16, True)}


def tile_columns() -> list:
    return [int_div(F.col("bx"), C.BLOCKS_PER_TILE).alias("tile_x"), int_div(F.col("by"), C.BLOCKS_PER_TILE).alias("tile_y")]


def multiplier(sum_aa: Column, sum_ab: Column, count: Column) -> Column:
    d = sum_aa + count * C.CFL_REGULARIZER_Q16
    fit = clamp(half_away_div(-sum_ab, F.greatest(d, lit(1))), -128, 127)
    return F.when(count == 0, lit(0)).otherwise(fit)


def cfl_tiles(coefficients: DataFrame, fraction_bits: int) -> DataFrame:
    """(frame_id, stripe, tile_x, tile_y, ytox, ytob, n) from 8x8 coefficients.

    Sums are combined map-side per tile; a tile is at most 4096 coefficients.
    """
    q16 = {p: floor_shift(F.col(p), fraction_bits - 16) for p in ("x", "y", "b")}
    staged = coefficients.select(
        "frame_id", "stripe", *tile_columns(),
        *[mul_floor_shift(q16["y"], lookup(w, F.col("k")), 16).alias(f"_m{p}") for p, (w, _) in REGRESSION.items()],
        *[mul_floor_shift(q16[p], lookup(w, F.col("k")), 16).alias(f"_s{p}") for p, (w, _) in REGRESSION.items()],
    )
    staged = staged.select(
        "frame_id", "stripe", "tile_x", "tile_y",
        *[half_away_div(F.col(f"_m{p}"), C.COLOR_FACTOR_DENOMINATOR).alias(f"_a{p}") for p in REGRESSION],
        *[((F.col(f"_m{p}") if base else lit(0)) - F.col(f"_s{p}")).alias(f"_b{p}") for p, (_, base) in REGRESSION.items()],
    )
    sums = staged.groupBy("frame_id", "stripe", "tile_x", "tile_y").agg(
        *[F.sum(mul_floor_shift(F.col(f"_a{p}"), F.col(f"_a{p}"), 16)).alias(f"aa_{p}") for p in REGRESSION],
        *[F.sum(mul_floor_shift(F.col(f"_a{p}"), F.col(f"_b{p}"), 16)).alias(f"ab_{p}") for p in REGRESSION],
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select(
        "frame_id", "stripe", "tile_x", "tile_y",
        multiplier(F.col("aa_x"), F.col("ab_x"), F.col("n")).alias("ytox"),
        multiplier(F.col("aa_b"), F.col("ab_b"), F.col("n")).alias("ytob"), "n",
    )


def cfl_maps(coefficients: DataFrame, frames: DataFrame, fraction_bits: int = 16) -> DataFrame:
    """Raster tile maps: (frame_id, tile, ytox, ytob, n)."""
    shape = with_geometry(frames).select("frame_id", "x_tiles")
    return cfl_tiles(coefficients, fraction_bits).join(shape, "frame_id").select(
        "frame_id", (F.col("tile_y") * F.col("x_tiles") + F.col("tile_x")).alias("tile"), "ytox", "ytob", "n"
    )


