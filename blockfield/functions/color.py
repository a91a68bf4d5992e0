"""Color conversion on pixel rows: sRGB decoding, sample quantization, RGB -> XYB."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions import curves
from blockfield.functions.fixed import (
    clamp, floor_shift, half_up_shift, lit, lookup, shift_left_by, shift_right_by,
)


def srgb_to_linear(v: Column) -> Column:
    """Piecewise sRGB transfer function on 0..1 samples."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def quantize_sample(v: Column, fraction_bits: int, bits: int = 16) -> Column:
    """Nearest (ties to even) fixed-point sample clamped to ``bits``; null when not finite."""
    top = (1 << (bits - 1)) - 1
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    scaled = F.rint(v * float(1 << fraction_bits))
    return F.when(
        finite, F.least(F.greatest(scaled, F.lit(float(-top - 1))), F.lit(float(top))).cast("bigint")
    )


def _absorbance(r: Column, g: Column, b: Column, row) -> Column:
    mixed = half_up_shift(r * lit(row[0]) + g * lit(row[1]) + b * lit(row[2]), 10)
    return F.greatest(mixed + lit(C.OPSIN_BIAS_Q24), lit(0))


def _exponent(a: Column) -> Column:
    """Power-of-eight exponent -8..2 that brings the absorbance into 1..8."""
    chain = None
    for e in range(-8, 2):
        below = a < lit(1 << (24 + 3 * (e + 1)))
        chain = F.when(below, e) if chain is None else chain.when(below, e)
    return chain.otherwise(2)


def _cube_root(a: Column, e: Column, n: Column, fraction_bits: int) -> Column:
    table = curves.cube_root(fraction_bits)
    bias = curves.fixed(C.CBRT_NEGATIVE_BIAS, fraction_bits)
    cell = clamp(floor_shift(n, 18), 64, 511) - 64
    part = n.bitwiseAND(lit((1 << 18) - 1))
    root = half_up_shift(lookup(table, cell) * (lit(1 << 18) - part) + lookup(table, cell + 1) * part, 18)
    scaled = F.when(
        e < 0, shift_right_by(root + shift_left_by(lit(1), F.greatest(-e - 1, F.lit(0))), F.greatest(-e, F.lit(0)))
    ).otherwise(shift_left_by(root, F.greatest(e, F.lit(0))))
    return F.when(a <= 0, lit(bias)).otherwise(scaled + lit(bias))


def to_xyb(pixels: DataFrame, fraction_bits=(12,)) -> DataFrame:
    """Replace r, g, b (Q8) by XYB planes; one mixing pass serves every requested precision.

    A precision q yields columns ``x_q<q>``, ``y_q<q>``, ``b_q<q>``.
    """
    keep = [F.col(c) for c in pixels.columns if c not in ("r", "g", "b")]
    r, g, b = (F.col(c).cast("bigint") for c in ("r", "g", "b"))
    stage = pixels.select(*keep, *[_absorbance(r, g, b, row).alias(f"_a{i}") for i, row in enumerate(C.MIX_Q26)])
    stage = stage.select("*", *[_exponent(F.col(f"_a{i}")).alias(f"_e{i}") for i in range(3)])
    zero = F.lit(0)
    stage = stage.select(
        "*",
        *[
            F.when(F.col(f"_e{i}") < 0, shift_left_by(F.col(f"_a{i}"), F.greatest(-3 * F.col(f"_e{i}"), zero)))
            .otherwise(shift_right_by(F.col(f"_a{i}"), F.greatest(3 * F.col(f"_e{i}"), zero)))
            .alias(f"_n{i}")
            for i in range(3)
        ],
    )
    roots = [
        _cube_root(F.col(f"_a{i}"), F.col(f"_e{i}"), F.col(f"_n{i}"), q).alias(f"_t{i}_{q}")
        for q in fraction_bits
        for i in range(3)
    ]
    stage = stage.select(*keep, *roots)
    planes = []
    for q in fraction_bits:
        t0, t1, t2 = (F.col(f"_t{i}_{q}") for i in range(3))
        planes += [
            F.shiftright(t0 - t1, 1).alias(f"x_q{q}"),
            F.shiftright(t0 + t1, 1).alias(f"y_q{q}"),
            t2.alias(f"b_q{q}"),
        ]
    return stage.select(*keep, *planes)
