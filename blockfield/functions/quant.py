"""Quantization of single coefficients."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.fixed import (
    fits_product, half_away_div, half_away_shift, int_div, lit, lookup, mul_floor_shift, mul_half_away_shift, wide_floor_div, wide_product,
)

QM_ONE_Q16 = 1 << 16
_SQUARE = {C.X: C.INV_SQUARE_X_Q16, C.Y: C.INV_SQUARE_Y_Q16, C.B: C.INV_SQUARE_B_Q16}
_RECT = {C.X: C.INV_RECT_X_Q16, C.Y: C.INV_RECT_Y_Q16, C.B: C.INV_RECT_B_Q16}


def _by_shape(square: Column, rect: Column, raw_strategy: Column) -> Column:
    return F.when(raw_strategy == C.DCT, square).otherwise(rect)


def inverse_weight(channel: int, k: Column, raw_strategy: Column) -> Column:
    return _by_shape(lookup(_SQUARE[channel], k), lookup(_RECT[channel], k), raw_strategy)


def quadrant_thresholds(values, width: int) -> list:
    """Per-coefficient thresholds of an 8-row, ``width``-column layout."""
    return [values[2 * (k // width >= 4) + (k % width >= width // 2)] for k in range(8 * width)]


def threshold(channel: int, k: Column, raw_strategy: Column, fraction_bits: int) -> Column:
    square = quadrant_thresholds(C.THRESHOLD_SQUARE_Q12[channel], 8)
    rect = quadrant_thresholds(C.THRESHOLD_RECT_Q12[channel], 16)
    scale = lambda v: v << (fraction_bits - 12) if fraction_bits >= 12 else v >> (12 - fraction_bits)
    return _by_shape(lookup(map(scale, square), k), lookup(map(scale, rect), k), raw_strategy)


def weighted(coefficient: Column, channel: int, k: Column, raw_strategy: Column) -> Column:
    return mul_floor_shift(coefficient, inverse_weight(channel, k, raw_strategy), 16)


def scaled(weighted_value: Column, step: Column) -> Column:
    """Weighted coefficient times scale * quant * qm, back in coefficient precision."""
    return mul_floor_shift(weighted_value, step, 32)


def dead_zone(value: Column, limit: Column, fraction_bits: int) -> Column:
    return F.when(F.abs(value) >= limit, half_away_shift(value, fraction_bits)).otherwise(lit(0))


def dequantize_bias(q: Column) -> Column:
    """Q16 reconstruction point of a quantized luma coefficient."""
    magnitude = F.abs(q)
    other = F.shiftleft(magnitude, 16) - int_div(lit(C.QUANT_BIAS_OTHER_Q16), F.greatest(magnitude, lit(1)))
    point = F.when(magnitude == 0, lit(0)).when(magnitude == 1, lit(C.QUANT_BIAS_ONE_Q16)).otherwise(other)
    return F.when(q < 0, -point).otherwise(point)


def reconstruct_luma(q: Column, k: Column, raw_strategy: Column, inv_qac_q16: Column, fraction_bits: int) -> Column:
    weight = _by_shape(lookup(C.WEIGHT_SQUARE_Y_Q32, k), lookup(C.WEIGHT_RECT_Y_Q32, k), raw_strategy)
    point, n = dequantize_bias(q), 64 - fraction_bits
    # A product beyond 62 bits goes on in DECIMAL; a reconstruction beyond BIGINT becomes null instead of failing the job.
    wide = wide_floor_div((wide_product(point, weight) * inv_qac_q16.cast("decimal(19,0)")).cast("decimal(38,0)"), n).try_cast("bigint")
    small = F.when(fits_product(point, weight), point * weight)
    return F.when(small.isNotNull(), mul_floor_shift(small, inv_qac_q16, n)).otherwise(wide)


def cfl_factor(multiplier: Column, base: int) -> Column:
    """Q16 prediction factor: base + round(multiplier * 2^16 / 84)."""
    return lit(base) + half_away_div(F.shiftleft(multiplier, 16), C.COLOR_FACTOR_DENOMINATOR)


def chroma_residual(coefficient: Column, factor_q16: Column, luma: Column) -> Column:
    return coefficient - mul_floor_shift(factor_q16, luma, 16)


def quantize_dc(coefficient: Column, inv_dc_q16: Column, fraction_bits: int, luma_dc: Column = None) -> Column:
    """DC level; blue passes the quantized luma DC and loses half of it."""
    product = coefficient * inv_dc_q16
    if luma_dc is not None:
        product = product - F.shiftleft(luma_dc, 15 + fraction_bits)
    return half_away_shift(product, fraction_bits + 16)


def low_pair(c0: Column, c1: Column) -> tuple:
    """The two cell DCs of a rectangular transform from its two lowest coefficients."""
    side = mul_half_away_shift(c1, lit(C.RECT_LOW_SCALE_Q32), 32)
    return c0 + side, c0 - side
