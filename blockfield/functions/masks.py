"""Adaptive-quantization arithmetic on single values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockfield.functions import curves
from blockfield.functions.fixed import (
    UINT32_MAX, bit_length, clamp, fits_product, floor_shift, half_away_shift, half_up_shift, int_div, isqrt,
    lit, lookup, mul_floor_shift, saturate32, shift_left_by, shift_right_by, wide_floor_div, wide_floor_shift, wide_isqrt,
)

# Fixed values of the contrast measure.
GAMMA_OFFSET_Q12 = 78
CONTRAST_X_MULTIPLIER_Q16 = 1535299
CONTRAST_SQRT_MULTIPLIER_Q16 = 9531097631
CONTRAST_OFFSET_Q40 = 29116685320802
CONTRAST_INPUT_MAX = (1 << 74) - 1
INT31_MAX = (1 << 31) - 1

# Fixed values of the modulation terms.
HF_MULTIPLIER_Q32 = 76895992
RED_START_Q16, RED_LENGTH_Q16, RED_CAP_Q16, RED_COEFFICIENT_Q24 = 480, 1273, 38962, 7152598
BLUE_START_Q16, BLUE_LENGTH_Q16, BLUE_CAP_Q16, BLUE_COEFFICIENT_Q24 = 17677, 5694, 174311, 1193632
COLOR_BASELINE_Q24 = 335218
GAMMA_INPUT_OFFSET_Q12 = 655
GAMMA_MULTIPLIER_Q24 = -1805633
LOG2E_Q24 = 24204406


def _interpolate(table, relative: Column, step_bits: int) -> Column:
    step = 1 << step_bits
    base = F.shiftright(relative, step_bits)
    part = relative.bitwiseAND(lit(step - 1))
    last = len(table) - 1
    inner = F.least(base, lit(last - 1))
    mixed = half_up_shift(lookup(table, inner) * (lit(step) - part) + lookup(table, inner + 1) * part, step_bits)
    return F.when(base >= last, lit(table[-1])).otherwise(mixed)


def contrast_gamma(adjusted: Column) -> Column:
    """Q16 gamma ratio of an offset, nonnegative Q12 luma sample."""
    tables = curves.contrast_gamma()
    line = half_up_shift(F.least(adjusted, lit(8 << 12)) * lit(tables["slope"]), 12) + lit(tables["intercept"])
    return (
        F.when(adjusted <= 256, lookup(tables["fine"], F.least(adjusted, lit(256))))
        .when(adjusted <= 4096, _interpolate(tables["coarse"], clamp(adjusted - 256, 0, 3840), 4))
        .otherwise(line)
    )


def contrast_sample(sx: Column, sy: Column) -> Column:
    """Q16 contrast of one pixel from its gamma-scaled Q20 differences."""
    d40 = sy * sy + _scaled_square(sx)
    d24 = half_up_shift(d40, 16)
    near = half_up_shift(isqrt(d24 * lit(CONTRAST_SQRT_MULTIPLIER_Q16) + lit(CONTRAST_OFFSET_Q40)), 6)

    ws = lambda v: v.cast("decimal(19,0)")
    half16, d = F.lit(1 << 15).cast("decimal(38,0)"), "decimal(38,0)"
    squares = lambda v: (ws(v) * ws(v)).cast(d)
    weighted = (squares(sx) * F.lit(CONTRAST_X_MULTIPLIER_Q16).cast("decimal(10,0)")).cast(d)
    scaled = wide_floor_div(weighted + half16, 16)
    w24 = wide_floor_shift((squares(sy) + scaled + half16).cast(d), 16)
    masking = F.least(
        (ws(w24) * F.lit(CONTRAST_SQRT_MULTIPLIER_Q16).cast("decimal(19,0)")).cast(d)
        + F.lit(CONTRAST_OFFSET_Q40).cast(d),
        F.expr(f"cast('{CONTRAST_INPUT_MAX}' as decimal(38,0))"),
    ).cast(d)
    far = F.least(half_up_shift(wide_isqrt(masking), 6), lit(INT31_MAX))

    small = (F.abs(sx) < (1 << 19)) & (F.abs(sy) < (1 << 21))
    return F.when(small, F.least(near, lit(INT31_MAX))).otherwise(far)


def _scaled_square(sx: Column) -> Column:
    return half_up_shift(sx * sx * lit(CONTRAST_X_MULTIPLIER_Q16), 16)


def strategy_mask(erosion_q16: Column) -> Column:
    """1 / (erosion + 0.001) in Q16."""
    d = erosion_q16 * 1000 + lit(1 << 16)
    return int_div(lit((1 << 32) * 1000) + int_div(d, 2), d)


def nonlinear_mask(erosion_q16: Column) -> Column:
    """Log-domain seed of the quantization map, Q24."""
    # Fixed values, Q24.
    base, mul4, mul2, mul3, mul0 = -12444499, 54279760, 216527232, 84255704, 12542718
    offset2, offset3, offset4, minimum = 5117727744, 36785288, 9196322, 16777
    v = F.greatest(mul_half_up(erosion_q16, mul0, 16), lit(minimum))
    square = mul_floor_shift_add(v, v, 24)

    def term(multiplier: int, d: Column) -> Column:
        return int_div(lit(multiplier << 24) + int_div(d, 2), d)

    return lit(base) + term(mul4, square + lit(offset4)) + term(mul2, v + lit(offset2)) + term(mul3, square + lit(offset3))


def mul_half_up(a: Column, multiplier: int, n: int) -> Column:
    return half_up_shift(a * lit(multiplier), n)


def mul_floor_shift_add(a: Column, b: Column, n: int) -> Column:
    """(a*b + half) >> n, exact beyond 63 bits."""
    d = "decimal(38,0)"
    product = (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(d) + F.lit(1 << (n - 1)).cast(d)
    return F.when(fits_product(a, b), half_up_shift(a * b, n)).otherwise(wide_floor_shift(product.cast(d), n))


def hf_modulation(seed: Column, edge_sum: Column) -> Column:
    return saturate32(seed - half_up_shift(edge_sum * lit(HF_MULTIPLIER_Q32), 20))


def red_coverage(x_q12: Column) -> Column:
    return F.least(F.greatest(F.shiftleft(x_q12, 4) - lit(RED_START_Q16), lit(0)), lit(RED_LENGTH_Q16))


def blue_coverage(y_q12: Column, b_q12: Column) -> Column:
    return F.least(F.greatest(F.shiftleft(b_q12 - y_q12, 4) - lit(BLUE_START_Q16), lit(0)), lit(BLUE_LENGTH_Q16))


def color_modulation(seed: Column, distance_q8: Column, red: Column, blue: Column) -> Column:
    """Distances of 4 and above leave the seed unchanged."""
    strength = F.greatest(lit(1024) - distance_q8, lit(0))
    folded = lambda value: half_up_shift(lit(value) * strength, 10)
    red_term = half_up_shift(F.least(red, lit(RED_CAP_Q16)) * folded(RED_COEFFICIENT_Q24), 16)
    blue_term = half_up_shift(F.least(blue, lit(BLUE_CAP_Q16)) * folded(BLUE_COEFFICIENT_Q24), 16)
    return F.when(strength == 0, seed).otherwise(
        saturate32(seed - folded(COLOR_BASELINE_Q24) + red_term + blue_term)
    )


def inverse_gamma_ratio(value_q12: Column) -> Column:
    tables = curves.inverse_gamma()
    v = clamp(value_q12, 0, 8 << 12)
    return (
        F.when(v <= 256, lookup(tables["fine"], F.least(v, lit(256))))
        .when(v <= 4096, _interpolate(tables["coarse"], clamp(v - 256, 0, 3840), 4))
        .otherwise(_interpolate(tables["hdr"], F.greatest(v - 4096, lit(0)), 6))
    )


def fast_log2(value_q20: Column) -> Column:
    table = curves.log2_mantissa()
    lead = bit_length(value_q20) - 1
    normalized = F.when(lead <= 20, shift_left_by(value_q20, F.greatest(20 - lead, lit(0)))).otherwise(
        shift_right_by(value_q20, F.greatest(lead - 20, lit(0)))
    )
    relative = normalized - lit(1 << 20)
    cell = F.shiftright(relative, 12)
    part = relative.bitwiseAND(lit(4095))
    mantissa = half_up_shift(lookup(table, cell) * (lit(4096) - part) + lookup(table, cell + 1) * part, 12)
    return F.shiftleft(lead - 20, 20) + mantissa


def gamma_modulation(seed: Column, ratio_sum: Column) -> Column:
    average = F.shiftright(ratio_sum + 64, 7)
    return saturate32(seed + half_away_shift(fast_log2(average) * lit(GAMMA_MULTIPLIER_Q24), 20))


def fast_exp(seed_q24: Column) -> Column:
    table = curves.pow2_mantissa()
    log2 = half_away_shift(seed_q24 * lit(LOG2E_Q24), 24)
    exponent = F.shiftright(log2, 24)
    fraction = log2 - F.shiftleft(exponent, 24)
    cell = F.shiftright(fraction, 16)
    part = fraction.bitwiseAND(lit(0xFFFF))
    mantissa = half_up_shift(lookup(table, cell) * (lit(1 << 16) - part) + lookup(table, cell + 1) * part, 16)
    down = clamp(-exponent, 1, 27)
    shifted = (
        F.when(exponent >= 0, F.when(exponent > 8, lit(UINT32_MAX)).otherwise(
            shift_left_by(mantissa, clamp(exponent, 0, 8))))
        .when(exponent < -26, lit(0))
        .otherwise(shift_right_by(mantissa + shift_left_by(lit(1), down - 1), down))
    )
    return F.least(shifted, lit(UINT32_MAX))


def final_map(seed_q24: Column, scale_q24: Column, dampen_q24: Column) -> Column:
    """exp(seed) * scale * dampen + (1 - dampen) * scale / 2, saturated to 32 unsigned bits."""
    times = lambda a, b: F.least(mul_floor_shift_add(a, b, 24), lit(UINT32_MAX))
    multiplier = times(scale_q24, dampen_q24)
    add = times(lit(1 << 24) - dampen_q24, F.shiftright(scale_q24 + 1, 1))
    return F.least(times(fast_exp(seed_q24), multiplier) + add, lit(UINT32_MAX))


def raw_quant(map_q24: Column, inv_global_q24: Column) -> Column:
    return clamp(mul_floor_shift_add(map_q24, inv_global_q24, 48), 1, 255)


def inverse_ac_scale(scale_q16: Column, quant: Column) -> Column:
    """round(2^32 / (scale * quant)); a zero divisor saturates."""
    d = scale_q16 * quant
    safe = F.greatest(d, lit(1))
    return F.when(d == 0, lit(UINT32_MAX)).otherwise(
        F.least(int_div(lit(1 << 32) + int_div(safe, 2), safe), lit(UINT32_MAX))
    )

