"""Lookup tables that follow a formula, generated once on the driver."""

import math
from functools import lru_cache

import numpy as np

from blockfield.functions import constants as C

f32 = np.float32


def _round(value: float) -> int:
    return math.floor(value + 0.5)


def fixed(value: float, bits: int) -> int:
    return _round(value * (1 << bits))


@lru_cache(None)
def cube_root(fraction_bits: int) -> list:
    """Cube roots of 1..8 in steps of 1/64."""
    return [_round(math.cbrt(i / 64) * (1 << fraction_bits)) for i in range(64, 513)]


def _polynomial(x: np.ndarray, coefficients: list, block: int) -> np.ndarray:
    """Coefficients from the constant on, in the precision of x; runs of ``block`` of them are nested first."""
    inner = []
    for at in range(0, len(coefficients), block):
        total = np.zeros_like(x)
        for k in reversed(coefficients[at : at + block]):
            total = total * x + x.dtype.type(k)
        inner.append(total)
    power, total = x**block, np.zeros_like(x)
    for part in reversed(inner):
        total = total * power + part
    return total


def _fixed_table(values: np.ndarray, bits: int) -> list:
    return [_round(float(v) * (1 << bits)) for v in values]


def _gamma_ratio(values, kind, upright: bool) -> np.ndarray:
    """Slope of the masking gamma as a ratio of a square and a cubic in luma, or the inverse of that."""
    log2, scale, divided, back, offset, epsilon = map(kind, (
        C.GAMMA_LOG2, C.GAMMA_SCALE, 1.0 / C.GAMMA_DIVISOR, C.GAMMA_RETURN, C.GAMMA_OFFSET, C.GAMMA_EPSILON))
    slope = divided * back * log2
    x = np.asarray(values, np.float64).astype(np.float64 if kind is float else kind) / kind(4096)
    square = _polynomial(x, [epsilon, 0, slope * kind(3) * scale], 2)
    cubic = _polynomial(x, [offset * log2 + epsilon, 0, 0, log2 * scale], 2)
    return cubic / square if upright else square / cubic


@lru_cache(None)
def contrast_gamma() -> dict:
    """Q16 gamma ratio over Q12 luma: one entry per step to 1/16, every 16 steps to 1, a line above."""
    table = lambda at: _fixed_table(_gamma_ratio(at, float, True), 16)
    one, eight = _gamma_ratio([4096, 32768], float, True).tolist()
    slope = _round((eight - one) / 7.0 * 65536)
    return {"fine": table(range(257)), "coarse": table(range(256, 4097, 16)), "slope": slope, "intercept": _round((one - slope / 65536) * 65536)}


@lru_cache(None)
def inverse_gamma() -> dict:
    """Q20 inverse gamma ratio over Q12 input in three step sizes."""
    table = lambda at: _fixed_table(_gamma_ratio(at, f32, False), 20)
    return {"fine": table(range(257)), "coarse": table(range(256, 4097, 16)), "hdr": table(range(4096, 32769, 64))}


@lru_cache(None)
def log2_mantissa() -> list:
    """Q20 base-2 logarithm of 1..2 in steps of 1/256: a rational fit around 1, for mantissas from 2/3 to 4/3."""
    x = (1 + np.arange(257) / 256).astype(f32)
    up = (x >= f32(4 / 3)).astype(f32)
    t = x / f32(2) ** up - f32(1)
    return [max(0, v) for v in _fixed_table(_polynomial(t, C.LOG2_TOP, 3) / _polynomial(t, C.LOG2_LOW, 3) + up, 20)]


@lru_cache(None)
def pow2_mantissa() -> list:
    """Q24 powers of two of 0..1 in steps of 1/256, by a rational fit on the fraction."""
    x = (np.arange(257) / 256).astype(f32)
    whole = np.floor(x)
    t = x - whole
    return _fixed_table(_polynomial(t, C.POW2_TOP, 4) * f32(2) ** whole / _polynomial(t, C.POW2_LOW, 4), 24)


@lru_cache(None)
def nbits_cost() -> list:
    """Q16 cost of announcing n nonzero coefficients, n = 0..128."""
    ceil_log2 = lambda n: max(n - 1, 0).bit_length()
    costs = []
    for n in range(129):
        nbits = ceil_log2(n + 1) + 1
        costs.append(_round(C.NBITS_MULTIPLIER * (ceil_log2(nbits + 17) + nbits) * 65536))
    return costs


def transform_constants(bits: int) -> dict:
    return {
        "sqrt2": fixed(C.SQRT2, bits),
        4: [fixed(w, bits) for w in C.WC4],
        8: [fixed(w, bits) for w in C.WC8],
        16: [fixed(w, bits) for w in C.WC16],
    }
