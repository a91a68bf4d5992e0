"""Plain integer models used as a second opinion on small fixtures."""

import math

from blockfield.functions import constants as C
from blockfield.functions import curves, masks


def half_up(v, n):
    return (v + (1 << (n - 1))) >> n


def away(v, n):
    return v if n == 0 else (half_up(v, n) if v >= 0 else -half_up(-v, n))


def dct(values, bits):
    n = len(values)
    if n == 2:
        return [values[0] + values[1], values[0] - values[1]]
    k = curves.transform_constants(bits)
    h = n // 2
    even = dct([values[i] + values[n - 1 - i] for i in range(h)], bits)
    odd = dct([((values[i] - values[n - 1 - i]) * k[n][i]) >> bits for i in range(h)], bits)
    odd[0] = ((odd[0] * k["sqrt2"]) >> bits) + odd[1]
    for i in range(1, h - 1):
        odd[i] += odd[i + 1]
    return [v for pair in zip(even, odd) for v in pair]


def dct_block(samples, rows, cols, bits, guard):
    """samples[y][x] -> coefficient list in canonical order."""
    scaled = [[v << guard for v in row] for row in samples]
    ry, rx = rows.bit_length() - 1, cols.bit_length() - 1
    first = [[v >> ry for v in dct([scaled[y][x] for y in range(rows)], bits + guard)] for x in range(cols)]
    second = [[v >> rx for v in dct([first[x][fy] for x in range(cols)], bits + guard)] for fy in range(rows)]
    if cols == 16:
        order = [(fy, fx) for fy in range(rows) for fx in range(cols)]
    else:
        order = [(fy, fx) for fx in range(cols) for fy in range(rows)]
    return [away(second[fy][fx], guard) for fy, fx in order]


def contrast(sx, sy):
    d40 = sy * sy + half_up(sx * sx * masks.CONTRAST_X_MULTIPLIER_Q16, 16)
    masking = min(half_up(d40, 16) * masks.CONTRAST_SQRT_MULTIPLIER_Q16 + masks.CONTRAST_OFFSET_Q40, masks.CONTRAST_INPUT_MAX)
    return min(half_up(math.isqrt(masking), 6), masks.INT31_MAX)


def quantize_level(c, inverse, scale, quant, qm, threshold, bits):
    v = (((c * inverse) >> 16) * scale * quant * qm) >> 32
    return away(v, bits) if abs(v) >= threshold << (bits - 12) else 0


def ac_stream(levels, predicted, channel):
    """(context, value) of one 8x8 plane."""
    ctx = C.BLOCK_CONTEXT_SQUARE[channel]
    nnz = sum(1 for v in levels[1:] if v)
    bucket = predicted if predicted < 8 else 36 if predicted >= 64 else 4 + predicted // 2
    out = [(bucket * 4 + ctx, nnz)]
    left, prev, p = nnz, int(nnz <= 4), 1
    while left:
        v = levels[C.SCAN_SQUARE[p]]
        density = 2 * (C.COEFF_NONZERO_CONTEXT[left] + C.COEFF_FREQ_CONTEXT[p]) + prev
        out.append((148 + 458 * ctx + density, 2 * v if v >= 0 else -2 * v - 1))
        left, prev, p = left - (v != 0), int(v != 0), p + 1
    return out
