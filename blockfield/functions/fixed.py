"""Fixed-point arithmetic as Column expressions.

BIGINT carries every value.  Where a product may leave 63 bits the helper tests the
operands first: the common case stays on primitive longs inside generated code and only
the rare rest pays for an exact DECIMAL(38,0).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MIN, INT32_MAX = -(1 << 31), (1 << 31) - 1
UINT32_MAX = (1 << 32) - 1
LONG_MAX = (1 << 63) - 1


def lit(value: int) -> Column:
    return F.expr(f"{value}L")


def int_div(a: Column, b) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else lit(b))


def floor_shift(x: Column, n: int) -> Column:
    """Arithmetic shift right; a negative ``n`` shifts left."""
    if n == 0:
        return x
    return F.shiftright(x, n) if n > 0 else F.shiftleft(x, -n)


def half_up_shift(x: Column, n: int) -> Column:
    """Add one half, then floor (also for negatives)."""
    return F.shiftright(x + lit(1 << (n - 1)), n)


def half_away_shift(x: Column, n: int) -> Column:
    """Round to nearest, ties away from zero."""
    if n == 0:
        return x
    magnitude = F.shiftright(F.abs(x) + lit(1 << (n - 1)), n)
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def half_away_div(x: Column, d) -> Column:
    """Signed division by a positive ``d``, ties away from zero."""
    d = d if isinstance(d, Column) else lit(d)
    magnitude = int_div(F.abs(x) + int_div(d, 2), d)
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def clamp(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else lit(lo)
    hi = hi if isinstance(hi, Column) else lit(hi)
    return F.least(F.greatest(x, lo), hi)


def saturate32(x: Column) -> Column:
    return clamp(x, INT32_MIN, INT32_MAX)


def lookup(values, index: Column) -> Column:
    """Zero-based read from a fixed table; the cast text folds to one array constant."""
    table = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.get(table, index.cast("int"))


def sign_extend(x: Column, bits: int) -> Column:
    return F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)


def swap_bytes(x: Column, size: int) -> Column:
    """Reverse the byte order of an unsigned value of 2 or 4 bytes."""
    byte = lambda i: F.shiftright(x, 8 * i).bitwiseAND(lit(0xFF))
    out = F.shiftleft(byte(0), 8 * (size - 1))
    for i in range(1, size):
        out = out.bitwiseOR(F.shiftleft(byte(i), 8 * (size - 1 - i)))
    return out


def shift_right_by(x: Column, n: Column) -> Column:
    """Shift by a per-row distance in 0..63."""
    return F.call_function("shiftright", x, n.cast("int"))


def shift_left_by(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def bit_length(x: Column) -> Column:
    """Position of the leading one plus one, for x > 0."""
    return F.length(F.bin(x)).cast("bigint")


def wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def wide_floor_div(x: Column, n: int) -> Column:
    """Floor division of a DECIMAL(38,0) by 2^n; the division is exact once the remainder is gone."""
    d = F.expr(f"cast('{1 << n}' as decimal(38,0))")
    return ((x - F.pmod(x, d)) / d).cast("decimal(38,0)")


def wide_floor_shift(x: Column, n: int) -> Column:
    return wide_floor_div(x, n).cast("bigint")


def fits_product(a: Column, b: Column) -> Column:
    """True where a * b certainly stays inside 62 bits."""
    return F.abs(a).cast("double") * F.abs(b).cast("double") < F.lit(float(1 << 62))


def mul_floor_shift(a: Column, b: Column, n: int) -> Column:
    """floor(a * b / 2^n), exact for any BIGINT operands."""
    return F.when(fits_product(a, b), floor_shift(a * b, n)).otherwise(
        wide_floor_shift(wide_product(a, b), n)
    )


def mul_half_away_shift(a: Column, b: Column, n: int) -> Column:
    """a * b / 2^n rounded to nearest, ties away from zero, exact for any BIGINT operands."""
    product = wide_product(a, b)
    magnitude = wide_floor_shift(F.abs(product) + F.expr(f"cast('{1 << (n - 1)}' as decimal(38,0))"), n)
    return F.when(fits_product(a, b), half_away_shift(a * b, n)).otherwise(
        F.when(product < 0, -magnitude).otherwise(magnitude)
    )


def wide_product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def isqrt(x: Column) -> Column:
    """Exact floor square root of a BIGINT in 0..2^62."""
    r = F.floor(F.sqrt(x.cast("double")))
    return r - F.when(r * r > x, 1).otherwise(0) + F.when((r + 1) * (r + 1) <= x, 1).otherwise(0)


def wide_isqrt(x: Column) -> Column:
    """Exact floor square root of a DECIMAL(38,0) below 2^100."""
    r = F.floor(F.sqrt(x.cast("double"))).cast("decimal(19,0)")
    one = F.lit(1).cast("decimal(19,0)")
    up = (r + one).cast("decimal(19,0)")
    return (
        r.cast("bigint")
        - F.when((r * r).cast("decimal(38,0)") > x, 1).otherwise(0)
        + F.when((up * up).cast("decimal(38,0)") <= x, 1).otherwise(0)
    )


def pack_signed(x: Column) -> Column:
    """Zigzag: 0, -1, 1, -2, ... -> 0, 1, 2, 3, ..."""
    return F.when(x < 0, -2 * x - 1).otherwise(2 * x)


def unpack_signed(x: Column) -> Column:
    return F.when(x % 2 == 1, -int_div(x + 1, 2)).otherwise(int_div(x, 2))
