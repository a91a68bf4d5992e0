"""Integer scaled DCTs as two relational passes.

A pass runs the butterfly on one line per row: eight or sixteen samples of each plane are columns, every
intermediate is a column, and all of it compiles into one stage.  Between the passes the lines of a block are
turned by a grouping inside the (frame_id, stripe) partitioning, so a transform never shuffles.

The butterfly truncates after every multiply, which is why it is not a matrix product.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions.curves import transform_constants
from blockfield.functions.fixed import half_away_shift, lit
from blockfield.functions import constants as C
from blockfield.operators.geometry import BLOCK_KEYS

PLANES = ("x", "y", "b")


class _Steps:
    """Collects ``name := expression`` steps and the dependency level each one belongs to."""

    def __init__(self, bits: int):
        self.bits = bits
        self.constants = transform_constants(bits)
        self.level = {}
        self.steps = []

    def let(self, expression: str, *inputs: str) -> str:
        name = f"t{len(self.steps)}"
        self.level[name] = 1 + max(self.level[i] for i in inputs)
        self.steps.append((name, expression, inputs))
        return name

    def scale(self, value: str, constant: int) -> str:
        """floor(value * constant / 2^bits); high precisions split the operand so nothing leaves 63 bits."""
        if self.bits <= 14:
            return f"shiftright(({value})*{constant}L,{self.bits})"
        low = f"shiftright((({value})&16383L)*{constant}L,14)"
        return f"shiftright(shiftright({value},14)*{constant}L+{low},{self.bits - 14})"


def _butterfly(s: _Steps, v: list) -> list:
    n = len(v)
    if n == 2:
        return [s.let(f"{v[0]}+{v[1]}", *v), s.let(f"{v[0]}-{v[1]}", *v)]
    pairs = [(v[i], v[n - 1 - i]) for i in range(n // 2)]
    even = _butterfly(s, [s.let(f"{a}+{b}", a, b) for a, b in pairs])
    differences = [s.let(f"{a}-{b}", a, b) for a, b in pairs]
    odd = _butterfly(s, [s.let(s.scale(d, s.constants[n][i]), d) for i, d in enumerate(differences)])
    folded = [s.let(f"{s.scale(odd[0], s.constants['sqrt2'])}+{odd[1]}", odd[0], odd[1])]
    folded += [s.let(f"{odd[i]}+{odd[i + 1]}", odd[i], odd[i + 1]) for i in range(1, n // 2 - 1)]
    folded.append(odd[-1])
    return [value for pair in zip(even, folded) for value in pair]


def transform_lines(lines: DataFrame, keys: list, n: int, bits: int) -> DataFrame:
    """One pass over rows with an n-sample array per plane; arrays of n scaled frequencies come back."""
    s = _Steps(bits)
    for p in PLANES:
        s.level |= {f"{p}{i}": 0 for i in range(n)}
    log2n = n.bit_length() - 1
    out = {
        p: [s.let(f"shiftright({t},{log2n})", t) for t in _butterfly(s, [f"{p}{i}" for i in range(n)])]
        for p in PLANES
    }
    depth = max(s.level.values())
    live = [set() for _ in range(depth + 1)]
    uses = [(inputs, s.level[name]) for name, _, inputs in s.steps] + [(out[p], depth + 1) for p in PLANES]
    for inputs, at in uses:
        for i in inputs:
            for level in range(s.level[i], min(at, depth + 1)):
                live[level].add(i)

    key_list = ", ".join(keys)
    query = f"SELECT {key_list}, " + ", ".join(f"{p}[{i}] AS {p}{i}" for p in PLANES for i in range(n)) + " FROM {lines}"
    steps = {name: expression for name, expression, _ in s.steps}
    for level in range(1, depth + 1):
        names = sorted(live[level])
        items = [f"{steps[v]} AS {v}" if s.level[v] == level else v for v in names]
        query = f"SELECT {key_list}, {', '.join(items)} FROM ({query})"
    query = f"SELECT {key_list}, " + ", ".join(f"array({', '.join(out[p])}) AS {p}" for p in PLANES) + f" FROM ({query})"
    return lines.sparkSession.sql(query, lines=lines)


def turn(lines: DataFrame, keys: list, at: str, out: str, n_in: int, n_out: int) -> DataFrame:
    """Transpose: rows (keys, at) with n_in-arrays become rows (keys, out) with n_out-arrays."""
    entries = F.array(*[F.struct(lit(i).alias(out), *[F.col(p)[i].alias(p) for p in PLANES]) for i in range(n_in)])
    flat = lines.select(*keys, at, F.inline(entries))
    wide = flat.groupBy(*keys, out).agg(
        *[F.max(F.when(F.col(at) == i, F.col(p))).alias(f"{p}{i}") for p in PLANES for i in range(n_out)]
    )
    return wide.select(*keys, out, *[F.array(*[f"{p}{i}" for i in range(n_out)]).alias(p) for p in PLANES])


def _guarded(columns: DataFrame, bits: int, guard_bits: int) -> DataFrame:
    planes = [
        F.transform(F.col(f"{p}_q{bits}"), lambda v: F.shiftleft(v, guard_bits)).alias(p) if guard_bits
        else F.col(f"{p}_q{bits}").alias(p)
        for p in PLANES
    ]
    return columns.select(*BLOCK_KEYS, "col", *planes)


def _coefficients(lines: DataFrame, keys: list, line: str, n: int, index: Column, guard_bits: int) -> DataFrame:
    entries = F.array(*[F.struct(lit(i).alias("_i"), *[F.col(p)[i].alias(p) for p in PLANES]) for i in range(n)])
    flat = lines.select(*keys, line, F.inline(entries))
    return flat.select(*keys, index.alias("k"), *[half_away_shift(F.col(p), guard_bits).alias(p) for p in PLANES])


def column_pass(columns: DataFrame, bits: int, guard_bits: int = 0) -> DataFrame:
    """Vertical frequencies of every block, one row per frequency ``fy`` with the eight columns as arrays."""
    first = transform_lines(_guarded(columns, bits, guard_bits), [*BLOCK_KEYS, "col"], 8, bits + guard_bits)
    return turn(first, BLOCK_KEYS, "col", "fy", 8, 8)


def _only(rows: DataFrame, owners) -> DataFrame:
    """Keep the rows of the given owner blocks; both sides are already partitioned by (frame_id, stripe)."""
    if owners is None:
        return rows
    return rows.join(owners.select("frame_id", "stripe", "block"), ["frame_id", "stripe", "block"], "left_semi")


def block_lines(columns: DataFrame, bits: int = 12, guard_bits: int = 0) -> DataFrame:
    """8x8 blocks after both passes: a row per vertical frequency ``fy`` with eight coefficients a plane."""
    return transform_lines(column_pass(columns, bits, guard_bits), [*BLOCK_KEYS, "fy"], 8, bits + guard_bits)


def horizontal_lines(columns: DataFrame, bits: int = 12, guard_bits: int = 0, owners: DataFrame = None) -> DataFrame:
    """8-row x 16-column blocks after both passes, of every even block column with a right neighbour: a row per ``fy``."""
    across = Window.partitionBy("frame_id", "stripe", "by", "fy").orderBy("bx")
    pairs = column_pass(columns, bits, guard_bits).select(
        *BLOCK_KEYS, "fy", *[F.concat(F.col(p), F.lead(p).over(across)).alias(p) for p in PLANES]
    )
    pairs = _only(pairs.where((F.col("bx") % 2 == 0) & F.col("x").isNotNull()), owners)
    return transform_lines(pairs, [*BLOCK_KEYS, "fy"], 16, bits + guard_bits)


def vertical_lines(columns: DataFrame, bits: int = 12, guard_bits: int = 0, owners: DataFrame = None) -> DataFrame:
    """16-row x 8-column blocks after both passes, of every even block row with a block below: a row per ``fy``."""
    down = Window.partitionBy("frame_id", "stripe", "bx", "col").orderBy("by")
    pairs = _guarded(columns, bits, guard_bits).select(
        *BLOCK_KEYS, "col", *[F.concat(F.col(p), F.lead(p).over(down)).alias(p) for p in PLANES]
    )
    pairs = _only(pairs.where((F.col("by") % 2 == 0) & F.col("x").isNotNull()), owners)
    first = transform_lines(pairs, [*BLOCK_KEYS, "col"], 16, bits + guard_bits)
    return transform_lines(turn(first, BLOCK_KEYS, "col", "fy", 16, 8), [*BLOCK_KEYS, "fy"], 8, bits + guard_bits)


#: By shape, how many coefficients a line holds and where they stand in the block.
LINES = {
    C.DCT: (8, lambda: F.col("_i") * 8 + F.col("fy")), C.DCT8X16: (16, lambda: F.col("fy") * 16 + F.col("_i")), C.DCT16X8: (8, lambda: F.col("_i") * 16 + F.col("fy")),
}


def coefficients_of(lines: DataFrame, code: int, guard_bits: int = 0, carried: tuple = ()) -> DataFrame:
    """(BLOCK_KEYS, *carried, k, x, y, b) of the lines of one shape."""
    n, index = LINES[code]
    return _coefficients(lines, [*BLOCK_KEYS, *carried], "fy", n, index(), guard_bits)


def block_transform(columns: DataFrame, bits: int = 12, guard_bits: int = 0, owners: DataFrame = None) -> DataFrame:
    """8x8 coefficients: (BLOCK_KEYS, k, x, y, b) with k = horizontal frequency * 8 + vertical frequency."""
    return coefficients_of(block_lines(_only(columns, owners), bits, guard_bits), C.DCT, guard_bits)


def horizontal_transform(columns: DataFrame, bits: int = 12, guard_bits: int = 0, owners: DataFrame = None) -> DataFrame:
    """8-row x 16-column coefficients of every even block column with a right neighbour; k = fy * 16 + fx."""
    return coefficients_of(horizontal_lines(columns, bits, guard_bits, owners), C.DCT8X16, guard_bits)


def vertical_transform(columns: DataFrame, bits: int = 12, guard_bits: int = 0, owners: DataFrame = None) -> DataFrame:
    """16-row x 8-column coefficients of every even block row with a block below; k = fx * 16 + fy."""
    return coefficients_of(vertical_lines(columns, bits, guard_bits, owners), C.DCT16X8, guard_bits)


def coefficient_trace(coefficients: DataFrame, stage: int) -> DataFrame:
    """Raster-block trace of 8x8 coefficients: group = block, index = channel * 64 + k."""
    entries = F.array(*[F.struct(lit(c).alias("channel"), F.col(p).alias("value")) for c, p in enumerate(PLANES)])
    return coefficients.select("frame_id", "block", "k", F.inline(entries)).select(
        "frame_id", lit(stage).alias("stage"), F.col("block").alias("group"),
        (F.col("channel") * 64 + F.col("k")).alias("index"), "value",
    )


