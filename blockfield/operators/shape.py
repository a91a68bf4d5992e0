"""Transform-shape choice per 2x2 block region and the quant-field adjustment that follows it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions import curves, quant
from blockfield.functions.fixed import UINT32_MAX, half_up_shift, isqrt, lit, lookup, wide_floor_div, wide_isqrt
from blockfield.functions.masks import mul_floor_shift_add
from blockfield.operators.cfl import tile_columns
from blockfield.operators.geometry import BLOCK_KEYS, with_geometry
from blockfield.operators.params import with_shape_cost

PLANES = ("x", "y", "b")
REGION = ["frame_id", "stripe", "rx", "ry"]
#: What a candidate adds to the coefficients of its block.
CARRIED = ("raw_strategy", "cq", "cm", "ytox", "ytob")


def complete_regions(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Blocks whose 2x2 region lies wholly inside the frame (and so inside one tile); adds rx, ry, x_blocks."""
    shape = with_geometry(frames).select("frame_id", "x_blocks", "y_blocks")
    return (
        blocks.join(shape, "frame_id").withColumn("rx", F.shiftright("bx", 1)).withColumn("ry", F.shiftright("by", 1))
        .where((F.col("rx") * 2 + 1 < F.col("x_blocks")) & (F.col("ry") * 2 + 1 < F.col("y_blocks")))
    )


def candidate_fields(blocks: DataFrame, tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """(BLOCK_KEYS, raw_strategy, cq, cm, ytox, ytob): the maxima of the quantization map and mask over each
    candidate's cells, for eight candidates per region."""
    right = Window.partitionBy(*REGION, "by").orderBy("bx")
    below = Window.partitionBy(*REGION, "bx").orderBy("by")
    fields = complete_regions(blocks.select(*BLOCK_KEYS, "aq_map_q24", "mask_q16"), frames).select(
        "*", *tile_columns(),
        *[F.lead(c).over(w).alias(f"{c}_{n}") for c in ("aq_map_q24", "mask_q16") for n, w in (("r", right), ("d", below))],
    )
    member = lambda s, q, m: F.struct(lit(s).alias("raw_strategy"), q.alias("cq"), m.alias("cm"))
    most = lambda c, n: F.greatest(F.col(c), F.col(f"{c}_{n}"))
    entries = F.array(
        member(C.DCT, F.col("aq_map_q24"), F.col("mask_q16")),
        member(C.DCT16X8, most("aq_map_q24", "d"), most("mask_q16", "d")),
        member(C.DCT8X16, most("aq_map_q24", "r"), most("mask_q16", "r")),
    )
    each = fields.select(*BLOCK_KEYS, "tile_x", "tile_y", F.inline(entries)).where(
        (F.col("raw_strategy") == C.DCT)
        | ((F.col("raw_strategy") == C.DCT16X8) & (F.col("by") % 2 == 0))
        | ((F.col("raw_strategy") == C.DCT8X16) & (F.col("bx") % 2 == 0))
    )
    return each.join(tiles.select("frame_id", "stripe", "tile_x", "tile_y", "ytox", "ytob"),
                     ["frame_id", "stripe", "tile_x", "tile_y"]).drop("tile_x", "tile_y")


def scaled_magnitude(residual: Column, weight: Column, shift: int) -> Column:
    """round(|residual| * weight / 2^shift), ties up.

    The product has up to 88 bits in practice: two limbs per operand keep it in longs, DECIMAL takes the rest.
    """
    r, p = F.abs(residual), weight
    rh, rl = F.shiftright(r, 26), r.bitwiseAND(lit((1 << 26) - 1))
    ph, pl = F.shiftright(p, 28), p.bitwiseAND(lit((1 << 28) - 1))
    middle = F.shiftright(rl * pl, 26) + rh * pl + F.shiftleft(rl * ph, 2)
    limbs = F.shiftright(F.shiftleft(rh * ph, 28) + middle + lit(1 << (shift - 27)), shift - 26)
    d = "decimal(38,0)"
    product = (r.cast("decimal(19,0)") * p.cast("decimal(19,0)")).cast(d)
    half = F.expr(f"cast('{1 << (shift - 1)}' as {d})")
    whole = F.least(wide_floor_div((product + half).cast(d), shift), F.expr(f"cast('{1 << 50}' as {d})")).cast("bigint")
    safe = (r < (1 << 52)) & (p < (1 << 56)) & (r.cast("double") * p.cast("double") < float(1 << 87))
    return F.when(safe, limbs).otherwise(whole)


def coefficient_costs(coefficients: DataFrame, fraction_bits: int) -> DataFrame:
    """Per-coefficient loss and entropy terms summed per candidate; adds nnz per plane."""
    keys = [*BLOCK_KEYS, "raw_strategy", "cm"]
    factors = {"x": quant.cfl_factor(F.col("ytox"), 0), "y": lit(0), "b": quant.cfl_factor(F.col("ytob"), 1 << 16)}
    channel = {"x": C.X, "y": C.Y, "b": C.B}
    staged = coefficients.select(
        *keys,
        *[(F.shiftleft(F.col(p), 16) - F.col("y") * factors[p]).alias(f"_r{p}") for p in PLANES],
        *[(quant.inverse_weight(channel[p], F.col("k"), F.col("raw_strategy")) * F.col("cq")).alias(f"_w{p}") for p in PLANES],
    )
    staged = staged.select(
        *keys, *[scaled_magnitude(F.col(f"_r{p}"), F.col(f"_w{p}"), fraction_bits + 40).alias(f"_m{p}") for p in PLANES]
    )
    whole = lambda p: F.shiftright(F.col(f"_m{p}"), 16)
    part = lambda p: F.col(f"_m{p}").bitwiseAND(lit(0xFFFF))
    round_up = lambda p: ((part(p) > 0x8000) | ((part(p) == 0x8000) & (whole(p) % 2 == 1))).cast("bigint")
    staged = staged.select(
        *keys,
        *[(whole(p) + round_up(p)).alias(f"_n{p}") for p in PLANES],
        *[F.when(part(p) > 0x8000, 65536 - part(p)).otherwise(part(p)).alias(f"_l{p}") for p in PLANES],
    )

    def entropy(p: str) -> Column:
        n = F.least(F.col(f"_n{p}"), lit(UINT32_MAX))
        near = isqrt(F.shiftleft(F.least(n, lit(1 << 29)), 32))
        far = wide_isqrt((n.cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(19,0)")).cast("decimal(38,0)"))
        root = F.when(n < (1 << 29), near).otherwise(far)
        return half_up_shift(root * lit(C.COST_DELTA_Q16), 16) + F.when(n >= 2, lit(C.COST2_Q16)).otherwise(lit(0))

    plus = lambda terms: terms[0] + terms[1] + terms[2]
    return staged.groupBy(*keys).agg(
        F.sum(plus([entropy(p) for p in PLANES])).alias("entropy"),
        F.sum(plus([F.col(f"_l{p}") for p in PLANES])).alias("loss"),
        F.sum(plus([F.col(f"_l{p}") * F.col(f"_l{p}") for p in PLANES])).alias("loss2"),
        *[F.count_if(F.col(f"_n{p}") != 0).alias(f"nnz_{p}") for p in PLANES],
        F.max(F.greatest(*[F.col(f"_n{p}") for p in PLANES]) > UINT32_MAX).alias("overflow"),
    )


def candidate_costs(sums: DataFrame, frames: DataFrame) -> DataFrame:
    """(BLOCK_KEYS, raw_strategy, estimate_q16, cost_q16, overflow, supported)."""
    square = F.col("raw_strategy") == C.DCT
    nbits = curves.nbits_cost()
    params = with_shape_cost(frames).select("frame_id", "cost1_q16", "dct_multiplier_q16", "rect_multiplier_q16", "supported")
    announced = [F.col(f"nnz_{p}") * F.col("cost1_q16") + lookup(nbits, F.col(f"nnz_{p}")) for p in PLANES]
    rows = sums.join(params, "frame_id").withColumn("_root", isqrt(F.col("loss2") * F.when(square, lit(1)).otherwise(lit(2))))
    rows = rows.withColumn(
        "_score", F.col("loss") * C.INFO_LOSS_MULTIPLIER + half_up_shift(F.col("_root") * lit(C.INFO_LOSS2_MULTIPLIER_Q16), 16)
    )
    rows = rows.withColumn(
        "estimate_q16", F.col("entropy") + announced[0] + announced[1] + announced[2]
        + mul_floor_shift_add(F.col("cm"), F.col("_score"), 16),
    )
    biased = F.col("estimate_q16") + F.when(square, lit(3 << 16)).otherwise(lit(0))
    outer = F.when(square, F.col("dct_multiplier_q16")).otherwise(F.col("rect_multiplier_q16"))
    return rows.select(
        *BLOCK_KEYS, "raw_strategy", "estimate_q16", mul_floor_shift_add(biased, outer, 16).alias("cost_q16"),
        "overflow", "supported",
    )


def decide(costs: DataFrame) -> DataFrame:
    """(frame_id, stripe, bx, by, code, overflow, unsupported_distance) for every block of a complete region.

    Vertical wins the region only when strictly cheaper in total; a rectangle replaces its two 8x8 blocks only
    when strictly cheaper than both together.
    """
    rows = costs.withColumn("rx", F.shiftright("bx", 1)).withColumn("ry", F.shiftright("by", 1))
    odd_x, odd_y = F.col("bx") % 2, F.col("by") % 2
    slot = F.when(F.col("raw_strategy") == C.DCT, odd_y * 2 + odd_x).when(
        F.col("raw_strategy") == C.DCT16X8, odd_x + 4
    ).otherwise(odd_y + 6)
    region = rows.withColumn("_slot", slot).groupBy(*REGION).agg(
        *[F.max(F.when(F.col("_slot") == i, F.col("cost_q16"))).alias(f"k{i}") for i in range(8)],
        F.max("overflow").alias("overflow"), (~F.min("supported")).alias("unsupported_distance"),
    )
    k = [F.col(f"k{i}") for i in range(8)]
    stacked = [k[0] + k[2], k[1] + k[3]]
    paired = [k[0] + k[1], k[2] + k[3]]
    vertical = F.least(k[4], stacked[0]) + F.least(k[5], stacked[1])
    horizontal = F.least(k[6], paired[0]) + F.least(k[7], paired[1])
    tall = [(vertical < horizontal) & (k[4 + i] < stacked[i]) for i in (0, 1)]
    flat = [(vertical >= horizontal) & (k[6 + i] < paired[i]) for i in (0, 1)]

    def cell(x: int, y: int) -> Column:
        code = F.when(tall[x], lit(3 - y)).when(flat[y], lit(5 - x)).otherwise(lit(1))
        return F.struct((F.col("rx") * 2 + x).alias("bx"), (F.col("ry") * 2 + y).alias("by"), code.alias("code"))

    return region.select(
        "frame_id", "stripe", "overflow", "unsupported_distance",
        F.inline(F.array(*[cell(x, y) for y in (0, 1) for x in (0, 1)])),
    )


def candidate_members(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, rx, ry, candidate, block): the blocks (frame_id, rx, ry, block) of complete regions by the eight candidates that
    cover them: 0-3 the 8x8 blocks, 4 and 5 the vertical pairs, 6 and 7 the horizontal ones."""
    at = blocks.join(with_geometry(frames).select("frame_id", F.col("x_blocks").alias("_w")), "frame_id")
    mx, my = (F.col("block") % F.col("_w")) % 2, F.floor(F.col("block") / F.col("_w")) % 2
    covering = F.array(my * 2 + mx, mx + 4, my + 6)
    return at.select("frame_id", "rx", "ry", F.explode(covering).alias("candidate"), "block")


def ranked_candidates(costs: DataFrame) -> DataFrame:
    """Add rank: the candidates of a region by cost, equal ones by shape and raster position."""
    region = Window.partitionBy("frame_id", "stripe", F.shiftright("bx", 1), F.shiftright("by", 1)).orderBy("cost_q16", "raw_strategy", "by", "bx")
    return costs.withColumn("rank", F.row_number().over(region).cast("bigint"))


def strategy_map(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every block of the frame with its code; blocks outside complete regions stay 8x8."""
    keys = ["frame_id", "stripe", "bx", "by"]
    return blocks.join(decisions, keys, "left").select(
        *[c for c in blocks.columns], F.coalesce("code", lit(1)).alias("code"),
        F.coalesce("overflow", F.lit(False)).alias("overflow"),
        F.coalesce("unsupported_distance", F.lit(False)).alias("unsupported_distance"),
    )


def shape_rejects(cells: DataFrame) -> DataFrame:
    """(frame_id, rule, detail): blocks whose shape was decided on capped costs or without a supported distance, by frame."""
    rules = F.array(F.when(F.col("overflow"), F.lit("cost_overflow")), F.when(F.col("unsupported_distance"), F.lit("unsupported_distance")))
    hit = cells.where(F.col("overflow") | F.col("unsupported_distance"))
    return hit.select("frame_id", F.explode(F.array_compact(rules)).alias("rule")).groupBy("frame_id", "rule").agg(F.count(F.lit(1)).cast("string").alias("detail"))


def owner_of(x_blocks: Column) -> Column:
    """Raster block of the owner that covers a cell, from the cell's own code."""
    return F.col("block") - F.when(F.col("code") == 4, lit(1)).when(F.col("code") == 2, x_blocks).otherwise(lit(0))


def adjust_quant_field(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Raise raw_quant to the maximum of its owner's cells; needs (frame_id, block, code, raw_quant).

    The owner is column arithmetic on the code, so the maximum runs over groups of one or two rows.
    """
    local = ["frame_id", "stripe"] if "stripe" in cells.columns else ["frame_id"]
    shaped = cells.join(with_geometry(frames).select("frame_id", "x_blocks"), "frame_id")
    owned = shaped.withColumn("owner", owner_of(F.col("x_blocks")))
    return owned.withColumn("raw_quant", F.max("raw_quant").over(Window.partitionBy(*local, "owner"))).drop("x_blocks")
