"""Quantization of 8x8 blocks and of variable-shape owners.

Input is one row per coefficient index with the three planes side by side, so luma reconstruction and both
chroma residuals are plain column arithmetic.  One grouping per block then collects levels, counts, the
nonzero bit masks in scan order and the last scan position: everything tokenization needs afterwards.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions import quant as Q
from blockfield.functions.fixed import half_up_shift, lit, lookup, shift_left_by
from blockfield.functions.masks import inverse_ac_scale
from blockfield.operators.geometry import BLOCK_KEYS
from blockfield.operators.params import with_distance

PARAMS = ["raw_strategy", "quant", "scale_q16", "inv_qac_q16", "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16",
          "x_qm_q16", "ytox", "ytob"]
PLANES = ("x", "y", "b")
_CHANNEL = {"x": C.X, "y": C.Y, "b": C.B}
_INVERSE_SQUARE = [C.SCAN_SQUARE.index(k) for k in range(64)]
_INVERSE_RECT = [C.SCAN_RECT.index(k) for k in range(128)]


def frame_params(frames: DataFrame) -> DataFrame:
    """Distance parameters per frame in the names quantization uses."""
    return with_distance(frames).select(
        "frame_id", "scale_q16", "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16", "x_qm_q16", "fixed_raw_quant",
        F.col("fixed_inv_qac_q16"),
    )


def adaptive_params(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Per-block parameters from (BLOCK_KEYS, raw_strategy, raw_quant, ytox, ytob).

    An adaptive byte gets its own reciprocal; a fixed byte keeps the frame's.
    """
    fixed = F.col("fixed_raw_quant") != 0
    return blocks.join(frame_params(frames), "frame_id").select(
        *BLOCK_KEYS, "raw_strategy", F.col("raw_quant").alias("quant"), "scale_q16",
        F.when(fixed, F.col("fixed_inv_qac_q16").cast("bigint"))
        .otherwise(inverse_ac_scale(F.col("scale_q16"), F.col("raw_quant"))).alias("inv_qac_q16"),
        "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16", "x_qm_q16", "ytox", "ytob",
    )


def quantize_coefficients(coefficients: DataFrame, fraction_bits: int) -> DataFrame:
    """Add q_x, q_y, q_b and the chroma residuals res_x, res_b; needs the PARAMS columns on every row."""
    k, shape = F.col("k"), F.col("raw_strategy")
    base_step = F.col("scale_q16") * F.col("quant")

    def level(df: DataFrame, source: str, plane: str, qm: Column) -> DataFrame:
        ch = _CHANNEL[plane]
        return (
            df.withColumn("_w", Q.weighted(F.col(source), ch, k, shape))
            .withColumn("_v", Q.scaled(F.col("_w"), base_step * qm))
            .withColumn(f"q_{plane}", Q.dead_zone(F.col("_v"), Q.threshold(ch, k, shape, fraction_bits), fraction_bits))
            .drop("_w", "_v")
        )

    out = level(coefficients, "y", "y", lit(Q.QM_ONE_Q16))
    out = out.withColumn("_luma", Q.reconstruct_luma(F.col("q_y"), k, shape, F.col("inv_qac_q16"), fraction_bits))
    out = out.withColumn("res_x", Q.chroma_residual(F.col("x"), Q.cfl_factor(F.col("ytox"), 0), F.col("_luma")))
    out = out.withColumn("res_b", Q.chroma_residual(F.col("b"), Q.cfl_factor(F.col("ytob"), 1 << 16), F.col("_luma")))
    out = level(out, "res_x", "x", F.col("x_qm_q16"))
    return level(out, "res_b", "b", lit(Q.QM_ONE_Q16)).drop("_luma")


def collect_blocks(levels: DataFrame, fraction_bits: int) -> DataFrame:
    """One row per block or owner.

    q_* are level arrays in coefficient order, dc_* arrays with one level per covered cell, nnz_* counts outside
    the low-frequency corner, nnz_shifted_* the prediction counts, mask_*_lo / mask_*_hi nonzero bits by scan
    position and last_* the last nonzero scan position (null when there is none).
    """
    square = F.col("raw_strategy") == C.DCT
    position = F.when(square, lookup(_INVERSE_SQUARE, F.col("k"))).otherwise(lookup(_INVERSE_RECT, F.col("k")))
    rows = levels.withColumn("_p", position).withColumn("_ac", F.col("k") >= F.when(square, 1).otherwise(2))
    bit = shift_left_by(lit(1), F.col("_p") % 64)
    aggs = [F.array_sort(F.collect_list(F.struct("k", "q_x", "q_y", "q_b"))).alias("_levels")]
    for p in PLANES:
        hit = F.col("_ac") & (F.col(f"q_{p}") != 0)
        source = {"x": "res_x", "y": "y", "b": "res_b"}[p]
        aggs += [
            F.count_if(hit).alias(f"nnz_{p}"),
            F.coalesce(F.bit_or(F.when(hit & (F.col("_p") < 64), bit)), lit(0)).alias(f"mask_{p}_lo"),
            F.coalesce(F.bit_or(F.when(hit & (F.col("_p") >= 64), bit)), lit(0)).alias(f"mask_{p}_hi"),
            F.max(F.when(hit, F.col("_p"))).alias(f"last_{p}"),
            F.max(F.when(F.col("k") == 0, F.col(source))).alias(f"_c0{p}"),
            F.max(F.when(F.col("k") == 1, F.col(source))).alias(f"_c1{p}"),
        ]
    blocks = rows.groupBy(*BLOCK_KEYS, *PARAMS).agg(*aggs)
    lows = []
    for p in PLANES:
        first, second = Q.low_pair(F.col(f"_c0{p}"), F.col(f"_c1{p}"))
        lows += [F.when(square, F.col(f"_c0{p}")).otherwise(first).alias(f"_a{p}"), second.alias(f"_b{p}")]
    blocks = blocks.select("*", *lows)
    dc = lambda p, cell, luma=None: Q.quantize_dc(F.col(f"_{cell}{p}"), F.col(f"inv_dc_{p}_q16"), fraction_bits, luma)
    blocks = blocks.select("*", dc("y", "a").alias("_dya"), dc("y", "b").alias("_dyb"))
    cells = {
        "x": (dc("x", "a"), dc("x", "b")), "y": (F.col("_dya"), F.col("_dyb")),
        "b": (dc("b", "a", F.col("_dya")), dc("b", "b", F.col("_dyb"))),
    }
    return blocks.select(
        *BLOCK_KEYS, "raw_strategy", F.when(square, lit(1)).otherwise(lit(2)).alias("covered"),
        F.col("quant").alias("raw_quant"), "ytox", "ytob",
        *[F.col(f"_levels.q_{p}").alias(f"q_{p}") for p in PLANES],
        *[F.when(square, F.array(a)).otherwise(F.array(a, b)).alias(f"dc_{p}") for p, (a, b) in cells.items()],
        *[F.col(f"nnz_{p}") for p in PLANES],
        *[F.when(square, F.col(f"nnz_{p}")).otherwise(half_up_shift(F.col(f"nnz_{p}"), 1)).alias(f"nnz_shifted_{p}") for p in PLANES],
        *[F.col(f"{n}_{p}{s}") for p in PLANES for n, s in (("mask", "_lo"), ("mask", "_hi"), ("last", ""))],
    )


def quantize(coefficients: DataFrame, params: DataFrame, fraction_bits: int) -> DataFrame:
    """Quantize (BLOCK_KEYS, k, x, y, b) with per-block PARAMS."""
    keys = ["frame_id", "stripe", "block"]
    joined = coefficients.join(params.select(*keys, *PARAMS), keys)
    return collect_blocks(quantize_coefficients(joined, fraction_bits), fraction_bits)


def quantized_trace(blocks: DataFrame) -> DataFrame:
    """QuantizedAc, QuantDc and NumNonzeros rows; group is the raster block.

    AC index = channel * count + k, DC index = channel * covered + cell; owners add shifted counts as 3..5 when
    they cover two cells.
    """
    def plane(stage: str, source: str, stride: Column, ch: int) -> Column:
        return F.transform(F.col(f"{source}_{PLANES[ch]}"), lambda v, i: F.struct(
            lit(C.STAGES[stage]).alias("stage"), (lit(ch) * stride + i).alias("index"), v.alias("value")))

    def entries(stage: str, source: str, stride: Column) -> Column:
        return F.concat(*[plane(stage, source, stride, ch) for ch in range(3)])

    square = F.col("raw_strategy") == C.DCT
    counts = [(i, f"nnz_{p}") for i, p in enumerate(PLANES)]
    shifted = [(i + 3, f"nnz_shifted_{p}") for i, p in enumerate(PLANES)]
    count_rows = lambda items: F.array(*[
        F.struct(lit(C.STAGES["NumNonzeros"]).alias("stage"), lit(i).alias("index"), F.col(c).alias("value")) for i, c in items
    ])
    return blocks.select(
        "frame_id", F.col("block").alias("group"),
        F.inline(F.concat(
            entries("QuantizedAc", "q", F.when(square, lit(64)).otherwise(lit(128))),
            entries("QuantDc", "dc", F.col("covered")),
            F.when(square, count_rows(counts)).otherwise(count_rows(counts + shifted)),
        )),
    ).select("frame_id", "stage", "group", "index", "value")
