"""Packed trace words, token extraction, dense grids, and block assembly.

Errors are rows, not exceptions: every check yields (frame_id, rule, detail) beside the good data.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions import coding
from blockfield.functions import constants as C
from blockfield.functions.fixed import UINT32_MAX, int_div, lit, sign_extend, swap_bytes, wide_floor_div
from blockfield.operators.geometry import constant_grid

DOMAIN_CHUNK = 4096
WIDEST_GAP = 1 << 20


def _power(bits: int) -> Column:
    return F.expr(f"cast('{1 << bits}' as decimal(38,0))")


def pack_words(trace: DataFrame, group_bits: int = 16, value_bits: int = 32) -> DataFrame:
    """Add ``data``: stage in the low byte, then group, index and the two's complement value."""
    wide = lambda c, bits: F.pmod(F.col(c).cast("decimal(38,0)"), _power(bits))
    data = (
        wide("stage", 8) + wide("group", group_bits) * F.lit(256).cast("decimal(10,0)")
        + wide("index", 32) * F.lit(1 << (8 + group_bits)).cast("decimal(19,0)")
        + (wide("value", value_bits).cast("decimal(19,0)") * F.expr(f"cast('{1 << (40 + group_bits)}' as decimal(19,0))")).cast("decimal(38,0)")
    )
    return trace.withColumn("data", data.cast("decimal(38,0)"))


def unpack_words(words: DataFrame, group_bits: int = 16, value_bits: int = 32) -> DataFrame:
    """Replace ``data`` by stage, group, index, value and ``oversized``."""
    total = 8 + group_bits + 32 + value_bits
    keep = [c for c in words.columns if c != "data"]
    data = F.col("data").cast("decimal(38,0)")
    staged = words.select(
        *keep, ((data < 0) | (data >= _power(total))).alias("oversized"),
        F.pmod(data, _power(8)).cast("bigint").alias("stage"), wide_floor_div(data, 8).alias("_r1"),
    )
    staged = staged.select("*", F.pmod("_r1", _power(group_bits)).cast("bigint").alias("group"), wide_floor_div(F.col("_r1"), group_bits).alias("_r2"))
    staged = staged.select("*", F.pmod("_r2", _power(32)).cast("bigint").alias("index"), F.pmod(wide_floor_div(F.col("_r2"), 32), _power(value_bits)).cast("bigint").alias("_v"))
    return staged.select(*keep, "stage", "group", "index", sign_extend(F.col("_v"), value_bits).alias("value"), "oversized")


def unpack_binary(words: DataFrame) -> DataFrame:
    """Unpack little-endian BINARY words of at least 11 bytes (16 group bits) without DECIMAL arithmetic."""
    number = lambda start, n: F.conv(F.hex(F.substring("word", start, n)), 16, 10).cast("bigint")
    keep = [c for c in words.columns if c != "word"]
    padding = F.when(F.length("word") > 11, number(12, 5) != 0).otherwise(False)
    return words.select(
        *keep, number(1, 1).alias("stage"), swap_bytes(number(2, 2), 2).alias("group"), swap_bytes(number(4, 4), 4).alias("index"),
        sign_extend(swap_bytes(number(8, 4), 4), 32).alias("value"), padding.alias("oversized"),
    )


def flag_last(rows: DataFrame, order: str = "ordinal") -> DataFrame:
    """Add ``is_final`` and ``last_error``: early_last or missing_last.

    The final position is one grouped maximum per frame, so no frame is sorted in one task.
    """
    ends = rows.groupBy("frame_id").agg(F.max(order).alias("_end"))
    final = F.col(order) == F.col("_end")
    error = F.when(F.col("last") & ~final, F.lit("early_last")).when(~F.col("last") & final, F.lit("missing_last"))
    return rows.join(ends, "frame_id").withColumn("is_final", final).withColumn("last_error", error).drop("_end")


def decode_trace(words: DataFrame, group_bits: int = 16, value_bits: int = 32, require_final_last: bool = False) -> DataFrame:
    """(frame_id, ordinal, stage, group, index, value, last, errors) from (frame_id, ordinal, data, last)."""
    rows = unpack_words(words, group_bits, value_bits)
    checks = [F.when(F.col("oversized"), F.lit("width"))]
    if require_final_last:
        rows = flag_last(rows)
        checks.append(F.col("last_error"))
    return rows.select(
        "frame_id", "ordinal", "stage", "group", "index", "value", "last", F.array_compact(F.array(*checks)).alias("errors")
    )


def of_stage(trace: DataFrame, stage: str) -> DataFrame:
    return trace.where(F.col("stage") == C.STAGES[stage])


def ordinal_domain(ends: DataFrame, keys: list) -> DataFrame:
    """All (keys, ordinal) up to ``end`` inclusive, generated in two bounded levels."""
    chunks = ends.select(*keys, "end", F.explode(F.sequence(lit(0), int_div(F.col("end"), DOMAIN_CHUNK))).alias("_c"))
    first = F.col("_c") * DOMAIN_CHUNK
    return chunks.select(*keys, F.explode(F.sequence(first, F.least(first + DOMAIN_CHUNK - 1, F.col("end")))).alias("ordinal"))


def missing_ranges(tokens: DataFrame, keys: list) -> DataFrame:
    """(keys, from, to): runs of ordinals from zero on that are absent below each stream's maximum; negative ones do not count.

    Neighbours meet inside chunks of the ordinal first and chunk ends second, so no stream is sorted in one task and the
    output has at most a row per token, whatever the ordinals are.
    """
    rows = tokens.where(F.col("ordinal") >= 0).select(*keys, "ordinal", int_div(F.col("ordinal"), DOMAIN_CHUNK).alias("_c"))
    inside = Window.partitionBy(*keys, "_c").orderBy("ordinal")
    chunks = rows.groupBy(*keys, "_c").agg(F.min("ordinal").alias("_low"), F.max("ordinal").alias("_high"))
    across = Window.partitionBy(*keys).orderBy("_c")
    gap = lambda df, at, before: df.withColumn("from", before + 1).withColumn("to", F.col(at) - 1).where(F.col("from") <= F.col("to")).select(*keys, "from", "to")
    return gap(rows, "ordinal", F.lag("ordinal").over(inside)).unionByName(gap(chunks, "_low", F.lag("_high", 1, -1).over(across)))


def missing_ordinals(tokens: DataFrame, keys: list, widest: int = WIDEST_GAP) -> DataFrame:
    """Ordinals absent below each stream's maximum, one row each; of a run of more than ``widest`` only the first ``widest``
    (missing_ranges has every run whole)."""
    ends = F.least(F.col("to"), F.col("from") + (widest - 1))
    chunk = missing_ranges(tokens, keys).select(*keys, F.col("from"), ends.alias("_end")).select(
        *keys, "from", "_end", F.explode(F.sequence(lit(0), int_div(F.col("_end") - F.col("from"), DOMAIN_CHUNK))).alias("_k"))
    first = F.col("from") + F.col("_k") * DOMAIN_CHUNK
    return chunk.select(*keys, F.explode(F.sequence(first, F.least(first + DOMAIN_CHUNK - 1, F.col("_end")))).alias("ordinal"))


def first_missing(missing: DataFrame, keys: list, limit: int = 8) -> DataFrame:
    """The lowest ``limit`` missing ordinals per stream; the rank filter limits every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    return missing.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit)


def duplicates(rows: DataFrame, keys: list) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def token_errors() -> Column:
    """Field-level reasons for one token row."""
    return F.array_compact(F.array(
        F.when(F.col("group") < 0, F.lit("negative_ordinal")), F.when(F.col("index") < 0, F.lit("negative_context")), F.when(F.col("value") < 0, F.lit("negative_value")),
        F.when(F.col("index") > UINT32_MAX, F.lit("context_range")), F.when(F.col("value") > UINT32_MAX, F.lit("value_range")),
    ))


def extract_tokens(trace: DataFrame, stage: str) -> tuple:
    """(tokens, rejects) of one token stage: ordinal = group, context = index."""
    rows = of_stage(trace, stage).withColumn("_errors", token_errors())
    good = rows.where(F.size("_errors") == 0)
    tokens = good.select("frame_id", F.col("group").alias("ordinal"), F.col("index").alias("context"), "value")
    bad = rows.where(F.size("_errors") > 0).select("frame_id", F.explode("_errors").alias("rule"), F.col("group").cast("string").alias("detail"))
    copies = duplicates(rows, ["frame_id", "group"]).select("frame_id", F.lit("duplicate").alias("rule"), F.col("group").cast("string").alias("detail"))
    wide = F.col("to") - F.col("from") >= WIDEST_GAP
    ranges = missing_ranges(tokens, ["frame_id"])
    gaps = missing_ordinals(tokens, ["frame_id"]).select("frame_id", F.lit("missing").alias("rule"), F.col("ordinal").cast("string").alias("detail"))
    long = ranges.where(wide).select("frame_id", F.lit("missing_range").alias("rule"), F.concat_ws("-", "from", "to").alias("detail"))
    return tokens, bad.unionByName(copies).unionByName(gaps).unionByName(long)


GRID_LIMITS = {"block": (0, 255), "tile": (-128, 127)}


def extract_grid(trace: DataFrame, stage: str, frames: DataFrame, kind: str = "block") -> tuple:
    """(grid, rejects): the dense per-block (uint8) or per-tile (int8) grid of one stage."""
    low, high = GRID_LIMITS[kind]
    domain = constant_grid(frames, lit(0), kind).select("frame_id", "index", F.lit(True).alias("_inside"))
    rows = of_stage(trace, stage).select("frame_id", "index", "value").join(domain, ["frame_id", "index"], "full_outer")
    reason = (
        F.when(F.col("_inside").isNull(), F.lit("index_range")).when(F.col("value").isNull(), F.lit("missing"))
        .when(~F.col("value").between(low, high), F.lit("value_range"))
    )
    rows = rows.withColumn("rule", reason)
    copies = duplicates(rows, ["frame_id", "index"]).select("frame_id", F.lit("duplicate").alias("rule"), F.col("index").cast("string").alias("detail"))
    rejects = rows.where(F.col("rule").isNotNull()).select("frame_id", "rule", F.col("index").cast("string").alias("detail"))
    return rows.where(F.col("rule").isNull()).select("frame_id", "index", "value"), rejects.unionByName(copies)


BLOCK_SLOTS = 198


def assemble_quantized_blocks(trace: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per block: dc and num_nonzeros arrays (X, Y, B), quantized 3 x 64, and the reasons a block is unusable.

    A block has 192 coefficient, 3 dc and 3 count slots.  Slots are counted before a block's row is built, so however often a
    slot is repeated, a row holds at most 198 entries.
    """
    stage = {n: lit(C.STAGES[n]) for n in ("QuantizedAc", "QuantDc", "NumNonzeros")}
    is_ac, is_dc, is_nz = ((F.col("stage") == stage[n]) for n in ("QuantizedAc", "QuantDc", "NumNonzeros"))
    slot = F.when(is_ac, F.col("index")).when(is_dc, F.col("index") + 192).otherwise(F.col("index") + 195)
    bad = (F.when(is_ac, ~F.col("index").between(0, 191)).otherwise(~F.col("index").between(0, 2))
           | (is_nz & ~F.col("value").between(0, 63)) | ~F.col("value").between(-(1 << 31), (1 << 31) - 1))
    entries = trace.where(F.col("stage").isin([C.STAGES[n] for n in stage])).withColumn("_slot", F.when(~bad, slot))
    slots = entries.groupBy("frame_id", "group", "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("value"))
    domain = constant_grid(frames, lit(0)).select("frame_id", F.col("index").alias("group"), F.lit(True).alias("_inside"))
    held = F.col("_slot").isNotNull()
    nonzero = held & (F.col("_slot") < 192) & (F.col("value") != 0) & (F.col("_slot") % 64 != 0)
    blocks = slots.groupBy("frame_id", "group").agg(
        F.array_sort(F.collect_list(F.when(held, F.struct("_slot", "value")))).alias("_all"),
        F.coalesce(F.sum(F.when(~held, F.col("_n"))), lit(0)).alias("_out"),
        F.coalesce(F.sum(F.when(held, F.col("_n") - 1)), lit(0)).alias("_copies"),
        *[F.count_if(nonzero & (int_div(F.col("_slot"), 64) == ch)).alias(f"_nz{ch}") for ch in range(3)],
    ).join(domain, ["frame_id", "group"], "full_outer")
    complete = (F.size("_all") == BLOCK_SLOTS) & (F.col("_copies") == 0)
    part = lambda start, n: F.when(complete, F.transform(F.slice("_all", start, n), lambda e: e["value"]))
    blocks = blocks.select(
        "frame_id", F.col("group").alias("block"), part(193, 3).alias("dc"), part(196, 3).alias("num_nonzeros"),
        F.when(complete, F.transform(F.sequence(lit(0), lit(2)), lambda c: F.transform(F.slice("_all", (c * 64 + 1).cast("int"), F.lit(64)), lambda e: e["value"]))).alias("quantized"),
        "_inside", "_all", "_out", "_copies", F.array("_nz0", "_nz1", "_nz2").alias("_counted"),
    )
    errors = F.array_compact(F.array(
        F.when(F.col("_inside").isNull(), F.lit("block_range")), F.when(F.col("_all").isNull(), F.lit("missing_block")),
        F.when(F.col("_out") > 0, F.lit("value_range")), F.when(F.col("_copies") > 0, F.lit("duplicate")),
        F.when((F.size("_all") < BLOCK_SLOTS) & (F.col("_copies") == 0), F.lit("missing_slot")),
        F.when(F.col("num_nonzeros") != F.col("_counted"), F.lit("nonzero_count")),
    ))
    return blocks.select("frame_id", "block", "dc", "num_nonzeros", "quantized", errors.alias("errors"))


def unpack_prepared_words(words: DataFrame) -> DataFrame:
    """Regroup 201-word records: nine scalars, then 64 coefficients per plane.

    ``words`` has (frame_id, ordinal, data); coefficients come back signed.
    """
    at = F.col("ordinal") % 201
    data = F.col("data").cast("bigint")
    scalar = lambda i: F.max(F.when(at == i, data))
    names = ["quant", "scale_q16", "inv_qac_q16", "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16", "x_qm_q16", "ytox", "ytob"]
    blocks = words.groupBy("frame_id", int_div(F.col("ordinal"), 201).alias("block")).agg(
        *[scalar(i).alias(n) for i, n in enumerate(names)],
        F.array_sort(F.collect_list(F.when(at >= 9, F.struct(at.alias("w"), sign_extend(data, 32).alias("v"))))).alias("_c"),
        F.count(F.lit(1)).alias("words"),
    )
    plane = lambda ch: F.transform(F.slice("_c", 1 + 64 * ch, 64), lambda e: e["v"])
    return blocks.select(
        "frame_id", "block", *names[:7], sign_extend(F.col("ytox"), 8).alias("ytox"), sign_extend(F.col("ytob"), 8).alias("ytob"),
        *[plane(ch).alias(p) for ch, p in enumerate("xyb")], (F.col("words") == 201).alias("complete"),
    )


def pack_prepared_words(blocks: DataFrame) -> DataFrame:
    """Inverse of :func:`unpack_prepared_words`: (frame_id, ordinal, data) as unsigned 32-bit words."""
    scalars = ["quant", "scale_q16", "inv_qac_q16", "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16", "x_qm_q16", "ytox", "ytob"]
    words = F.concat(F.array(*[F.col(c).cast("bigint") for c in scalars]), F.col("x"), F.col("y"), F.col("b"))
    return blocks.select("frame_id", "block", F.posexplode(words).alias("_w", "data")).select(
        "frame_id", (F.col("block") * 201 + F.col("_w")).alias("ordinal"), coding.as_uint32(F.col("data")).alias("data")
    )


def pack_rgb_words(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, ordinal, data, last): R | G << 16 | B << 32 in raster order."""
    mask = lambda c: F.col(c).cast("bigint").bitwiseAND(lit(0xFFFF))
    ordinal = F.col("y") * F.col("xsize") + F.col("x")
    return pixels.join(frames.select("frame_id", "xsize", "ysize"), "frame_id").select(
        "frame_id", ordinal.alias("ordinal"),
        mask("r").bitwiseOR(F.shiftleft(mask("g"), 16)).bitwiseOR(F.shiftleft(mask("b"), 32)).alias("data"),
        (ordinal == F.col("xsize") * F.col("ysize") - 1).alias("last"),
    )


def unpack_rgb_words(words: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, x, y, r, g, b) with coordinates regenerated from the raster ordinal."""
    component = lambda shift: sign_extend(F.shiftright("data", shift), 16)
    return words.join(frames.select("frame_id", "xsize"), "frame_id").select(
        "frame_id", (F.col("ordinal") % F.col("xsize")).alias("x"), int_div(F.col("ordinal"), F.col("xsize")).alias("y"),
        component(0).alias("r"), component(16).alias("g"), component(32).alias("b"),
    )


def route_trace(frames: DataFrame, trace: DataFrame) -> DataFrame:
    """Trace rows of the stage each frame's flags select."""
    routed = frames.select("frame_id", coding.route_stage(
        F.col("enable_xyb"), F.col("enable_dct"), F.col("enable_quant"), F.col("enable_tokenize"), F.col("token_select")
    ).alias("stage"))
    return trace.join(routed, ["frame_id", "stage"], "left_semi")
