"""DC, metadata and AC tokens.

Ordinals are arithmetic: plane offsets for DC, phase offsets for metadata, running totals of per-block token
counts for AC.  Token rows themselves are never sorted or windowed, and the AC scan state (how many nonzeros
are left, was the previous one nonzero) is read from the block's nonzero bit mask.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.functions import coding
from blockfield.functions import constants as C
from blockfield.functions.fixed import half_up_shift, lit, lookup, pack_signed
from blockfield.operators.geometry import covered_cells, with_geometry
from blockfield.operators.scan import neighbours, raster_scan

PLANES = ("x", "y", "b")
PLANE_SEQUENCE = ("y", "x", "b")


def block_counts(frames: DataFrame) -> DataFrame:
    return with_geometry(frames).select("frame_id", "x_blocks", "block_count", "x_tiles", "tile_count")


def dc_cells(quantized: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per covered raster cell: (frame_id, block, bx, by, dc_x, dc_y, dc_b)."""
    part = F.col("part").cast("int")
    cells = covered_cells(quantized.join(block_counts(frames), "frame_id"))
    vertical = (F.col("raw_strategy") == C.DCT16X8).cast("bigint")
    horizontal = (F.col("raw_strategy") == C.DCT8X16).cast("bigint")
    return cells.select(
        "frame_id", F.col("cell").alias("block"),
        (F.col("bx") + F.col("part") * horizontal).alias("bx"), (F.col("by") + F.col("part") * vertical).alias("by"),
        *[F.get(F.col(f"dc_{p}"), part).alias(f"dc_{p}") for p in PLANES],
    )


def _edge_rules(x: str, y: str, west: Column, north: Column, northwest: Column) -> tuple:
    """Predictor inputs at the frame edge: west, else north, else zero."""
    left = F.when(F.col(x) != 0, west).when(F.col(y) != 0, north).otherwise(lit(0))
    top = F.when(F.col(y) != 0, north).otherwise(left)
    corner = F.when((F.col(x) != 0) & (F.col(y) != 0), northwest).otherwise(left)
    return left, top, corner


def predict_dc(cells: DataFrame) -> DataFrame:
    """Long form (frame_id, block, plane_rank, value, left, top, corner) in plane order Y, X, B."""
    near = neighbours(cells, ["dc_x", "dc_y", "dc_b"])
    entries = []
    for rank, p in enumerate(PLANE_SEQUENCE):
        left, top, corner = _edge_rules("bx", "by", F.col(f"w_dc_{p}"), F.col(f"n_dc_{p}"), F.col(f"nw_dc_{p}"))
        entries.append(F.struct(
            lit(rank).alias("plane_rank"), F.col(f"dc_{p}").alias("value"),
            left.alias("left"), top.alias("top"), corner.alias("corner"),
        ))
    return near.select("frame_id", "block", F.inline(F.array(*entries)))


def dc_tokens(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, ordinal, context, value)."""
    left, top, corner = F.col("left"), F.col("top"), F.col("corner")
    residual = F.col("value") - coding.clamped_gradient(top, left, corner)
    return predict_dc(cells).join(block_counts(frames), "frame_id").select(
        "frame_id", (F.col("plane_rank") * F.col("block_count") + F.col("block")).alias("ordinal"),
        coding.gradient_context(coding.gradient_property(top, left, corner)).alias("context"),
        pack_signed(residual).alias("value"),
    )


def cfl_tokens(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """Metadata phase 0: both multiplier maps from (frame_id, tile, ytox, ytob)."""
    grid = tiles.join(block_counts(frames), "frame_id").withColumn("tx", F.col("tile") % F.col("x_tiles")).withColumn(
        "ty", F.floor(F.col("tile") / F.col("x_tiles"))
    )
    near = neighbours(grid, ["ytox", "ytob"], "tx", "ty")
    entries = []
    for rank, m in enumerate(("ytox", "ytob")):
        left, top, corner = _edge_rules("tx", "ty", F.col(f"w_{m}"), F.col(f"n_{m}"), F.col(f"nw_{m}"))
        residual = F.col(m) - coding.clamped_gradient(top, left, corner)
        entries.append(F.struct(
            (lit(rank) * F.col("tile_count") + F.col("tile")).alias("ordinal"),
            lit(2 - rank).alias("context"), pack_signed(residual).alias("value"),
        ))
    return near.select("frame_id", F.inline(F.array(*entries)))


def metadata_tokens(owners: DataFrame, tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, ordinal, context, value): multiplier maps, strategy and quant per owner, one literal per cell.

    ``owners`` has (frame_id, block, bx, by, raw_strategy, raw_quant); plain 8x8 frames simply have one owner per
    block.
    """
    coded = owners.select(
        "frame_id", "block", "bx", "by", "raw_strategy",
        coding.strategy_code(F.col("raw_strategy")).alias("code"), (F.col("raw_quant") - 1).alias("quant"),
    )
    scanned = raster_scan(coded, lit(1), "owner", ["code", "quant"]).join(block_counts(frames), "frame_id")
    start = F.col("tile_count") * 2
    left_code = F.coalesce(F.col("prev_code"), lit(0))
    left_quant = F.coalesce(F.col("prev_quant"), F.col("code"))
    literal = lambda block: F.struct(
        (start + 2 * F.col("owner_total") + block).alias("ordinal"), lit(0).alias("context"),
        lit(2 * C.BLOCK_METADATA_LITERAL).alias("value"),
    )
    second = F.when(F.col("raw_strategy") == C.DCT16X8, F.col("block") + F.col("x_blocks")).otherwise(F.col("block") + 1)
    own = [
        F.struct((start + F.col("owner")).alias("ordinal"), coding.strategy_context(left_code).alias("context"),
                 pack_signed(F.col("code")).alias("value")),
        F.struct((start + F.col("owner_total") + F.col("owner")).alias("ordinal"),
                 coding.quant_context(left_quant).alias("context"),
                 pack_signed(F.col("quant") - left_quant).alias("value")),
        literal(F.col("block")),
    ]
    rows = F.when(F.col("raw_strategy") == C.DCT, F.array(*own)).otherwise(F.array(*own, literal(second)))
    per_owner = scanned.select("frame_id", F.inline(rows))
    return cfl_tokens(tiles, frames).unionByName(per_owner)


def predict_nonzeros(quantized: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, stripe, block, predicted_x, predicted_y, predicted_b) for every owner.

    Rectangles put their halved count into both cells; the origin predicts 32.
    """
    owners = quantized.select(
        "frame_id", "stripe", "block", "bx", "by", "raw_strategy", *[f"nnz_shifted_{p}" for p in PLANES]
    ).join(block_counts(frames), "frame_id")
    vertical = (F.col("raw_strategy") == C.DCT16X8).cast("bigint")
    horizontal = (F.col("raw_strategy") == C.DCT8X16).cast("bigint")
    cells = covered_cells(owners).select(
        "frame_id", "stripe", "block", "part",
        (F.col("bx") + F.col("part") * horizontal).alias("bx"), (F.col("by") + F.col("part") * vertical).alias("by"),
        *[F.col(f"nnz_shifted_{p}").alias(f"c_{p}") for p in PLANES],
    )
    near = neighbours(cells, [f"c_{p}" for p in PLANES]).where(F.col("part") == 0)

    def predicted(p: str) -> Column:
        west, north = F.col(f"w_c_{p}"), F.col(f"n_c_{p}")
        return (
            F.when((F.col("bx") == 0) & (F.col("by") == 0), lit(32)).when(F.col("bx") == 0, north)
            .when(F.col("by") == 0, west).otherwise(half_up_shift(north + west, 1))
        )

    return near.select("frame_id", "stripe", "block", *[predicted(p).alias(f"predicted_{p}") for p in PLANES])


def ac_tokens(quantized: DataFrame, frames: DataFrame, prefix_only: bool = False) -> DataFrame:
    """(frame_id, ordinal, context, value, last): nonzero-count prefix, then levels up to the last nonzero."""
    length = {p: lit(1) if prefix_only else lit(1) + F.coalesce(F.col(f"last_{p}") - F.col("covered") + 1, lit(0)) for p in PLANES}
    narrow = quantized.select(
        "frame_id", "stripe", "block", "bx", "by", *[length[p].alias(f"length_{p}") for p in PLANES]
    )
    placed = raster_scan(narrow, F.col("length_x") + F.col("length_y") + F.col("length_b"), "base")
    placed = placed.select(
        "frame_id", "stripe", "block", "base", "base_total", *[f"length_{p}" for p in PLANES]
    )
    keys = ["frame_id", "stripe", "block"]
    rows = quantized.join(placed, keys).join(predict_nonzeros(quantized, frames), keys)
    starts = {"y": lit(0), "x": F.col("length_y"), "b": F.col("length_y") + F.col("length_x")}
    entries = [
        F.struct(
            lit(ch).alias("ch"), (F.col("base") + starts[p]).alias("start"), F.col(f"nnz_{p}").alias("nnz"),
            F.col(f"predicted_{p}").alias("predicted"), F.col(f"mask_{p}_lo").alias("lo"), F.col(f"mask_{p}_hi").alias("hi"),
            F.col(f"last_{p}").alias("last_pos"), F.col(f"q_{p}").alias("q"),
        )
        for p, ch in (("y", C.Y), ("x", C.X), ("b", C.B))
    ]
    streams = rows.select("frame_id", "raw_strategy", "covered", "base_total", F.inline(F.array(*entries)))
    streams = streams.withColumn("block_ctx", coding.block_context(F.col("ch"), F.col("raw_strategy")))
    prefix = streams.select(
        "frame_id", F.col("start").alias("ordinal"),
        coding.nonzero_context(F.col("predicted"), F.col("block_ctx")).alias("context"), F.col("nnz").alias("value"),
        (F.col("start") == F.col("base_total") - 1).alias("last"),
    )
    if prefix_only:
        return prefix
    # Position covered - 1 stands for the prefix itself, so one generator yields the whole stream of a plane.
    scanned = streams.withColumn(
        "pos", F.explode(F.sequence(F.col("covered") - 1, F.coalesce(F.col("last_pos"), F.col("covered") - 1)))
    )
    pos = F.col("pos")
    square = F.col("raw_strategy") == C.DCT
    offset = F.when(square, lookup(C.SCAN_SQUARE, pos)).otherwise(lookup(C.SCAN_RECT, pos))
    low, high = pos < 64, F.greatest(pos - 64, lit(0))
    unsigned = lambda mask, n: F.call_function("shiftrightunsigned", mask, n.cast("int"))
    remaining = F.when(low, F.bit_count(unsigned(F.col("lo"), F.least(pos, lit(63)))) + F.bit_count("hi")).otherwise(
        F.bit_count(unsigned(F.col("hi"), high))
    ).cast("bigint")
    before = F.when(pos <= 64, unsigned(F.col("lo"), F.greatest(F.least(pos - 1, lit(63)), lit(0)))).otherwise(
        unsigned(F.col("hi"), F.greatest(pos - 65, lit(0)))
    ).bitwiseAND(lit(1))
    first = (F.col("nnz") <= F.when(square, 4).otherwise(8)).cast("bigint")
    prev = F.when(pos == F.col("covered"), first).otherwise(before)
    density = coding.zero_density_context(remaining, pos, F.col("covered"), prev, F.col("block_ctx"))
    is_prefix = pos < F.col("covered")
    ordinal = F.col("start") + pos - F.col("covered") + 1
    return scanned.select(
        "frame_id", ordinal.alias("ordinal"),
        F.when(is_prefix, coding.nonzero_context(F.col("predicted"), F.col("block_ctx"))).otherwise(density).alias("context"),
        F.when(is_prefix, F.col("nnz")).otherwise(pack_signed(F.get(F.col("q"), offset.cast("int")))).alias("value"),
        (ordinal == F.col("base_total") - 1).alias("last"),
    )


def strategy_grid(owners: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, block, code): 2 * raw strategy, plus one on the owner's own cell."""
    cells = covered_cells(owners.select("frame_id", "block", "raw_strategy").join(block_counts(frames), "frame_id"))
    return cells.select(
        "frame_id", F.col("cell").alias("block"),
        coding.encode_strategy(F.col("raw_strategy"), F.col("part") == 0).alias("code"),
    )


def all_tokens(quantized: DataFrame, tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, phase, stage, group, index, value, last) in phase order DC, strategy, metadata, AC."""
    def phase(number: int, stage: str, tokens: DataFrame, group, index, last=F.lit) -> DataFrame:
        return tokens.select(
            "frame_id", lit(number).alias("phase"), lit(C.STAGES[stage]).alias("stage"), group.alias("group"),
            index.alias("index"), F.col("value"), last(False).alias("last"),
        )

    by_ordinal = (F.col("ordinal"), F.col("context"))
    grid = strategy_grid(quantized, frames).withColumnRenamed("code", "value")
    return (
        phase(0, "DcTokens", dc_tokens(dc_cells(quantized, frames), frames), *by_ordinal)
        .unionByName(phase(1, "AcStrategy", grid, lit(0), F.col("block")))
        .unionByName(phase(2, "AcMetadataTokens", metadata_tokens(quantized, tiles, frames), *by_ordinal))
        .unionByName(phase(3, "AcTokens", ac_tokens(quantized, frames), *by_ordinal, last=lambda _: F.col("last")))
    )


def context_histogram(tokens: DataFrame, totals: bool = False) -> DataFrame:
    """Token count per (stage, context); with totals also per stage and overall."""
    grouped = tokens.rollup("stage", "context") if totals else tokens.groupBy("stage", "context")
    return grouped.agg(F.count(F.lit(1)).alias("tokens"))
