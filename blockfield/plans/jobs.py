"""Frames to tokens: the public end-to-end jobs, composed from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.functions import coding
from blockfield.functions import constants as C
from blockfield.functions.fixed import lit
from blockfield.operators import aq, cfl, quantize, shape, tokens, transform
from blockfield.operators.geometry import BLOCK_KEYS, block_columns, job_rejects, placed, stripe_parts, with_geometry
from blockfield.session import stage, tune, write_table

# Precision of each consumer, in fraction bits.
ANALYSIS_BITS, ANALYSIS_GUARD = 18, 8
QUANT_BITS, QUANT_GUARD = 21, 7
NATIVE_BITS = 12


def attach_tiles(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add ytox and ytob of the tile a block lies in."""
    keyed = blocks.select("*", *cfl.tile_columns())
    return keyed.join(
        tiles.select("frame_id", "stripe", "tile_x", "tile_y", "ytox", "ytob"), ["frame_id", "stripe", "tile_x", "tile_y"]
    ).drop("tile_x", "tile_y")


def raster_tiles(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    shape_ = with_geometry(frames).select("frame_id", "x_tiles")
    return tiles.join(shape_, "frame_id").select(
        "frame_id", (F.col("tile_y") * F.col("x_tiles") + F.col("tile_x")).alias("tile"), "ytox", "ytob"
    )


def square_params(blocks: DataFrame, frames: DataFrame, tiles: DataFrame = None) -> DataFrame:
    """Adaptive 8x8 parameters; multipliers come from estimated tiles or from the frame's fixed values."""
    plain = blocks.select(*BLOCK_KEYS, "raw_quant", lit(C.DCT).alias("raw_strategy"))
    if tiles is not None:
        plain = attach_tiles(plain, tiles)
    else:
        fixed = frames.select("frame_id", F.col("fixed_ytox").cast("bigint").alias("ytox"), F.col("fixed_ytob").cast("bigint").alias("ytob"))
        plain = plain.join(fixed, "frame_id")
    return quantize.adaptive_params(plain, frames)


def quantize_square_frames(pixels: DataFrame, frames: DataFrame, estimate_cfl: bool = True) -> tuple:
    """8x8-only route at native precision: (quantized blocks, stripe tiles or None)."""
    tune(pixels.sparkSession)
    frames = write_table(frames)  # one row a frame, read by every step
    parts = stripe_parts(pixels, frames)
    columns = placed(stage(block_columns(pixels, frames, (NATIVE_BITS,), parts)), parts)
    coefficients = transform.block_transform(columns, NATIVE_BITS)
    tiles = stage(cfl.cfl_tiles(coefficients, NATIVE_BITS)) if estimate_cfl else None
    params = square_params(stage(aq.aq_blocks(columns, frames)), frames, tiles)
    return write_table(quantize.quantize(coefficients, params, NATIVE_BITS)), tiles


def choose_shapes(columns: DataFrame, frames: DataFrame, parts: int = None) -> tuple:
    """(cells with code and adjusted raw_quant, stripe tiles) from block columns at Q12 and Q18, placed in ``parts`` parts."""
    fields = placed(stage(aq.aq_blocks(columns, frames)), parts)
    square = transform.block_lines(columns, ANALYSIS_BITS, ANALYSIS_GUARD)
    tiles = stage(cfl.cfl_tiles(transform.coefficients_of(square, C.DCT, ANALYSIS_GUARD), ANALYSIS_BITS))
    candidates = shape.candidate_fields(fields, tiles, frames)
    sums = None
    for code, lines in (
        (C.DCT, square),
        (C.DCT16X8, transform.vertical_lines(columns, ANALYSIS_BITS, ANALYSIS_GUARD)),
        (C.DCT8X16, transform.horizontal_lines(columns, ANALYSIS_BITS, ANALYSIS_GUARD)),
    ):
        # candidates meet lines of 8 or 16 coefficients, which become rows of their own behind the join only
        met = lines.join(candidates.where(F.col("raw_strategy") == code), BLOCK_KEYS)
        coefficients = transform.coefficients_of(met, code, ANALYSIS_GUARD, shape.CARRIED)
        part = shape.coefficient_costs(coefficients, ANALYSIS_BITS)
        sums = part if sums is None else sums.unionByName(part)
    # a few rows a block; the choice runs in a stage of its own, beside none of the sorts above
    costs = shape.candidate_costs(placed(stage(sums), parts), frames)
    cells = shape.strategy_map(fields.select(*BLOCK_KEYS, "raw_quant"), shape.decide(costs))
    return stage(shape.adjust_quant_field(cells, frames)), tiles


def quantize_shaped_frames(pixels: DataFrame, frames: DataFrame) -> tuple:
    """Variable-shape route: (quantized owners, stripe tiles)."""
    return _shaped(pixels, frames)[:2]


def _shaped(pixels: DataFrame, frames: DataFrame) -> tuple:
    """(quantized owners, stripe tiles, cells with their shapes)."""
    tune(pixels.sparkSession)
    frames = write_table(frames)
    parts = stripe_parts(pixels, frames)
    columns = placed(stage(block_columns(pixels, frames, (NATIVE_BITS, ANALYSIS_BITS, QUANT_BITS), parts)), parts)
    cells, tiles = choose_shapes(columns, frames, parts)
    owners = placed(cells, parts).where(coding.is_first(F.col("code"))).select(
        *BLOCK_KEYS, coding.raw_strategy(F.col("code")).alias("raw_strategy"), "raw_quant"
    )
    params = quantize.adaptive_params(attach_tiles(owners, tiles), frames)
    of = lambda code: owners.where(F.col("raw_strategy") == code)
    coefficients = (
        transform.block_transform(columns, QUANT_BITS, 0, of(C.DCT))
        .unionByName(transform.vertical_transform(columns, QUANT_BITS, QUANT_GUARD, of(C.DCT16X8)))
        .unionByName(transform.horizontal_transform(columns, QUANT_BITS, QUANT_GUARD, of(C.DCT8X16)))
    )
    return write_table(quantize.quantize(coefficients, params, QUANT_BITS)), tiles, cells


def square_tokens(pixels: DataFrame, frames: DataFrame, estimate_cfl: bool = True) -> DataFrame:
    quantized, tiles = quantize_square_frames(pixels, frames, estimate_cfl)
    if tiles is None:
        grid = with_geometry(frames)
        maps = grid.select(
            "frame_id", F.explode(F.sequence(lit(0), F.col("tile_count") - 1)).alias("tile"),
            F.col("fixed_ytox").cast("bigint").alias("ytox"), F.col("fixed_ytob").cast("bigint").alias("ytob"),
        )
    else:
        maps = raster_tiles(tiles, frames)
    return tokens.all_tokens(quantized, maps, frames)


def shaped_tokens(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    quantized, tiles = quantize_shaped_frames(pixels, frames)
    return tokens.all_tokens(quantized, raster_tiles(tiles, frames), frames)


def square_job(pixels: DataFrame, frames: DataFrame, estimate_cfl: bool = True) -> tuple:
    """(tokens, rejects) of the 8x8 route; rejects (frame_id, rule, detail) are the frames and pixels that gave no tokens."""
    return square_tokens(pixels, frames, estimate_cfl), job_rejects(pixels, frames)


def shaped_job(pixels: DataFrame, frames: DataFrame) -> tuple:
    """(tokens, rejects) of the variable-shape route; besides frames and pixels left out, rejects name the frames with blocks whose
    shape was decided on capped costs or without a supported distance."""
    quantized, tiles, cells = _shaped(pixels, frames)
    return tokens.all_tokens(quantized, raster_tiles(tiles, frames), frames), job_rejects(pixels, frames).unionByName(shape.shape_rejects(cells))
