"""Frame geometry, edge padding, and the block-column layout every later stage shares.

Vertical neighbourhoods stop at the 64-row stripe and tiles are 64 pixels high, so a hash partitioning by
(frame_id, stripe) keeps everything from color conversion to shape choice local.  ``spread`` is the one
shuffle of pixel rows; a stripe is 64 rows high whatever the frame size.  Its parts grow with the samples, so what one task
holds does not.  Checkpoints of adaptive plans forget how they are dealt: staged rows are ``placed`` again.  Frames have no
greatest size; those without a pixel and pixels outside their frame are rows of ``rejected_frames`` and ``rejected_pixels``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.color import to_xyb
from blockfield.functions.fixed import int_div, lit

BLOCK_KEYS = ["frame_id", "stripe", "block", "bx", "by"]
#: Padded samples in one part of the stripe partitioning; small tables use parts down to the lesser number, for all cores.
PART_SAMPLES, LEAST_SAMPLES = 1 << 19, 1 << 13


def _ceil_div(c: Column, n: int) -> Column:
    return int_div(c.cast("bigint") + (n - 1), n)


def with_geometry(frames: DataFrame) -> DataFrame:
    """Add block, tile and padded dimensions to a frames table."""
    return (
        frames.withColumn("x_blocks", _ceil_div(F.col("xsize"), C.BLOCK))
        .withColumn("y_blocks", _ceil_div(F.col("ysize"), C.BLOCK))
        .withColumn("padded_xsize", F.col("x_blocks") * C.BLOCK)
        .withColumn("padded_ysize", F.col("y_blocks") * C.BLOCK)
        .withColumn("x_tiles", _ceil_div(F.col("xsize"), C.TILE))
        .withColumn("y_tiles", _ceil_div(F.col("ysize"), C.TILE))
        .withColumn("block_count", F.col("x_blocks") * F.col("y_blocks"))
        .withColumn("tile_count", F.col("x_tiles") * F.col("y_tiles"))
    )


def block_tile(block: Column, x_blocks: Column, x_tiles: Column) -> Column:
    """Raster tile that contains a raster block."""
    bx, by = block % x_blocks, int_div(block, x_blocks)
    return int_div(by, C.BLOCKS_PER_TILE) * x_tiles + int_div(bx, C.BLOCKS_PER_TILE)


def _out_of_range(max_width: int = None, max_height: int = None) -> Column:
    x, y = F.col("xsize"), F.col("ysize")
    bad = x.isNull() | y.isNull() | (x <= 0) | (y <= 0)
    for size, most in ((x, max_width), (y, max_height)):
        bad = bad | (size > most) if most is not None else bad
    return F.coalesce(bad, F.lit(True))


def valid_frames(frames: DataFrame, max_width: int = None, max_height: int = None) -> DataFrame:
    return frames.where(~_out_of_range(max_width, max_height))


def rejected_frames(frames: DataFrame, max_width: int = None, max_height: int = None) -> DataFrame:
    """Frames that the jobs leave out: null or nonpositive sizes, and sizes beyond a target's limits where given."""
    return frames.where(_out_of_range(max_width, max_height)).select(
        "frame_id", F.lit("overflow").alias("rule"), F.concat_ws("x", "xsize", "ysize").alias("detail")
    )


def rejected_pixels(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, rule, detail): pixels of unknown frames or outside their frame, and frames with missing or repeated pixels."""
    shape = valid_frames(frames).select("frame_id", "xsize", "ysize")
    both = pixels.select("frame_id", "x", "y").join(shape, "frame_id", "left")
    x, y = F.col("x"), F.col("y")
    inside = F.coalesce((x >= 0) & (y >= 0) & (x < F.col("xsize")) & (y < F.col("ysize")), F.lit(False))
    at = F.concat_ws(",", "x", "y")
    outside = both.where(~inside).select("frame_id", F.when(F.col("xsize").isNull(), F.lit("unknown_frame")).otherwise(F.lit("outside")).alias("rule"), at.alias("detail"))
    cells = both.where(inside).groupBy("frame_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    copies = cells.where("n > 1").select("frame_id", F.lit("duplicate").alias("rule"), at.alias("detail"))
    counts = shape.join(cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "frame_id", "left")
    short = F.col("xsize").cast("bigint") * F.col("ysize") - F.coalesce("n", lit(0))
    missing = counts.where(short > 0).select("frame_id", F.lit("missing_pixels").alias("rule"), short.cast("string").alias("detail"))
    return outside.unionByName(copies).unionByName(missing)


def job_rejects(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Everything the frame jobs leave out of (pixels, frames), as rows (frame_id, rule, detail)."""
    return rejected_frames(frames).unionByName(rejected_pixels(pixels, frames))


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Keep a window and move it to the origin."""
    return (
        pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
        .withColumn("x", F.col("x") - x0)
        .withColumn("y", F.col("y") - y0)
    )


def pad_frames(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Repeat the last column and row up to whole blocks; adds the raster ``block`` of every pixel.

    Only edge pixels have copies, so each pixel generates its own copies and no grid join is needed.
    """
    shape = with_geometry(valid_frames(frames)).select(
        "frame_id", "xsize", "ysize", "x_blocks", "padded_xsize", "padded_ysize"
    )
    copies = lambda at, size, padded: F.explode(
        F.when(F.col(at) == F.col(size) - 1, F.sequence(F.col(at), F.col(padded) - 1)).otherwise(F.array(at))
    )
    longs = [F.col(c).cast("bigint").alias(c) for c in ("x", "y", "r", "g", "b")]
    return (
        pixels.select("frame_id", *longs)
        .join(shape, "frame_id")
        .where(F.col("x").between(0, F.col("xsize") - 1) & F.col("y").between(0, F.col("ysize") - 1))
        .withColumn("x", copies("x", "xsize", "padded_xsize"))
        .withColumn("y", copies("y", "ysize", "padded_ysize"))
        .select(
            "frame_id", "x", "y", "r", "g", "b",
            (int_div(F.col("y"), C.BLOCK) * F.col("x_blocks") + int_div(F.col("x"), C.BLOCK)).alias("block"),
        )
    )


def stripe_parts(pixels: DataFrame, frames: DataFrame) -> int:
    """Number of parts (two or more) the stripes of these frames are dealt to, from their padded samples (counted)."""
    samples = pad_frames(pixels, frames).count()
    cores = pixels.sparkSession.sparkContext.defaultParallelism
    return max(2, -(-samples // PART_SAMPLES), min(cores, -(-samples // LEAST_SAMPLES)))


def placed(rows: DataFrame, parts: int = None) -> DataFrame:
    """Rows by stripe, in ``parts`` parts that adaptive plans neither merge nor split."""
    return rows.repartition(parts, "frame_id", "stripe") if parts else rows.repartition("frame_id", "stripe")


def spread(padded: DataFrame, parts: int = None) -> DataFrame:
    """Partition padded pixels by stripe."""
    return placed(padded.withColumn("stripe", int_div(F.col("y"), C.TILE)), parts)


def block_columns(pixels: DataFrame, frames: DataFrame, fraction_bits=(12,), parts: int = None) -> DataFrame:
    """XYB samples as one row per block column: arrays of eight samples per plane and precision.

    Columns: BLOCK_KEYS, ``col`` 0..7, and ``x_q<q>``, ``y_q<q>``, ``b_q<q>``.
    """
    parts = parts or stripe_parts(pixels, frames)
    return pack_columns(to_xyb(spread(pad_frames(pixels, frames), parts), fraction_bits), fraction_bits)


def pack_columns(xyb: DataFrame, fraction_bits=(12,)) -> DataFrame:
    planes = [f"{p}_q{q}" for q in fraction_bits for p in "xyb"]
    rows = xyb.select(
        "frame_id", "stripe", "block",
        int_div(F.col("x"), C.BLOCK).alias("bx"), int_div(F.col("y"), C.BLOCK).alias("by"),
        (F.col("x") % C.BLOCK).alias("col"), (F.col("y") % C.BLOCK).alias("row"), *planes,
    )
    packed = rows.groupBy(*BLOCK_KEYS, "col").agg(
        *[F.max(F.when(F.col("row") == i, F.col(p))).alias(f"{p}_{i}") for p in planes for i in range(8)]
    )
    return packed.select(
        *BLOCK_KEYS, "col", *[F.array(*[f"{p}_{i}" for i in range(8)]).alias(p) for p in planes]
    )


def blocks_to_columns(blocks: DataFrame, planes=("x", "y", "b"), suffix: str = "q12") -> DataFrame:
    """Block rows holding 64-sample raster arrays, re-laid as block columns."""
    cols = [
        F.array(*[F.get(F.col(p), F.col("col").cast("int") + 8 * i) for i in range(8)]).alias(f"{p}_{suffix}")
        for p in planes
    ]
    return blocks.withColumn("col", F.explode(F.sequence(lit(0), lit(7)))).select(*BLOCK_KEYS, "col", *cols)


def covered_cells(owners: DataFrame) -> DataFrame:
    """One row per covered cell of an owner: ``cell`` is the raster block, ``part`` 0 or 1."""
    second = F.when(F.col("raw_strategy") == C.DCT16X8, F.col("block") + F.col("x_blocks")).when(
        F.col("raw_strategy") == C.DCT8X16, F.col("block") + 1
    )
    cells = F.when(F.col("raw_strategy") == C.DCT, F.array("block")).otherwise(F.array(F.col("block"), second))
    return owners.select("*", F.posexplode(cells).alias("part", "cell")).withColumn("part", F.col("part").cast("bigint"))


def constant_grid(frames: DataFrame, value: Column, unit: str = "block") -> DataFrame:
    """A per-frame constant on every block or tile: (frame_id, index, value).

    Raster rows are generated first and cells second, so no generator array exceeds one dimension.
    """
    down, across = ("y_blocks", "x_blocks") if unit == "block" else ("y_tiles", "x_tiles")
    rows = with_geometry(valid_frames(frames)).select(
        "frame_id", F.col(across).alias("_w"), value.cast("bigint").alias("value"),
        F.explode(F.sequence(lit(0), F.col(down) - 1)).alias("_r"),
    )
    cells = rows.select("frame_id", "_w", "_r", "value", F.explode(F.sequence(lit(0), F.col("_w") - 1)).alias("_c"))
    return cells.select("frame_id", (F.col("_r") * F.col("_w") + F.col("_c")).alias("index"), "value")


def samples_as_trace(pixels: DataFrame, frames: DataFrame, stage: int, planes=("r", "g", "b")) -> DataFrame:
    """Channel-major raster trace of the padded planes."""
    shape = with_geometry(frames).select("frame_id", "padded_xsize", "padded_ysize")
    entries = F.array(*[
        F.struct(lit(i).alias("channel"), F.col(p).cast("bigint").alias("value")) for i, p in enumerate(planes)
    ])
    return (
        pixels.join(shape, "frame_id")
        .select("frame_id", "x", "y", "padded_xsize", "padded_ysize", F.inline(entries))
        .select(
            "frame_id", lit(stage).alias("stage"), lit(0).alias("group"),
            ((F.col("channel") * F.col("padded_ysize") + F.col("y")) * F.col("padded_xsize") + F.col("x")).alias("index"),
            "value",
        )
    )


def interleaved_trace(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pass-through pixels: three consecutive entries per pixel in arrival (raster) order."""
    entries = F.array(*[
        F.struct(lit(i).alias("channel"), F.col(p).cast("bigint").alias("value")) for i, p in enumerate("rgb")
    ])
    return (
        pixels.join(frames.select("frame_id", "xsize"), "frame_id")
        .select("frame_id", "x", "y", "xsize", F.inline(entries))
        .select(
            "frame_id", lit(C.STAGES["InputPadded"]).alias("stage"), lit(0).alias("group"),
            ((F.col("y") * F.col("xsize") + F.col("x")) * 3 + F.col("channel")).alias("index"), "value",
        )
    )
