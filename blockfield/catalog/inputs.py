"""Inputs derived from the given tables: image frames, prepared coefficient blocks, traces, word streams.

orders      -> frames and pixels: 1440 orders make one frame, alternately 72x20 and 20x72; the remainder is a
               one-row frame, so every order is a pixel.
embeddings  -> blocks: 64 floats are one 8x8 block, 25 blocks a frame; a short last frame is one block high.
events      -> traces: 500 events make one frame.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfield.catalog.base import staged
from blockfield.functions.fixed import lit
from blockfield.functions.masks import inverse_ac_scale
from blockfield.operators.params import with_distance
from blockfield.session import tune, write_table

FRAME_PIXELS = 1440
FRAME_BLOCKS = 25
FRAME_EVENTS = 500
DISTANCES = [64, 128, 256, 300, 512, 1024, 2048]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _distance(frame: str):
    return F.element_at(F.array(*[lit(d) for d in DISTANCES]), (F.col(frame) % 7 + 1).cast("int"))


def order_samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {FRAME_PIXELS}").alias("frame_id"), (F.col("o_orderkey") % FRAME_PIXELS).alias("p"),
        (F.col("o_orderkey") * 37 % 257).alias("r"), (F.col("o_custkey") % 257).alias("g"),
        (F.floor("o_totalprice") % 257).alias("b"),
    )


@staged
def frames(spark, sf_dir) -> DataFrame:
    """One row per frame with its full configuration; a table of its own, as every step of the frame queries reads it."""
    sizes = order_samples(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    even = F.col("frame_id") % 2 == 0
    whole = F.col("n") == FRAME_PIXELS
    f = F.col("frame_id")
    return write_table(sizes.select(
        "frame_id",
        F.when(~whole, F.col("n")).when(even, lit(72)).otherwise(lit(20)).alias("xsize"),
        F.when(~whole, lit(1)).when(even, lit(20)).otherwise(lit(72)).alias("ysize"),
        _distance("frame_id").alias("distance_q8"),
        F.when(f % 5 == 4, lit(6000)).otherwise(lit(0)).alias("fixed_point_scale"),
        F.when((f % 5 == 4) | (f % 5 == 3), lit(102261)).otherwise(lit(0)).alias("fixed_inv_qac_q16"),
        F.when(f % 5 == 3, lit(7)).otherwise(lit(0)).alias("fixed_raw_quant"),
        (f * 7 % 41 - 20).alias("fixed_ytox"), (f * 13 % 51 - 25).alias("fixed_ytob"),
        (f % 2 == 0).alias("enable_xyb"), (f % 3 != 1).alias("enable_dct"), (f % 4 != 2).alias("enable_quant"),
        (f % 5 < 3).alias("enable_tokenize"), (f % 4).alias("token_select"),
    ))


def pixels(spark, sf_dir) -> DataFrame:
    widths = frames(spark, sf_dir).select("frame_id", "xsize")
    return order_samples(spark, sf_dir).join(widths, "frame_id").select(
        "frame_id", (F.col("p") % F.col("xsize")).alias("x"), F.expr("p div xsize").alias("y"), "r", "g", "b"
    )


def embedding_vectors(spark, sf_dir, scale: int) -> DataFrame:
    v = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))


def _block_place(n) -> list:
    """Frame and position of a vector's block, from its id and the number of vectors."""
    full = (F.expr(f"vec_id div {FRAME_BLOCKS}") + 1) * FRAME_BLOCKS <= n
    block = F.col("vec_id") % FRAME_BLOCKS
    return [
        F.expr(f"vec_id div {FRAME_BLOCKS}").alias("frame_id"), lit(0).alias("stripe"), block.alias("block"),
        F.when(full, block % 5).otherwise(block).alias("bx"),
        F.when(full, F.expr(f"(vec_id % {FRAME_BLOCKS}) div 5")).otherwise(lit(0)).alias("by"),
    ]


def _vector_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()


def embedding_blocks(spark, sf_dir, scale: int = 4096) -> DataFrame:
    """(frame_id, stripe, block, bx, by, vec_id, label, x, y, b): luma is the vector itself, X and B the next two."""
    vectors = embedding_vectors(spark, sf_dir, scale)
    luma = vectors.select("vec_id", "label", F.col("v").alias("y")).withColumn("n", _vector_count(spark, sf_dir))
    x = vectors.select(F.col("vec_id").alias("_x"), F.col("v").alias("x"))
    b = vectors.select(F.col("vec_id").alias("_b"), F.col("v").alias("b"))
    joined = luma.withColumns({"_x": (F.col("vec_id") + 1) % F.col("n"), "_b": (F.col("vec_id") + 2) % F.col("n")}).join(x, "_x").join(b, "_b")
    return joined.select(*_block_place(F.col("n")), "vec_id", "label", "x", "y", "b")


def block_keys(spark, sf_dir) -> DataFrame:
    """(frame_id, stripe, block, bx, by, vec_id) of all blocks, without their samples."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id").withColumn("n", _vector_count(spark, sf_dir))
    return rows.select(*_block_place(F.col("n")), "vec_id")


def block_frames(spark, sf_dir) -> DataFrame:
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.expr(f"vec_id div {FRAME_BLOCKS}").alias("frame_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    full = F.col("n") == FRAME_BLOCKS
    f = F.col("frame_id")
    return sizes.select(
        "frame_id", F.when(full, lit(40)).otherwise(F.col("n") * 8).alias("xsize"),
        F.when(full, lit(40)).otherwise(lit(8)).alias("ysize"), _distance("frame_id").alias("distance_q8"),
        (f * 7 % 41 - 20).alias("ytox"), (f * 13 % 51 - 25).alias("ytob"),
    )


def prepared_coefficients(spark, sf_dir) -> DataFrame:
    """Embedding blocks read as Q16 coefficients, one row per index: (BLOCK_KEYS, k, x, y, b)."""
    blocks = embedding_blocks(spark, sf_dir, 65536)
    return blocks.select(
        "frame_id", "stripe", "block", "bx", "by", F.posexplode(F.arrays_zip("x", "y", "b")).alias("k", "c")
    ).select("frame_id", "stripe", "block", "bx", "by", F.col("k").cast("bigint").alias("k"), "c.x", "c.y", "c.b")


def prepared_params(spark, sf_dir) -> DataFrame:
    frames_ = with_distance(block_frames(spark, sf_dir))
    blocks = block_keys(spark, sf_dir)
    quant = F.col("vec_id") % 16 + 1
    return blocks.join(frames_, "frame_id").select(
        "frame_id", "stripe", "block", "bx", "by", lit(0).alias("raw_strategy"), quant.alias("quant"), "scale_q16",
        inverse_ac_scale(F.col("scale_q16"), quant).alias("inv_qac_q16"), "inv_dc_x_q16", "inv_dc_y_q16",
        "inv_dc_b_q16", "x_qm_q16", "ytox", "ytob",
    )


def trace(spark, sf_dir) -> DataFrame:
    """(frame_id, stage, group, index, value, event_id, ts): three token streams per frame, gap-free groups."""
    e = table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FRAME_EVENTS}").alias("frame_id"), (F.col("event_id") % 3 + 10).alias("stage"),
        F.expr(f"(event_id % {FRAME_EVENTS})").alias("_at"), F.col("user_id").alias("index"),
        F.floor("value").alias("value"), "event_id", "ts",
    )
    # Event ids are gap-free, so the rank inside (frame, stage) is arithmetic: how many earlier ids share the residue.
    first = F.expr(f"frame_id * {FRAME_EVENTS}")
    offset = F.pmod(F.col("stage") - 10 - first, lit(3))
    return e.select(
        "frame_id", "stage", "_at", offset.alias("_o"), "index", "value", "event_id", "ts"
    ).select(
        "frame_id", "stage", F.expr("(_at - _o) div 3").alias("group"), "index", "value", "event_id", "ts"
    )


def trace_actual(spark, sf_dir) -> DataFrame:
    """The same trace with value + 1 on every 97th event and every 211th event missing."""
    return trace(spark, sf_dir).where(F.col("event_id") % 211 != 0).withColumn(
        "value", F.col("value") + (F.col("event_id") % 97 == 0).cast("bigint")
    )


def tokens_of(trace_: DataFrame) -> DataFrame:
    return trace_.select(
        "frame_id", F.col("stage").alias("stream"), F.col("group").alias("ordinal"), F.col("index").alias("context"), "value"
    )
