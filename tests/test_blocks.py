import random

import pytest
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions import quant
from blockfield.functions.fixed import lit
from blockfield.operators import cfl, geometry as G, quantize, shape, tokens, transform
from tests import models


def frame_table(spark, xsize, ysize, distance=256):
    return spark.createDataFrame([(0, xsize, ysize, distance, 0, 0, 0, 0, 0)], "frame_id bigint, xsize bigint, ysize bigint, distance_q8 bigint, "
                                 "fixed_raw_quant bigint, fixed_point_scale bigint, fixed_inv_qac_q16 bigint, fixed_ytox bigint, fixed_ytob bigint")


def random_columns(spark, bits, span, xb=4, yb=2, seed=1):
    rng = random.Random(seed)
    grid = {p: [[rng.randint(-span, span) for _ in range(8 * xb)] for _ in range(8 * yb)] for p in "xyb"}
    rows = [
        (0, 0, by * xb + bx, bx, by, col, *[[grid[p][by * 8 + r][bx * 8 + col] for r in range(8)] for p in "xyb"])
        for by in range(yb) for bx in range(xb) for col in range(8)
    ]
    schema = "frame_id bigint, stripe bigint, block bigint, bx bigint, by bigint, col bigint, " + ", ".join(f"{p}_q{bits} array<bigint>" for p in "xyb")
    return grid, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("bits,guard,span", [(12, 0, 8000), (18, 8, 1 << 18), (21, 7, 5 << 21)])
def test_transforms_match_integer_model(spark, bits, guard, span):
    grid, columns = random_columns(spark, bits, span)
    for fn, rows, cols in ((transform.block_transform, 8, 8), (transform.vertical_transform, 16, 8), (transform.horizontal_transform, 8, 16)):
        seen = 0
        for r in fn(columns, bits, guard).groupBy("bx", "by").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "b"))).alias("c")).collect():
            for p in "xyb":
                part = [row[r["bx"] * 8:r["bx"] * 8 + cols] for row in grid[p][r["by"] * 8:r["by"] * 8 + rows]]
                assert [e[p] for e in r["c"]] == models.dct_block(part, rows, cols, bits, guard)
            seen += 1
        assert seen == {(8, 8): 8, (16, 8): 4, (8, 16): 4}[(rows, cols)]


def prepared_blocks(spark, xb, yb, level):
    """Coefficient rows of xb x yb blocks and unit parameters."""
    rows = [(0, by // 8, by * xb + bx, bx, by, k, *level(by * xb + bx, k)) for by in range(yb) for bx in range(xb) for k in range(64)]
    coefficients = spark.createDataFrame(rows, "frame_id bigint, stripe bigint, block bigint, bx bigint, by bigint, k bigint, x bigint, y bigint, b bigint")
    params = coefficients.where("k = 0").select(
        *G.BLOCK_KEYS, lit(0).alias("raw_strategy"), lit(5).alias("quant"), lit(7340).alias("scale_q16"), lit(117029).alias("inv_qac_q16"),
        lit(300646400).alias("inv_dc_x_q16"), lit(37580800).alias("inv_dc_y_q16"), lit(18790400).alias("inv_dc_b_q16"), lit(65536).alias("x_qm_q16"),
        lit(0).alias("ytox"), lit(0).alias("ytob"))
    return coefficients, params


def token_counts(spark, xb, yb, level):
    frames = frame_table(spark, xb * 8, yb * 8)
    tiles = G.constant_grid(frames, lit(0), "tile").select("frame_id", F.col("index").alias("tile"), lit(0).alias("ytox"), lit(0).alias("ytob"))
    blocks = quantize.quantize(*prepared_blocks(spark, xb, yb, level), 16)
    rows = tokens.all_tokens(blocks, tiles, frames).collect()
    for phase in (0, 2, 3):
        groups = sorted(r["group"] for r in rows if r["phase"] == phase)
        assert groups == list(range(len(groups)))
    assert [r["group"] for r in rows if r["last"]] == [max(r["group"] for r in rows if r["phase"] == 3)]
    return [sum(r["phase"] == p for r in rows) for p in range(4)]


def test_zero_block_has_twelve_rows(spark):
    assert token_counts(spark, 1, 1, lambda block, k: (0, 0, 0)) == [3, 1, 5, 3]


def test_dense_frame_row_counts(spark):
    dense = lambda block, k: (1 << 18, 1 << 20, 1 << 22) if k else (0, 0, 0)
    assert token_counts(spark, 9, 9, dense) == [243, 81, 251, 15552]


def test_sparse_frame_row_counts(spark):
    assert token_counts(spark, 9, 9, lambda block, k: (0, 0, 0)) == [243, 81, 251, 243]


def test_ac_stream_matches_scan_model(spark):
    rng = random.Random(11)
    values = {(b, k): tuple(int(rng.gauss(0, 30000)) if rng.random() < 0.4 else 0 for _ in range(3)) for b in range(6) for k in range(64)}
    frames = frame_table(spark, 24, 16)
    blocks = quantize.quantize(*prepared_blocks(spark, 3, 2, lambda b, k: values[b, k]), 16).cache()
    rows = {r["block"]: r for r in blocks.collect()}
    want = []
    for b in range(6):
        for p, ch in (("y", 1), ("x", 0), ("b", 2)):
            n = lambda at: rows[at][f"nnz_{p}"]
            x, y = b % 3, b // 3
            predicted = 32 if b == 0 else n(b - 1) if y == 0 else n(b - 3) if x == 0 else (n(b - 1) + n(b - 3) + 1) >> 1
            want += models.ac_stream(rows[b][f"q_{p}"], predicted, ch)
    got = [(r["context"], r["value"]) for r in tokens.ac_tokens(blocks, frames).orderBy("ordinal").collect()]
    assert got == want


def test_extreme_coefficients_use_exact_arithmetic(spark):
    big = (1 << 31) - 1
    coefficients, params = prepared_blocks(spark, 1, 1, lambda b, k: (big - k, -big + 3 * k, big - 7 * k))
    joined = coefficients.join(params.select("frame_id", "stripe", "block", *quantize.PARAMS), ["frame_id", "stripe", "block"])
    thresholds = quant.quadrant_thresholds(C.THRESHOLD_SQUARE_Q12[C.Y], 8)
    for r in quantize.quantize_coefficients(joined, 16).collect():
        assert r["q_y"] == models.quantize_level(r["y"], C.INV_SQUARE_Y_Q16[r["k"]], 7340, 5, 65536, thresholds[r["k"]], 16)


def test_quant_adjust_golden(spark):
    frames = frame_table(spark, 16, 16)
    cells = spark.createDataFrame([(0, 0, 5, 3), (0, 1, 4, 7), (0, 2, 5, 11), (0, 3, 4, 13)], "frame_id bigint, block bigint, code bigint, raw_quant bigint")
    got = [r["raw_quant"] for r in shape.adjust_quant_field(cells, frames).orderBy("block").collect()]
    assert got == [7, 7, 13, 13]


def decision(spark, costs):
    kinds = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 0, 1)]
    rows = [(0, 0, bx, by, kind, cost, False, True) for (kind, bx, by), cost in zip(kinds, costs)]
    df = spark.createDataFrame(rows, "frame_id bigint, stripe bigint, bx bigint, by bigint, raw_strategy bigint, cost_q16 bigint, overflow boolean, supported boolean")
    return {(r["bx"], r["by"]): r["code"] for r in shape.decide(df).collect()}


def test_shape_ties(spark):
    assert decision(spark, [10] * 4 + [20, 20, 20, 20]) == {(0, 0): 1, (1, 0): 1, (0, 1): 1, (1, 1): 1}
    assert decision(spark, [10] * 4 + [19, 20, 19, 20]) == {(0, 0): 5, (1, 0): 4, (0, 1): 1, (1, 1): 1}
    assert decision(spark, [10] * 4 + [18, 20, 19, 20]) == {(0, 0): 3, (0, 1): 2, (1, 0): 1, (1, 1): 1}


def test_cfl_multiplier_clamps_and_rounds(spark):
    rows = [(1 << 20, -(1 << 40), 4), (0, 0, 0), (1 << 20, 1 << 40, 4), (100, -150, 0), (65536, -98304 - 99, 1)]
    df = spark.createDataFrame(rows, "aa bigint, ab bigint, n bigint")
    assert [r[0] for r in df.select(cfl.multiplier(F.col("aa"), F.col("ab"), F.col("n"))).collect()] == [127, 0, -128, 0, 2]


@pytest.mark.parametrize("xsize,ysize", [(17, 9), (9, 17), (65, 1), (8, 8), (16, 65)])
def test_padding_repeats_edges(spark, xsize, ysize):
    frames = frame_table(spark, xsize, ysize)
    pixels = spark.createDataFrame([(0, x, y, x, y, x * y) for y in range(ysize) for x in range(xsize)], "frame_id bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
    padded = {(r["x"], r["y"]): (r["r"], r["g"], r["block"]) for r in G.pad_frames(pixels, frames).collect()}
    xb, yb = -(-xsize // 8), -(-ysize // 8)
    assert padded == {(x, y): (min(x, xsize - 1), min(y, ysize - 1), y // 8 * xb + x // 8) for y in range(yb * 8) for x in range(xb * 8)}


def test_pixel_stages_shuffle_pixels_once(spark):
    """Everything from padded pixels to coefficients and quantization fields runs in one stripe partitioning."""
    from blockfield.operators import aq

    frames = frame_table(spark, 64, 64)
    pixels = spark.range(8192).selectExpr("id div 4096 as frame_id", "id % 64 as x", "id % 4096 div 64 as y", "id % 256 as r", "id % 199 as g", "id % 101 as b")
    for df in (aq.erosion(aq.block_statistics(G.block_columns(pixels, frames))), transform.horizontal_transform(G.block_columns(pixels, frames))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(frame_id") == 1


def test_jobs_return_what_they_leave_out(spark):
    """A good frame, one with a pixel outside and hence one missing, an unknown frame's pixel, and a frame without a size."""
    from blockfield.plans import jobs

    rows = [(1, x, y, (x * 7 + y * 3) % 256, x % 256, y % 256) for y in range(16) for x in range(16)]
    rows += [(2, x + 100 * (x == y == 3), y, x, y, 9) for y in range(8) for x in range(8)] + [(9, 0, 0, 1, 1, 1)]
    pixels = spark.createDataFrame(rows, "frame_id bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
    one = frame_table(spark, 16, 16).withColumn("frame_id", F.lit(1).cast("bigint"))
    two = frame_table(spark, 8, 8).withColumn("frame_id", F.lit(2).cast("bigint"))
    none = frame_table(spark, 8, 8).withColumn("frame_id", F.lit(3).cast("bigint")).withColumn("ysize", F.lit(0).cast(two.schema["ysize"].dataType))
    frames = one.unionByName(two).unionByName(none)
    for job in (jobs.square_job, jobs.shaped_job):
        tokens, rejects = job(pixels, frames)
        assert 1 in {r.frame_id for r in tokens.select("frame_id").distinct().collect()}
        found = {(r.frame_id, r.rule) for r in rejects.collect()}
        assert {(2, "outside"), (2, "missing_pixels"), (9, "unknown_frame")} <= found and any(f == 3 for f, _ in found) and not any(f == 1 for f, _ in found)


def test_staged_stripes_stay_in_parts_that_grow(spark, monkeypatch):
    """Parts grow with the samples; what follows a stage runs in the one exchange that deals it again, whatever adaptive plans merge."""
    from blockfield.operators import aq
    from blockfield.session import stage

    frames = spark.range(6).selectExpr("id as frame_id", "64L as xsize", "64L as ysize", "256L as distance_q8")
    pixels = spark.range(6 * 4096).selectExpr("id div 4096 as frame_id", "id % 64 as x", "id % 4096 div 64 as y", "id % 256 as r", "id % 199 as g", "id % 101 as b")
    assert G.stripe_parts(pixels, frames) == 3  # so many cores are worth it
    monkeypatch.setattr(G, "PART_SAMPLES", 1 << 11)
    assert G.stripe_parts(pixels, frames) == 12 and G.stripe_parts(pixels.where("frame_id < 3"), frames) == 6
    assert G.stripe_parts(pixels.where("frame_id < 0"), frames) == 2
    columns = stage(G.block_columns(pixels, frames))
    assert columns.rdd.getNumPartitions() == 12
    fields = aq.erosion(aq.block_statistics(G.placed(columns, 12)))
    assert fields._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert fields.rdd.getNumPartitions() == 12 and fields.count() == 384
