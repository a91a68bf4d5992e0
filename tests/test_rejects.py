"""Faulty inputs become rows; nothing is dropped in silence."""

import pytest
from pyspark.sql import functions as F

from blockfield import session
from blockfield.functions import quant
from blockfield.functions.fixed import lit
from blockfield.operators import aq, compare
from blockfield.operators import geometry as G
from blockfield.operators import trace as T
from blockfield.sources import binary, sinks, text

TOKENS = "frame_id bigint, stream bigint, ordinal bigint, context bigint, value bigint"


def test_a_wide_frame_keeps_its_pixels(spark):
    frames = spark.createDataFrame([(1, 70000, 1), (2, 0, 5)], "frame_id bigint, xsize bigint, ysize bigint")
    pixels = spark.range(70000).selectExpr("1L AS frame_id", "id AS x", "0L AS y", "1L AS r", "1L AS g", "1L AS b")
    more = spark.createDataFrame([(1, -1, 0), (1, 5, 1), (2, 0, 0), (3, 0, 0), (1, 7, 0)], "frame_id bigint, x bigint, y bigint").selectExpr("*", "1L AS r", "1L AS g", "1L AS b")
    assert G.pad_frames(pixels, frames).count() == 70000 * 8
    rows = {tuple(r) for r in G.job_rejects(pixels.unionByName(more), frames).collect()}
    assert rows == {(2, "overflow", "0x5"), (1, "outside", "-1,0"), (1, "outside", "5,1"), (2, "unknown_frame", "0,0"), (3, "unknown_frame", "0,0"), (1, "duplicate", "7,0")}
    short = G.rejected_pixels(pixels.where("x <> 3"), frames.where("frame_id = 1")).collect()
    assert [tuple(r) for r in short] == [(1, "missing_pixels", "1")]


def test_repeated_ordinals_are_a_verdict(spark):
    clean = [(1, 10, i, 0, i) for i in range(3)]
    twice = spark.createDataFrame(clean + [clean[0]], TOKENS)
    rows = compare.compare_runs(twice, spark.createDataFrame(clean, TOKENS)).collect()
    assert [(r.len_expected, r.len_actual, r.verdict, r.mismatches) for r in rows] == [(4, 3, "duplicate", None)]
    grid = "frame_id bigint, row bigint, col bigint, value bigint"
    verdict = compare.compare_grids(spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 5)], grid), spark.createDataFrame([(1, 0, 0, 5)], grid)).collect()
    assert [r.same_shape for r in verdict] == [False]


def test_negative_and_far_ordinals(spark):
    schema = "frame_id bigint, stage bigint, `group` bigint, `index` bigint, value bigint"
    rows = [(1, 11, g, 0, 0) for g in (-1, 0, 1, 3, 9000, 1 << 40)]
    tokens, rejects = T.extract_tokens(spark.createDataFrame(rows, schema), "AcMetadataTokens")
    assert sorted(r.ordinal for r in tokens.collect()) == [0, 1, 3, 9000, 1 << 40]
    ranges = {tuple(r) for r in T.missing_ranges(tokens, ["frame_id"]).collect()}
    assert ranges == {(1, 2, 2), (1, 4, 8999), (1, 9001, (1 << 40) - 1)}
    found = rejects.where("rule <> 'missing'").collect()
    assert {(r.rule, r.detail) for r in found} == {("negative_ordinal", "-1"), ("missing_range", f"9001-{(1 << 40) - 1}")}
    near = spark.createDataFrame(rows[:5], schema)
    missing = T.missing_ordinals(T.extract_tokens(near, "AcMetadataTokens")[0], ["frame_id"])
    assert sorted(r.ordinal for r in missing.collect()) == [2, *range(4, 9000)]


def test_csv_columns_are_found_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stage,group,index,value\n10,1,2,3\nx,1,2,3\n")
    (tmp_path / "b.csv").write_text("Value, index ,extra,group,stage\n3,2,9,1,10\n")
    rows = text.read_trace_csv(spark, str(tmp_path)).collect()
    assert sorted((r["stage"] or 0, r["group"], r["index"], r["value"], r["_line"], list(r["_errors"])) for r in rows) == [
        (0, 1, 2, 3, 3, ["bad_stage"]), (10, 1, 2, 3, 2, []), (10, 1, 2, 3, 2, [])]
    (tmp_path / "c.csv").write_text("stage,group\n1,2\n")
    with pytest.raises(ValueError, match="index, value"):
        text.read_trace_csv(spark, str(tmp_path))


def test_documents_with_faults_stay_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"frame_id": 1, "format": "rgb_manifest.v1"}\n{"frame_id": 2, "format": "other.v1"}\n{broken\n')
    rows = text.read_manifests(spark, str(tmp_path), suffix="_manifest.v1", multi_line=False).collect()
    assert sorted((r.frame_id or 0, list(r.errors)) for r in rows) == [(0, ["malformed"]), (1, []), (2, ["format"])]
    image = '"image": {"xsize": 8, "ysize": 8, "x_blocks": 1, "y_blocks": 1, "x_tiles": 1, "y_tiles": 1}'
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "t.json").write_text(f'{{"frame_id": 1, {image}, "dc_samples": [1, 2], "ac_blocks": []}}\n{{"frame_id": 2}}\n{{"frame_id": 3, {image}, "dc_samples": [1, 2, 9999999999], "ac_blocks": [{{"num_nonzeros": [64], "quantized": [[0]]}}]}}\n')
    dc, ac, rejects = text.read_prepared_tokens_json(spark, str(tmp_path / "t"), multi_line=False)
    assert sorted((r.frame_id, r.rule) for r in rejects.collect()) == [
        (1, "block_count"), (1, "dc_count"), (2, "image"), (3, "coefficients"), (3, "dc_range"), (3, "nonzero_count"), (3, "nonzero_range")]
    assert dc.count() == 3 and ac.count() == 1


def test_float_images_with_faults(spark, tmp_path):
    (tmp_path / "a.pfm").write_bytes(b"PF\n1 1\n-1.0\n" + b"\0" * 12)
    (tmp_path / "b.pfm").write_bytes(b"Pf\n1 1\n-1.0\n" + b"\0" * 4)
    (tmp_path / "c.pfm").write_bytes(b"PF\n2 2\n-1.0\n" + b"\0" * 12)
    rows = binary.read_pfm(spark, str(tmp_path)).collect()
    assert sorted((r.file[-5], r.error or "") for r in rows) == [("a", ""), ("b", "not a color PFM"), ("c", "truncated")]


def test_luma_beyond_62_bits(spark):
    q, k, s, inv = (F.col(c) for c in ("q", "k", "s", "inv"))
    rows = [((1 << 31) - 1, 63, 0, (1 << 32) - 1), (-(1 << 31), 63, 0, 65536), (1, 0, 0, 65536)]
    df = spark.createDataFrame(rows, "q bigint, k bigint, s bigint, inv bigint").select("q", quant.reconstruct_luma(q, k, s, inv, 16).alias("v"), quant.dequantize_bias(q).alias("p"),
                                                                                     F.when(s == 0, quant.lookup(quant.C.WEIGHT_SQUARE_Y_Q32, k)).alias("w"), "inv")
    for r in df.collect():
        exact = (r.p * r.w * r.inv) >> 48
        assert r.v == (exact if abs(exact) < 1 << 63 else None)


def test_windows_are_clamped(spark):
    frames = spark.createDataFrame([(1, 16, 80)], "frame_id bigint, xsize bigint, ysize bigint")
    cells = spark.range(80).selectExpr("1L AS frame_id", "id % 4 AS cell_x", "id DIV 4 AS cell_y", "id AS contrast_q16")
    got = {(r.cell_x, r.cell_y): r.around for r in aq.neighbourhood(cells, frames).collect()}
    for (x, y), around in got.items():
        low, high = y // 16 * 16, min(y // 16 * 16 + 16, 20) - 1
        assert around == sorted(min(max(y + j, low), high) * 4 + min(max(x + i, 0), 3) for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_word_files_by_uri(spark, tmp_path):
    words = spark.range(5).select(lit(3).alias("frame_id"), F.col("id").alias("ordinal"), (F.col("id") + 256).cast("decimal(38,0)").alias("data"), (F.col("id") == 4).alias("last"))
    for size in (11, 16):
        sinks.write_word_buffers(words, f"file://{tmp_path}/w{size}", size)
        data = (tmp_path / f"w{size}" / "frame-000000000003-000000.bin").read_bytes()
        assert [int.from_bytes(data[i * size : (i + 1) * size], "little") for i in range(5)] == list(range(256, 261))
        assert (tmp_path / f"w{size}" / "frame-000000000003-000000.bin.last").read_bytes() == b"\0\0\0\0\1"


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None), "set": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        session.work_dir(Session)
