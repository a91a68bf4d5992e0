import numpy as np
from pyspark.sql import functions as F

from blockfield.operators import compare, trace as T
from blockfield.sources import binary, sinks, text


def pack(stage, group, index, value):
    return stage | group << 8 | index << 24 | (value & 0xFFFFFFFF) << 56


def csv(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_decode_goldens(spark, tmp_path):
    path = csv(tmp_path, "w.csv", f"data,last\n{pack(12, 3, 4, -7)},0\n{hex(pack(12, 4, 5, 11))},1\n")
    words = text.read_words_csv(spark, path).withColumn("frame_id", F.lit(0).cast("bigint"))
    rows = T.decode_trace(words, require_final_last=True).orderBy("ordinal").collect()
    assert [(r["stage"], r["group"], r["index"], r["value"], r["last"], r["errors"]) for r in rows] == [(12, 3, 4, -7, False, []), (12, 4, 5, 11, True, [])]


def test_decode_rejects(spark, tmp_path):
    path = csv(tmp_path, "w.csv", f"TDATA,tlast\nbad,1\n5,maybe\n-3,no\n{1 << 88},yes\n")
    rows = text.read_words_csv(spark, path).orderBy("ordinal").collect()
    assert [r["_errors"] for r in rows] == [["bad_data"], ["bad_last"], ["bad_data"], []]
    frame = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 0, True)], "frame_id bigint, ordinal bigint, last boolean")
    flags = {(r["frame_id"], r["ordinal"]): r["last_error"] for r in T.flag_last(frame).collect()}
    assert flags == {(0, 0): "early_last", (0, 1): "missing_last", (1, 0): None}
    wide = T.unpack_words(spark.sql(f"select cast('{1 << 88}' as decimal(38,0)) as data")).collect()
    assert wide[0]["oversized"]


def test_binary_words_of_both_sizes_and_ranges(spark, tmp_path):
    for size in (11, 16):
        folder = tmp_path / f"b{size}"
        folder.mkdir()
        words = [pack(10, 1, 2, -3), pack(6, 40000, 5, 6)]
        (folder / "a.bin").write_bytes(b"".join(w.to_bytes(size, "little") for w in words))
        df = T.unpack_binary(binary.read_words_bin(spark, str(folder), size).drop("error"))
        rows = [(r["stage"], r["group"], r["index"], r["value"], r["last"]) for r in df.orderBy("ordinal").collect()]
        assert rows == [(10, 1, 2, -3, False), (6, 40000, 5, 6, True)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.bin").write_bytes(b"12345")
    assert "whole words" in binary.read_words_bin(spark, str(tmp_path / "bad"), 16).collect()[0]["error"]


def test_word_buffers_round_trip(spark, tmp_path):
    values = [(0, i, pack(i % 21, i, i * i, -i), i == 299) for i in range(300)]
    df = spark.createDataFrame([(f, o, str(d), e) for f, o, d, e in values], "frame_id bigint, ordinal bigint, data string, last boolean").withColumn("data", F.col("data").cast("decimal(38,0)"))
    sinks.write_word_buffers(df, str(tmp_path / "out"))
    back = binary.read_words_bin(spark, str(tmp_path / "out"), 16, ".last").collect()
    assert sorted((r["ordinal"], int.from_bytes(r["word"], "little"), r["last"]) for r in back) == [(o, d, e) for _, o, d, e in values]


def test_trace_csv_names_and_bases(spark, tmp_path):
    path = csv(tmp_path, "t.csv", "stage,group,index,value\nAcTokens,0x10,0b11,-5\n12,1,2,3\nNope,1,x,2\n")
    rows = text.read_trace_csv(spark, path).orderBy("_line").collect()
    assert [(r["stage"], r["group"], r["index"], r["value"]) for r in rows[:2]] == [(12, 16, 3, -5), (12, 1, 2, 3)]
    assert rows[2]["_errors"] == ["bad_stage", "bad_index"]


def runs(spark, pairs):
    return spark.createDataFrame([(0, 12, i, c, v) for i, (c, v) in enumerate(pairs)], "frame_id bigint, stream bigint, ordinal bigint, context bigint, value bigint")


def test_compare_golden(spark):
    r = compare.compare_runs(runs(spark, [(1, 0), (2, 7), (3, 11)]), runs(spark, [(1, 0), (2, 8), (4, 11)])).collect()[0]
    assert (r["verdict"], r["mismatches"], r["first_ordinal"]) == ("values", 2, 1)
    assert (r["first_actual_context"], r["first_actual_value"], r["first_expected_context"], r["first_expected_value"]) == (2, 8, 2, 7)
    r = compare.compare_runs(runs(spark, [(1, 0), (2, 7)]), runs(spark, [(9, 9)])).collect()[0]
    assert (r["verdict"], r["mismatches"], r["len_expected"], r["len_actual"]) == ("length", None, 2, 1)
    r = compare.compare_runs(runs(spark, [(1, 0), (2, 7)]), runs(spark, [(1, 1), (2, 6)]), max_value_delta=1).collect()[0]
    assert (r["verdict"], r["mismatches"]) == ("equal", 0)


def test_extract_reports_every_rule(spark):
    rows = [(0, 12, 0, 1, 1), (0, 12, 0, 1, 1), (0, 12, 2, -1, 4), (0, 12, 5, 1, 1 << 33), (0, 12, 6, 1, 1)]
    trace = spark.createDataFrame(rows, "frame_id bigint, stage bigint, group bigint, index bigint, value bigint")
    tokens, rejects = T.extract_tokens(trace, "AcTokens")
    assert sorted((r["rule"], r["detail"]) for r in rejects.collect()) == [
        ("duplicate", "0"), ("missing", "1"), ("missing", "2"), ("missing", "3"), ("missing", "4"), ("missing", "5"), ("negative_context", "2"), ("value_range", "5")]
    assert tokens.count() == 3


def test_missing_ordinals_cross_chunks(spark):
    rows = [(0, o) for o in range(3 * T.DOMAIN_CHUNK) if o % 1000 != 7]
    df = spark.createDataFrame(rows, "frame_id bigint, ordinal bigint")
    assert sorted(r["ordinal"] for r in T.missing_ordinals(df, ["frame_id"]).collect()) == list(range(7, 3 * T.DOMAIN_CHUNK, 1000))


def test_first_byte(spark):
    side = lambda items: spark.createDataFrame([(k, bytearray(v)) for k, v in items], "key int, content binary")
    got = {r["key"]: r["first_difference"] for r in compare.first_byte_difference(
        side([(1, b"abc"), (2, b"abc"), (3, b"abc"), (4, b"")]), side([(1, b"abc"), (2, b"abd"), (3, b"ab"), (4, b"x")])).collect()}
    assert got == {1: None, 2: 2, 3: 2, 4: 0}


def test_float_images_and_arrays(spark, tmp_path):
    image = np.arange(2 * 3 * 3, dtype="<f4").reshape(2, 3, 3)
    (tmp_path / "a.pfm").write_bytes(b"PF\n3 2\n-1.0\n" + image[::-1].tobytes())
    rows = binary.read_pfm(spark, str(tmp_path / "a.pfm")).orderBy("y", "x").collect()
    assert [(r["r"], r["g"], r["b"]) for r in rows] == [tuple(map(float, p)) for p in image.reshape(-1, 3)]
    np.save(tmp_path / "t.npy", np.array([[1, 2], [3, -4]]))
    tokens = binary.read_token_arrays(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["context"], r["value"], r["error"]) for r in tokens] == [(1, 2, None), (3, -4, "value outside uint32")]
    grid = binary.read_grids(spark, str(tmp_path), -128, 127).count()
    assert grid == 4


def test_common_frames_once_and_without_a_held_side(spark):
    """Each common frame once, null among them; rows are one per frame before the shuffle and no join holds a side with its repeats."""
    given = lambda ids: spark.createDataFrame([(i,) for i in ids], "frame_id bigint")
    common = compare.common_frames(given([1, 1, 2, None, None, 5]), given([5, 5, None, 1, 7]))
    plan = common._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["frame_id"] for r in common.collect()), key=str) == [1, 5, None]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert compare.common_frames(given([3]), given([])).count() == 0
