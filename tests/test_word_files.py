"""Word files: the committing sink, packed reading of small files, and growing files as a stream that survives restarts."""

import os
from decimal import Decimal
from types import SimpleNamespace

import pyarrow as pa
import pytest

from blockfield.sources import binary, sinks

WORDS = "frame_id bigint, ordinal bigint, data decimal(38,0), last boolean"


def listing(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def batches(frames, n=5):
    for f in frames:
        yield pa.RecordBatch.from_arrays([pa.array([f] * n), pa.array([0] * n), pa.array([bytes([f, i] + [0] * 14) for i in range(n)], pa.binary()), pa.array([i == n - 1 for i in range(n)])],
                                         ["frame_id", "part", "word", "last"])


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    writer = sinks.WordBufferWriter({"path": str(tmp_path)}, False)
    lost, kept, other = writer.write(batches([1, 2])), writer.write(batches([1, 2])), writer.write(batches([3]))
    writer.commit([kept, other])
    names = [f"frame-{k:012d}-000000.bin{s}" for k in (1, 2, 3) for s in ("", ".last")]
    assert listing(tmp_path) == sorted(["_SUCCESS", *names]) and lost.folder != kept.folder
    assert (tmp_path / names[0]).read_bytes() == b"".join(bytes([1, i] + [0] * 14) for i in range(5)) and (tmp_path / names[1]).read_bytes() == b"\0\0\0\0\1"


def test_an_aborted_job_leaves_nothing(tmp_path):
    writer = sinks.WordBufferWriter({"path": str(tmp_path)}, False)
    writer.abort([writer.write(batches([1])), None])
    assert listing(tmp_path) == [] and os.listdir(tmp_path) == []


def test_overwrite_and_append(spark, tmp_path):
    rows = lambda frames: spark.createDataFrame([(f, i, Decimal(f * 256 + i), i == 2) for f in frames for i in range(3)], WORDS)
    path = str(tmp_path / "w")
    for mode, frames in (("append", [1, 2]), ("append", [3]), ("overwrite", [4])):
        sinks.write_word_buffers(rows(frames), path, mode=mode)
        found = {int(f[6:18]) for f in listing(path) if f.endswith(".bin")}
        assert found == {"append": {1, 2} if 1 in frames else {1, 2, 3}, "overwrite": {4}}[mode]
    sinks.write_word_buffers(rows([]), str(tmp_path / "none"))
    assert binary.read_words_bin(spark, path, 16, ".last").where("error IS NULL").count() == 3


def test_small_files_share_tasks_and_large_ones_are_cut(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"s{k:02d}.bin").write_bytes(bytes([k]) * 16 * (k % 4 + 1))
    (tmp_path / "large.bin").write_bytes(b"".join(i.to_bytes(16, "little") for i in range(250)))
    (tmp_path / "torn.bin").write_bytes(b"x" * 17)
    (tmp_path / "empty.bin").write_bytes(b"")
    reader = binary.PackedWordReader({"path": str(tmp_path), "words_per_partition": "100"})
    parts = reader.partitions()
    assert len(parts) <= 6 and max(sum(r[3] for r in p.ranges) for p in parts) <= 100
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    words = [r for r in rows if r["error"] is None]
    assert len(words) == 250 + 150 and {os.path.basename(r["file"]) for r in rows if r["error"]} == {"torn.bin", "empty.bin"}
    large = [r for r in words if r["file"].endswith("large.bin")]
    assert [(r["ordinal"], int.from_bytes(r["word"], "little"), r["last"]) for r in large] == [(i, i, i == 249) for i in range(250)]
    assert spark.createDataFrame([(1,)], "a int").sparkSession and binary.read_words_bin(spark, str(tmp_path)).where("error IS NULL").count() == 400


def append(path, start, n, flags=True):
    with open(path, "ab") as sink:
        sink.write(b"".join(i.to_bytes(16, "little") for i in range(start, start + n)))
    if flags:
        with open(f"{path}.last", "ab") as sink:
            sink.write(bytes(i % 10 == 9 for i in range(start, start + n)))


def test_plans_admit_a_bounded_number_and_resume(tmp_path):
    path, plans = tmp_path / "in", tmp_path / "plans"
    path.mkdir()
    options = {"path": str(path), "plan_dir": str(plans), "words_per_trigger": "100", "last_suffix": ".last"}
    append(path / "a.bin", 0, 250)
    append(path / "b.bin", 0, 30)
    reader = binary.PackedWordStreamReader(options)
    seen, start = [], reader.initialOffset()
    for step in range(20):
        reader = binary.PackedWordStreamReader(options)  # every trigger as after a restart
        end = reader.latestOffset()
        if end == start:
            break
        rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        assert len(rows) <= 100
        assert rows == [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]  # a replay reads the same
        seen += [(os.path.basename(r["file"]), r["ordinal"], r["last"]) for r in rows]
        reader.commit(end)
        start = end
        if step == 1:
            append(path / "b.bin", 30, 5)
            append(path / "b.bin", 35, 7, flags=False)  # words without flags wait
    assert sorted(seen) == sorted([("a.bin", i, i % 10 == 9) for i in range(250)] + [("b.bin", i, i % 10 == 9) for i in range(35)])
    assert len(listing(plans)) == 1
    (path / "b.bin").write_bytes(b"\0" * 16)
    (path / "b.bin.last").write_bytes(b"\0")
    end = binary.PackedWordStreamReader(options).latestOffset()
    shrunk = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["ordinal"], r["error"]) for r in shrunk] == [(None, "35 words were read, 1 are left")]


def test_a_stream_over_growing_files_survives_a_restart(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()

    def run():
        stream = binary.stream_words_bin(spark, str(path), str(tmp_path / "plans"), words_per_trigger=64)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).start(str(tmp_path / "out"))
        try:
            query.processAllAvailable()
            return query.lastProgress
        finally:
            query.stop()

    append(path / "a.bin", 0, 150, flags=False)
    run()
    append(path / "a.bin", 150, 80, flags=False)
    append(path / "c.bin", 0, 70, flags=False)
    run()
    rows = spark.read.schema(binary.WORDS_SCHEMA).parquet(str(tmp_path / "out")).collect()
    got = sorted((os.path.basename(r["file"]), r["ordinal"], int.from_bytes(r["word"], "little")) for r in rows)
    assert got == sorted([("a.bin", i, i) for i in range(230)] + [("c.bin", i, i) for i in range(70)])


def test_staged_work_can_be_deleted(spark, tmp_path, monkeypatch):
    from blockfield import session

    monkeypatch.setattr(session, "_MADE", [])
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    one, two = session.write_table(spark.range(5)), session.write_table(spark.range(3))
    assert one.count() == 5 and two.count() == 3
    (tmp_path / "other").mkdir()
    assert session.clean_work() == 2 and os.listdir(tmp_path) == ["other"] and session.clean_work() == 0


def test_without_a_named_folder_local_mode_makes_one(monkeypatch):
    from blockfield import session

    monkeypatch.setattr(session, "_LOCAL", [])
    named = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    first = session.shared_folder(named("local[2]"))
    assert os.path.isdir(first) and session.shared_folder(named("local")) == first
    assert session.shared_folder(named("spark://x", "hdfs://y/z")) == "hdfs://y/z"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(named("spark://x"))
