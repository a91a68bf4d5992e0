"""Writers."""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from blockfield.functions import constants as C
from blockfield.functions.color import to_xyb
from blockfield.functions.fixed import int_div, swap_bytes
from blockfield.sources.binary import file_system

TRACE = ["frame_id", "stage", "group", "index", "value"]
WORDS_PER_FILE = 1 << 20


def write_trace(trace: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One directory per stage, so a stage filter reads only its own files."""
    rows = trace.select(*TRACE)
    if fmt == "parquet":
        rows.write.mode("overwrite").partitionBy("stage").parquet(path)
    else:
        rows.select("stage", "group", "index", "value").write.mode("overwrite").option("header", True).csv(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token columns in ordinal order inside range-partitioned files."""
    rows = tokens.select("frame_id", "ordinal", "context", "value")
    rows.repartitionByRange("frame_id", "ordinal").sortWithinPartitions("frame_id", "ordinal").write.mode("overwrite").parquet(path)


def prepared_dc(cells: DataFrame, frames_with_counts: DataFrame) -> DataFrame:
    """(frame_id, ordinal, value): planes Y, X, B one after the other."""
    planes = F.array(*[F.struct(F.lit(i).cast("bigint").alias("rank"), F.col(f"dc_{p}").alias("value")) for i, p in enumerate("yxb")])
    return cells.join(frames_with_counts.select("frame_id", "block_count"), "frame_id").select(
        "frame_id", "block", "block_count", F.inline(planes)
    ).select("frame_id", (F.col("rank") * F.col("block_count") + F.col("block")).alias("ordinal"), "value")


def prepared_ac(quantized: DataFrame) -> DataFrame:
    """(frame_id, block, channel, nonzeros, coefficients) with the coefficients as blank-separated text."""
    planes = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("channel"), F.col(f"nnz_{p}").alias("nonzeros"), F.array_join(F.col(f"q_{p}").cast("array<string>"), " ").alias("coefficients"))
        for i, p in enumerate("xyb")
    ])
    return quantized.select("frame_id", "block", F.inline(planes))


def word_bytes(data, size: int = 16):
    """Little-endian BINARY of a nonnegative DECIMAL(38,0) word."""
    base = F.lit(1 << 32).cast("decimal(20,0)")
    rest, hexed = data.cast("decimal(38,0)"), []
    for _ in range((size + 3) // 4):
        limb = swap_bytes(F.pmod(rest, base).cast("bigint"), 4)
        hexed.append(F.lpad(F.hex(limb), 8, "0"))
        rest = ((rest - F.pmod(rest, base)) / base).cast("decimal(38,0)")
    return F.substring(F.unhex(F.concat(*hexed)), 1, size)


class WordBufferWriter(DataSourceArrowWriter):
    """Word files and last sidecars with task commit: a task writes below its own folder, the job moves what was committed.

    Of a task that runs twice only one attempt reports its files; the folder of the job goes with all others in it, so no
    second file is left, and an aborted job leaves nothing.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("last_suffix", ".last"), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, base = file_system(self.path)
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names, current, outputs = [], None, ()
        for batch in iterator:
            frames, parts = batch.column("frame_id").to_numpy(), batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((frames[1:] != frames[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(frames)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s and (frames[s], parts[s]) != current:
                    for out in outputs:
                        out.close()
                    current = (frames[s], parts[s])
                    names.append(f"frame-{frames[s]:012d}-{parts[s]:06d}.bin")
                    outputs = (system.open_output_stream(f"{folder}/{names[-1]}"), system.open_output_stream(f"{folder}/{names[-1]}{self.suffix}"))
                if e > s:
                    part = batch.slice(s, e - s)
                    outputs[0].write(b"".join(part.column("word").to_pylist()))
                    outputs[1].write(part.column("last").cast(pa.uint8()).to_numpy().tobytes())
        for out in outputs:
            out.close()
        return WrittenFiles(folder, names)

    def commit(self, messages):
        system, base = file_system(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base)):
                if info.type == fs.FileType.File and info.base_name.startswith(("frame-", "_SUCCESS")):
                    system.delete_file(info.path)
        for m in messages:
            for name in m.names if m else ():
                for each in (name, name + self.suffix):
                    system.move(f"{m.folder}/{each}", f"{base}/{each}")
        self._clear()
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clear()

    def _clear(self):
        system, base = file_system(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


@dataclass
class WrittenFiles(WriterCommitMessage):
    """What a committed task has written: its own folder and the names in it."""

    folder: str
    names: list


class WordBuffers(DataSource):
    """``df.write.format("word_buffers")`` of (frame_id, part, word, last) rows sorted by frame and part, option path."""

    @classmethod
    def name(cls):
        return "word_buffers"

    def writer(self, schema, overwrite):
        return WordBufferWriter(self.options, overwrite)


def write_word_buffers(words: DataFrame, path: str, size: int = 16, last_suffix: str = ".last", mode: str = "append") -> None:
    """Raw word files and last sidecars, one pair per frame and million words, below a path or URI every executor sees.

    A file is written whole by one task, a batch of words at a time, and appears when the job commits.
    """
    words.sparkSession.dataSource.register(WordBuffers)
    rows = words.select(
        "frame_id", int_div(F.col("ordinal"), WORDS_PER_FILE).alias("part"), "ordinal", word_bytes(F.col("data"), size).alias("word"), "last"
    ).repartition("frame_id", "part").sortWithinPartitions("frame_id", "part", "ordinal")
    rows.select("frame_id", "part", "word", "last").write.format("word_buffers").option("path", path).option("last_suffix", last_suffix).mode(mode).save()


def write_pfm(pixels: DataFrame, frames: DataFrame, path: str) -> None:
    """One little-endian color float image per frame from (frame_id, x, y, r, g, b) and (frame_id, xsize, ysize).

    Rows go bottom up, so a task holds one batch of samples at a time; a frame is one file and hence one task.  Frames must
    be complete (geometry.rejected_pixels names those that are not).
    """
    rows = pixels.join(frames.select("frame_id", "xsize", "ysize"), "frame_id").select(
        "frame_id", "xsize", "ysize", F.col("y"), F.col("x"), *[F.col(c).cast("float").alias(c) for c in "rgb"])
    ordered = rows.repartition("frame_id").sortWithinPartitions("frame_id", F.desc("y"), "x")

    def store(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        current, sink = None, None
        for batch in batches:
            frames_ = batch.column("frame_id").to_numpy()
            cuts = [0, *(np.flatnonzero(frames_[1:] != frames_[:-1]) + 1).tolist(), len(frames_)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s and frames_[s] != current:
                    if sink:
                        sink.close()
                    current, sink = frames_[s], system.open_output_stream(f"{base}/frame-{frames_[s]:012d}.pfm")
                    sink.write(f"PF\n{batch.column('xsize')[s]} {batch.column('ysize')[s]}\n-1.0\n".encode())
                if e > s:
                    sink.write(np.stack([batch.column(c).to_numpy()[s:e] for c in "rgb"], axis=1).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["samples"])
        if sink:
            sink.close()

    ordered.mapInArrow(store, "samples bigint").agg(F.sum("samples")).first()


def run_summary(verdicts: DataFrame) -> DataFrame:
    """(frame_id, summary): the frame's verdicts as one JSON document."""
    entry = F.struct("stream", "verdict", "len_expected", "len_actual", "mismatches")
    return verdicts.groupBy("frame_id").agg(
        F.to_json(F.struct(F.sum(F.coalesce("mismatches", F.lit(0))).alias("mismatches"), F.array_sort(F.collect_list(entry)).alias("streams"))).alias("summary")
    )


def xyb_fixture(pixels: DataFrame, fraction_bits: int = 12) -> DataFrame:
    """Fixed-point XYB beside the floating-point conversion of the same samples, for tolerance reports."""
    fixed = to_xyb(pixels.select("*", F.col("r").alias("r_q8"), F.col("g").alias("g_q8"), F.col("b").alias("b_q8")), (fraction_bits,))
    lin = [F.col(f"{c}_q8") / 256.0 for c in "rgb"]
    bias = C.OPSIN_BIAS
    roots = [
        F.cbrt(F.greatest(sum((m / float(1 << 26) * v for m, v in zip(row[1:], lin[1:])), row[0] / float(1 << 26) * lin[0]) + bias, F.lit(0.0))) + C.CBRT_NEGATIVE_BIAS
        for row in C.MIX_Q26
    ]
    floats = {"x": (roots[0] - roots[1]) / 2, "y": (roots[0] + roots[1]) / 2, "b": roots[2]}
    return fixed.select("*", *[v.alias(f"{p}_float") for p, v in floats.items()])
