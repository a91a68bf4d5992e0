"""Binary scans: packed word files, float images, token arrays."""

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from blockfield.functions.fixed import lit

WORDS_SCHEMA = "file string, ordinal bigint, word binary, last boolean, error string"


class WordRanges(InputPartition):
    """Word ranges (file, words of the file or None while it grows, first word, words, error) that one task reads."""

    def __init__(self, ranges: list):
        self.ranges = ranges


def file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def packed_into_tasks(ranges: list, words: int) -> list[WordRanges]:
    """Ranges of at most ``words`` words put together in order until a task has about as many: small files share tasks."""
    out, held, size = [], [], 0
    for r in ranges:
        if held and size + r[3] > words:
            out.append(WordRanges(held))
            held, size = [], 0
        held.append(r)
        size += max(r[3], 1)
    return out + ([WordRanges(held)] if held else [])


class _WordFiles:
    """What the batch and the stream reader share: options, the list of files, and reading ranges."""

    def __init__(self, options):
        self.path = options["path"]
        self.word_bytes = int(options.get("word_bytes", 16))
        self.suffix = options.get("last_suffix") or None
        self.chunk = int(options.get("words_per_partition", 1 << 20))

    def files(self) -> list:
        """(path, bytes) of the word files, sorted by path; hidden files and sidecars are left out."""
        from pyarrow import fs

        store, root = file_system(self.path)
        top = store.get_file_info(root)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if top.type == fs.FileType.Directory else [top]
        names = [(i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
        return sorted((n, size) for n, size in names if not (self.suffix and n.endswith(self.suffix)))

    def read(self, part):
        """One batch per range.  The words are one buffer of fixed-size values; no word is touched on its own."""
        names = ["file", "ordinal", "word", "last", "error"]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
        store, _ = file_system(self.path)
        size = self.word_bytes
        for path, total, start, count, error in part.ranges:
            if error:
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((path, None, None, None, error), kinds)], names)
                continue
            with store.open_input_file(path) as handle:
                data = handle.read_buffer(count * size) if not start and handle.size() == count * size else pa.py_buffer(handle.read_at(count * size, start * size))
            words = pa.Array.from_buffers(pa.binary(size), count, [None, data]).cast(pa.binary())
            ordinals = np.arange(start, start + count)
            last, errors = ordinals == (total or 0) - 1, pa.nulls(count, pa.string())
            if self.suffix:
                with store.open_input_file(path + self.suffix) as handle:
                    flags = np.frombuffer(handle.read_at(count, start), dtype=np.uint8)
                    wrong = total is not None and handle.size() != total
                flags = np.pad(flags, (0, count - len(flags)))
                last = flags != 0
                if wrong:
                    errors = pa.repeat("last sidecar length differs", count).cast(pa.string())
                elif (flags > 1).any():
                    errors = pa.array(np.where(flags > 1, "last byte is neither 0 nor 1", None), pa.string())
            file = pa.repeat(path, count).cast(pa.string())
            yield pa.RecordBatch.from_arrays([file, pa.array(ordinals), words, pa.array(last), errors], names)


class PackedWordReader(_WordFiles, DataSourceReader):
    """Fixed-size words cut into byte ranges: one large file feeds many tasks, many small files feed one."""

    def partitions(self):
        ranges = []
        for path, size in self.files():
            words, rest = divmod(size, self.word_bytes)
            if rest or not words:
                ranges.append((path, 0, 0, 0, f"{size} bytes are not whole words"))
            else:
                ranges += [(path, words, s, min(self.chunk, words - s), None) for s in range(0, words, self.chunk)]
        return packed_into_tasks(ranges, self.chunk)


class PackedWordStreamReader(_WordFiles, DataSourceStreamReader):
    """Words of files that grow.  A trigger admits at most ``words_per_trigger`` words, taken from the files read least first.

    The offset is the number of a plan.  A plan names the word ranges of its trigger and how far every file has been
    admitted; it is written to ``plan_dir`` (shared storage) before its number is given out, so a restart from a checkpoint
    reads the very ranges that were planned, and goes on behind them.  Plans before the last committed one are removed.
    Only whole words count, with a sidecar only those whose flag is there.  A file that is shorter than what was read of it
    gives one row with an error each time it shrinks.
    """

    def __init__(self, options):
        super().__init__(options)
        self.limit = int(options.get("words_per_trigger", 1 << 22))
        self.plans = options["plan_dir"]

    def initialOffset(self):
        return {"plan": 0}

    def _plan_numbers(self) -> list[int]:
        from pyarrow import fs

        store, root = file_system(self.plans)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _plan(self, number: int) -> dict:
        store, root = file_system(self.plans)
        with store.open_input_file(f"{root}/{number:012d}.json") as handle:
            return json.loads(handle.read())

    def _admitted(self, admitted: dict) -> tuple[list, dict]:
        """New ranges within the limit, and how far each file is admitted after them."""
        store, _ = file_system(self.path)
        now, ranges, room = dict(admitted), [], self.limit
        for path, size in sorted(self.files(), key=lambda f: (admitted.get(f[0], 0), f[0])):
            words, at = size // self.word_bytes, admitted.get(path, 0)
            if self.suffix:
                words = min(words, max(0, store.get_file_info(path + self.suffix).size or 0))
            if words < at:
                ranges.append((path, None, words, 0, f"{at} words were read, {words} are left"))
                now[path] = words
            elif words > at and room > 0:
                n = min(words - at, room)
                ranges += [(path, None, s, min(self.chunk, at + n - s), None) for s in range(at, at + n, self.chunk)]
                now[path], room = at + n, room - n
        return ranges, now

    def latestOffset(self):
        numbers = self._plan_numbers()
        last = numbers[-1] if numbers else 0
        ranges, admitted = self._admitted(self._plan(last)["admitted"] if last else {})
        if not ranges:
            return {"plan": last}
        store, root = file_system(self.plans)
        store.create_dir(root, recursive=True)
        name = f"{root}/{last + 1:012d}.json"
        with store.open_output_stream(name + ".part") as sink:
            sink.write(json.dumps({"ranges": ranges, "admitted": admitted}).encode())
        store.move(name + ".part", name)
        return {"plan": last + 1}

    def partitions(self, start, end):
        ranges = [r for k in range(start["plan"] + 1, end["plan"] + 1) for r in self._plan(k)["ranges"]]
        return packed_into_tasks(ranges, self.chunk)

    def commit(self, end):
        store, root = file_system(self.plans)
        for k in self._plan_numbers():
            if k < end["plan"]:
                store.delete_file(f"{root}/{k:012d}.json")


class PackedWords(DataSource):
    """``spark.read`` or ``spark.readStream`` with format ``packed_words`` and options word_bytes, last_suffix,
    words_per_partition, and for streams words_per_trigger and plan_dir."""

    @classmethod
    def name(cls):
        return "packed_words"

    def schema(self):
        return WORDS_SCHEMA

    def reader(self, schema):
        return PackedWordReader(self.options)

    def streamReader(self, schema):
        return PackedWordStreamReader(self.options)


def read_words_bin(spark: SparkSession, path: str, word_bytes: int = 16, last_suffix: str = None) -> DataFrame:
    """(file, ordinal, word, last, error); without a sidecar only the final word of a file is last."""
    spark.dataSource.register(PackedWords)
    reader = spark.read.format("packed_words").option("path", path).option("word_bytes", str(word_bytes))
    return (reader.option("last_suffix", last_suffix) if last_suffix else reader).load()


def stream_words_bin(spark: SparkSession, path: str, plan_dir: str, word_bytes: int = 16, last_suffix: str = None, words_per_trigger: int = 1 << 22) -> DataFrame:
    """The words of growing files as a stream, each once: (file, ordinal, word, last, error); ``plan_dir`` belongs to the query,
    like its checkpoint.  Without a sidecar no word is known to be last."""
    spark.dataSource.register(PackedWords)
    options = {"path": path, "plan_dir": plan_dir, "word_bytes": word_bytes, "words_per_trigger": words_per_trigger, **({"last_suffix": last_suffix} if last_suffix else {})}
    return spark.readStream.format("packed_words").options(**options).load()


def _pfm_image(content: bytes) -> np.ndarray:
    """Samples (y, x, channel) with the first row on top; raises ValueError with the fault."""
    handle = io.BytesIO(content)
    if handle.readline().strip() != b"PF":
        raise ValueError("not a color PFM")
    try:
        width, height = map(int, handle.readline().split())
        order = "<f4" if float(handle.readline()) < 0 else ">f4"
    except ValueError:
        raise ValueError("bad header") from None
    body = handle.read(width * height * 12)
    if width <= 0 or height <= 0 or len(body) < width * height * 12:
        raise ValueError("truncated")
    return np.frombuffer(body, dtype=order).astype("f4").reshape(height, width, 3)[::-1]


def _pfm_rows(batches):
    floats = pa.list_(pa.float32())
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            try:
                rows, error = _pfm_image(content), None
            except ValueError as fault:
                rows, error = [None], str(fault)
            for y, row in enumerate(rows):
                planes = [pa.array([None if error else row[:, c].tolist()], floats) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None if error else y], pa.int64()), *planes, pa.array([error], pa.string())], ["file", "y", "r", "g", "b", "error"])


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    """(file, y, x, r, g, b, error) float samples of color PFM images; a file that is none or is cut short is one error row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInArrow(_pfm_rows, "file string, y bigint, r array<float>, g array<float>, b array<float>, error string")
    flat = rows.select("file", "y", "error", F.posexplode_outer(F.arrays_zip("r", "g", "b")).alias("x", "s"))
    return flat.select("file", "y", F.col("x").cast("bigint").alias("x"), "s.r", "s.g", "s.b", "error")


def _array_rows(batches):
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            values = np.load(io.BytesIO(content), allow_pickle=False)
            error = None if values.ndim == 2 and np.issubdtype(values.dtype, np.integer) else f"shape {values.shape} {values.dtype}"
            if error:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([error])], ["file", "row", "v", "error"])
                continue
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array(np.arange(n), pa.int64()), pa.array(values.astype("i8").tolist(), pa.list_(pa.int64())), pa.nulls(n, pa.string())],
                ["file", "row", "v", "error"],
            )


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, v, error): rows of two-dimensional integer array files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_array_rows, "file string, row bigint, v array<bigint>, error string")


def read_token_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, context, value, error) from (n, 2) arrays, range-checked to uint32."""
    a = read_arrays(spark, path)
    context, value = F.try_element_at("v", F.lit(1)), F.try_element_at("v", F.lit(2))
    bad = F.coalesce(
        F.col("error"), F.when(F.size("v") != 2, F.lit("expected two columns")),
        F.when(~context.between(0, (1 << 32) - 1), F.lit("context outside uint32")),
        F.when(~value.between(0, (1 << 32) - 1), F.lit("value outside uint32")),
    )
    return a.select("file", F.col("row").alias("ordinal"), context.alias("context"), value.alias("value"), bad.alias("error"))


def read_grids(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(file, row, col, value, error) from 2-D integer arrays with a value range."""
    a = read_arrays(spark, path).select("file", "row", "error", F.posexplode_outer("v").alias("col", "value"))
    bad = F.coalesce(F.col("error"), F.when(~F.col("value").between(low, high), F.lit("value out of range")))
    return a.select("file", "row", F.col("col").cast("bigint").alias("col"), "value", bad.alias("error"))


def synth_frames(spark: SparkSession, specs: DataFrame) -> DataFrame:
    """Float test images from (frame_id, pattern, xsize, ysize, seed).

    Patterns: constant, gradient, checkerboard (4-pixel squares), impulse, random.
    """
    rows = specs.select("*", F.explode(F.sequence(lit(0), F.col("ysize") - 1)).alias("y"))
    px = rows.select("*", F.explode(F.sequence(lit(0), F.col("xsize") - 1)).alias("x"))
    x, y, w, h = (F.col(c) for c in ("x", "y", "xsize", "ysize"))
    ramp_x, ramp_y = x / F.greatest(w - 1, lit(1)), y / F.greatest(h - 1, lit(1))
    square = ((F.floor(x / 4) + F.floor(y / 4)) % 2).cast("double")
    centre = ((x == F.floor(w / 2)) & (y == F.floor(h / 2))).cast("double")
    noise = lambda c: F.pmod(F.xxhash64("seed", "frame_id", "x", "y", F.lit(c)), lit(1 << 24)) / float(1 << 24)
    pick = lambda constant, gradient, c: (
        F.when(F.col("pattern") == "constant", F.lit(constant)).when(F.col("pattern") == "gradient", gradient)
        .when(F.col("pattern") == "checkerboard", square).when(F.col("pattern") == "impulse", centre).otherwise(noise(c))
    )
    return px.select("frame_id", "x", "y", pick(0.25, ramp_x, "r").alias("r"), pick(0.5, ramp_y, "g").alias("g"),
                     pick(0.75, (ramp_x + ramp_y) / 2, "b").alias("b"))
