"""Token sequences of equal length in Arrow files, and their way back.

A file holds record batches of two fixed-size lists, ``ids`` (uint16 if the vocabulary fits, else uint32) and ``mask`` (bool),
BATCH rows each: the ids of its artifacts one after the other, cut every ``length`` tokens, the last row padded with zeros and masked.  Fixed sizes make
the place of any sequence plain arithmetic, so a reader maps the file and takes rows without copying.  Beside it a
``.docs`` file names the artifacts in order: key, start inside the file, number of ids.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.counting import encode
from blockfield.llm.counting import tokenizer as vocabulary
from blockfield.llm.shared import partitions, staged
from blockfield.session import work_dir

LENGTH = 2048
END = 1
BATCH = 64
MANIFEST = "file string, first_key bigint, last_key bigint, artifacts bigint, tokens bigint"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def id_type(tokenizer: str, end: int) -> str:
    return "u2" if max(end, *vocabulary(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else "u4"


def sequence_schema(length: int, kind: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


class SequenceWriter:
    """Writes ids of one file in batches; holds at most one batch and one artifact."""

    def __init__(self, folder: str, length: int, kind: str):
        self.system, base = _filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.arrow"
        self.length, self.schema, self.tokens, self.held, self.size = length, sequence_schema(length, kind), 0, [], 0
        self.sink = self.system.open_output_stream(_filesystem(self.name)[1])
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.system.open_output_stream(_filesystem(self.name)[1] + ".docs")
        self.index = pa.ipc.new_file(self.index_sink, DOCS)

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        if self.size >= self.length * BATCH:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % (self.length * BATCH)
            for at in range(0, cut, self.length * BATCH):
                self._rows(whole[at : at + self.length * BATCH], self.length * BATCH)
            self.held, self.size = [whole[cut:]], len(whole) - cut

    def names(self, keys: list, counts: list[int]) -> None:
        """Enter the artifacts just added."""
        starts = self.tokens - sum(counts) + np.cumsum([0] + counts[:-1])
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))

    def close(self) -> None:
        if self.size:
            whole = np.concatenate(self.held)
            padded = np.zeros(-(-len(whole) // self.length) * self.length, whole.dtype)
            padded[: len(whole)] = whole
            self._rows(padded, len(whole))
        for each in (self.out, self.sink, self.index, self.index_sink):
            each.close()


def write_token_files(artifacts: DataFrame, tokenizer: str, folder: str = None, key: str = "frame_id", content: str = "content",
                      length: int = LENGTH, end: int = END) -> DataFrame:
    """Encode text artifacts in ascending key order, ``end`` after each, into Arrow files below ``folder`` (shared storage).

    Returns the manifest, written and read back: one row (file, first_key, last_key, artifacts, tokens) per file.  Files have names of
    their own, so a task that runs again leaves an unlisted file and nothing else.  Artifacts are range-partitioned by key;
    a null content counts as empty, null keys come first, repeated rows are all written (equal keys in order of content inside a file);
    other columns are not read; an empty table makes no file.
    """
    folder = folder or work_dir(artifacts.sparkSession)
    kind = id_type(tokenizer, end)

    def step(batches):
        out, first, end_key, count = None, None, None, 0
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            if not keys:
                continue
            if out is None:
                out, first = SequenceWriter(folder, length, kind), keys[0]
            counts = []
            for text in texts:
                ids = np.array(encode(text, tokenizer) + [end], kind)
                counts.append(len(ids))
                out.add(ids)
            out.names(keys, counts)
            count, end_key = count + len(keys), keys[-1]
        if out is not None:
            out.close()
            values = (out.name, first, end_key, count, out.tokens)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), *[pa.int64()] * 4))], ["file", "first_key", "last_key", "artifacts", "tokens"])

    rows = artifacts.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(content), F.lit("")).alias("_text"))
    # equal keys are told apart by text and row, so a key that most rows have takes as many files as its rows need
    by = [F.col("_key"), F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row")]
    dealt = rows.select("_text", *by).repartitionByRange(partitions(artifacts.sparkSession), "_key", "_hash", "_row")
    return staged(dealt.sortWithinPartitions("_key", "_text").select("_key", "_text").mapInArrow(step, MANIFEST))


def _open(file: str):
    system, path = _filesystem(file)
    return pa.ipc.open_file(pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path))


def sequence(file: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence; on local storage the ids are a view of the mapped file."""
    batch = _open(file).get_batch(row // BATCH)
    at = row % BATCH
    return batch.column("ids")[at].values.to_numpy(), batch.column("mask")[at].values.to_numpy(zero_copy_only=False)


def read_artifact_ids(manifest: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files: start counts the ids of all artifacts before, over all files in order
    of their first key; the checksum is of the little-endian 32-bit ids, read batch by batch across sequence borders."""
    before = Window.orderBy(F.col("first_key").asc_nulls_first(), F.col("last_key").asc_nulls_first(), F.col("file")).rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "base")

    def step(batches):
        for given in batches:
            for file, base in zip(*(c.to_pylist() for c in given.columns)):
                data, index = _open(file), _open(file + ".docs")
                size = data.schema.field("ids").type.list_size * BATCH
                held, view = -1, None
                for b in range(index.num_record_batches):
                    docs = index.get_batch(b)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n").to_pylist()):
                        crc, at = 0, start
                        while at < start + n:
                            if at // size != held:
                                held = at // size
                                view = data.get_batch(held).column("ids").flatten().to_numpy().astype("<u4").view(np.uint8)
                            stop = min(start + n, (held + 1) * size)
                            crc = zlib.crc32(view[(at - held * size) * 4 : (stop - held * size) * 4], crc)
                            at = stop
                        sums.append(crc)
                    starts = np.array(docs.column("start").to_pylist(), np.int64) + base
                    yield pa.RecordBatch.from_arrays([docs.column("key"), pa.array(starts), docs.column("n"), pa.array(sums, pa.int64())], ["_key", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(step, "_key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("_key", key)
