"""Large JSON documents read incrementally: one row per element of their arrays, in bounded memory."""

import codecs
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockfield.sources.binary import file_system

SCHEMA = "file string, array string, position bigint, element string, counts map<string,bigint>, error string"
#: Bytes read at a time, rows of a batch, and bytes of small documents that share a task.
CHUNK, ROWS, SHARED = 1 << 20, 1024, 1 << 25
#: Characters of one value; a document with a longer one, or one that never closes, breaks off there.
LONGEST = 1 << 26
BLANK = " \t\r\n"


class Documents(InputPartition):
    def __init__(self, files: list):
        self.files = files


class Scanner:
    """Values of a JSON text that is read in chunks; the buffer holds one chunk, or the value at hand if that is longer."""

    def __init__(self, handle, chunk: int = CHUNK):
        self.handle, self.chunk, self.text, self.at, self.ended = handle, chunk, "", 0, False
        self.text_of = codecs.getincrementaldecoder("utf-8")().decode
        self.decode = json.JSONDecoder().raw_decode

    def more(self, size: int = 0) -> None:
        if len(self.text) - self.at > LONGEST:
            raise ValueError(f"a value of more than {LONGEST} characters")
        data = self.handle.read(max(size, self.chunk))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.text_of(data, self.ended), 0

    def peek(self) -> str:
        """The next character that is no blank, or '' at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in BLANK:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            self.more()
            if self.ended:
                return ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found not in wanted or not found:
            raise ValueError(f"{found or 'end'} where {' or '.join(wanted)} should be")
        self.at += 1
        return found

    def value(self) -> str:
        """The next value as JSON text."""
        self.peek()
        while True:
            try:
                _, end = self.decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    out, self.at = self.text[self.at : end], end
                    return out
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more(len(self.text) - self.at)  # twice as much at least, so a long value is tried few times


def events(handle, arrays: tuple, chunk: int = CHUNK) -> Iterator[tuple]:
    """(array, position, element text, counts, error) of a document: its streamed elements in order, at the end one header row
    (array null) with all other members as a JSON object.  A document that breaks off gives what was read and an error."""
    scan, counts, header = Scanner(handle, chunk), {}, {}
    try:
        scan.take("{")
        if scan.peek() == "}":
            scan.take("}")
        else:
            while True:
                name = json.loads(scan.value())
                if not isinstance(name, str):
                    raise ValueError("a member without a name")
                scan.take(":")
                if name in arrays and scan.peek() == "[":
                    counts[name] = 0
                    scan.take("[")
                    if scan.peek() == "]":
                        scan.take("]")
                    else:
                        while True:
                            yield name, counts[name], scan.value(), None, None
                            counts[name] += 1
                            if scan.take(",", "]") == "]":
                                break
                else:
                    header[name] = json.loads(scan.value())
                if scan.take(",", "}") == "}":
                    break
        if scan.peek():
            raise ValueError("text behind the document")
        error = None
    except (ValueError, UnicodeDecodeError) as fault:
        error = f"malformed: {str(fault)[:80]}"
    yield None, sum(counts.values()), json.dumps(header), counts, error


class JsonElementReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.arrays, self.chunk = options["path"], tuple(options["arrays"].split(",")), int(options.get("chunk", CHUNK))

    def partitions(self):
        from pyarrow import fs

        store, root = file_system(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        out, held, size = [], [], 0
        for info in sorted((i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            if held and size + info.size > SHARED:
                out.append(Documents(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return out + ([Documents(held)] if held else [])

    def read(self, part):
        store, _ = file_system(self.path)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.int64()), pa.string()]
        names = ["file", "array", "position", "element", "counts", "error"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for path in part.files:
            rows, size = [], 0
            with store.open_input_stream(path) as handle:
                for array, position, element, counts, error in events(handle, self.arrays, self.chunk):
                    rows.append((path, array, position, element, None if counts is None else list(counts.items()), error))
                    size += len(element)
                    if len(rows) >= ROWS or size >= self.chunk:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


class JsonElements(DataSource):
    """``spark.read.format("json_elements")`` with options path and arrays, the names of the members to stream."""

    @classmethod
    def name(cls):
        return "json_elements"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return JsonElementReader(self.options)


def read_elements(spark: SparkSession, path: str, *arrays: str) -> DataFrame:
    """(file, array, position, element, counts, error) of all documents below the path, one document a file."""
    spark.dataSource.register(JsonElements)
    return spark.read.format("json_elements").option("path", path).option("arrays", ",".join(arrays)).load()
