"""Helpers of the corpus operators: staged tables, streamed Arrow groups and partition counts."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfield.session import write_table

BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared work folder and read back: cuts lineage, so a lost executor costs one stage."""
    return write_table(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scaled(rows: int, per_part: int) -> int:
    """Number of parts that hold about per_part rows each, at least one."""
    return max(1, -(-rows // per_part))


def in_runs(step: Callable[[pa.Table], Iterator[pa.RecordBatch]], keys: list[str], limit: int):
    """A mapInArrow function over rows sorted by keys: whole runs of equal keys, several runs at a time.

    ``step`` gets a table that never splits a run and holds about ``limit`` rows.  Memory is bounded by the limit plus one run.
    """
    def apply(batches):
        held, rows = [], 0
        for batch in (b.slice(at, limit) for b in batches for at in range(0, b.num_rows, limit)):
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = _last_run(table, keys)
            if cut:
                yield from step(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield from step(pa.Table.from_batches(held).combine_chunks())

    return apply


def _last_run(table: pa.Table, keys: list[str]) -> int:
    """First row of the last run of equal keys."""
    same = np.ones(table.num_rows, bool)
    for k in keys:
        v = table[k].to_numpy()
        same &= v == v[-1]
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys, and the number of rows as the last entry."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def sorted_runs(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Rows hash-partitioned and sorted by keys, for in_runs."""
    n = parts or partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def content_bytes(content: str) -> F.Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(content).cast("binary"), F.lit(b""))


def trimmed(text: str):
    """The text without blanks at its ends; null counts as empty."""
    return F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))


def word_count(text: str):
    """Number of runs of characters other than blanks; null: 0."""
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("bigint")
