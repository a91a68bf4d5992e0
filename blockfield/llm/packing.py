"""Best-fit packing of token streams into sequences of several permitted lengths.

Streams are dealt to shelves by a hash of their key, so a shelf has a bounded number of them whatever stage they come from,
and every shelf is packed by itself: longest first, each piece into the fullest open sequence that still takes it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.llm.shared import in_runs, partitions, run_bounds, scaled

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence in tokens: a fixed part, its length, and its squared length over ATTENTION.
OVERHEAD = 64
ATTENTION = 16384
SHELF = 4096
#: Equal streams that go to a shelf together.
COPIES = 64


def pack(sizes: np.ndarray, lengths: tuple = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, length) per piece; sizes are from 1 to the greatest length, in any order.

    Pieces go longest first, equal ones in their given order.  A piece goes to the open sequence with the least room that
    still takes it.  Where none does, a sequence opens whose length costs least per token it may come to hold: its room
    beyond the piece counts as filled as far as pieces still to come fit into it.  At the end every sequence shrinks to the
    least permitted length that holds its contents.
    """
    lengths = sorted(set(lengths))
    top = lengths[-1]
    waiting = np.bincount(sizes, minlength=top + 1)
    mass = (np.cumsum(waiting * np.arange(top + 1))).tolist()  # tokens of pieces up to a size
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used, capacity = [], []
    open_, mask = [[] for _ in range(top + 1)], 0  # sequences by room; bit r of the mask: some have room r
    done = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        done += size
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            s = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
        else:
            left = mass[size] - (done - (mass[top] - mass[size]))  # tokens still to come, none longer than this piece
            best = None
            for length in lengths:
                if length >= size:
                    fill = size + min(length - size, left, mass[min(length - size, size)])
                    cost = (overhead + length + length * length / attention) / fill
                    if best is None or cost < best[0]:
                        best = (cost, length)
            s, room = len(used), best[1]
            used.append(0)
            capacity.append(room)
        sequence[i], offset[i] = s, used[s]
        used[s] += size
        room -= size
        if room:
            open_[room].append(s)
            mask |= 1 << room
    fixed = np.array(lengths)
    final = fixed[np.searchsorted(fixed, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return sequence, offset, final[sequence] if used else final


def pack_streams(streams: DataFrame, lengths: tuple = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, shelf: int = SHELF,
                 key: str = "frame_id", tokens: str = "token_count") -> DataFrame:
    """Places of all tokens of ``streams(frame_id, token_count)``: (key, token_count, start, size, shelf, sequence, offset, length).

    A stream longer than the greatest permitted length is cut into whole greatest lengths and a rest; a row is one piece,
    its tokens start .. start + size - 1 at ``offset`` of sequence (shelf, sequence) of ``length`` tokens.  Streams without
    tokens (null, zero or negative counts) keep one row with size 0 and null sequence, offset and length.  Repeated rows
    and null keys are packed like others; other columns are dropped; an empty table gives an empty one.  The number of
    shelves follows from the number of rows, about ``shelf`` rows each, so a rerun gives the same places.
    """
    top = max(lengths)
    n = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    rows = streams.select(F.col(key).cast("bigint").alias("id"), n.alias("n"))
    shelves = scaled(rows.count(), shelf)
    # equal rows travel as counts, so many copies to a shelf: one key that most rows have fills many shelves
    equal = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c"))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1, F.lit(COPIES).cast("bigint"))).alias("first")
    some = equal.select("id", "n", "c", first)
    place = F.when(F.col("first") == 0, F.xxhash64("id", "n")).otherwise(F.xxhash64("id", "n", "first"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(top).cast("bigint"))
    pieces = some.select(F.pmod(place, F.lit(shelves)).alias("shelf"), "id", "n", F.least(F.col("c") - F.col("first"), F.lit(COPIES)).cast("int").alias("copies"), F.explode(starts).alias("start")).withColumn(
        "size", F.least(F.col("n") - F.col("start"), F.lit(top)).cast("int"))

    def step(table: pa.Table):
        bounds = run_bounds(table, ["shelf"])
        size = table["size"].to_numpy()
        out = [np.zeros(len(size), np.int64) for _ in range(3)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            full = s + np.flatnonzero(size[s:e] > 0)
            for column, values in zip(out, pack(size[full], lengths, overhead, attention)):
                column[full] = values
        empty = size == 0
        places = [pa.array(c, mask=empty) for c in out]
        yield from pa.table([*table.columns, *places], [*table.column_names, "sequence", "offset", "length"]).to_batches()

    schema = "shelf bigint, id bigint, n bigint, start bigint, size int, sequence bigint, offset bigint, length bigint"
    dealt = pieces.repartition(partitions(streams.sparkSession), "shelf").select("shelf", "id", "n", "start", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    packed = dealt.sortWithinPartitions("shelf", "id", "n", "start").mapInArrow(in_runs(step, ["shelf"], 1 << 16), schema)
    return packed.select(F.col("id").alias(key), F.col("n").alias(tokens), "start", "size", "shelf", "sequence", "offset", "length")
