"""Periodic runs of artifacts: scale-tiled search with boundary Z-functions.

A run with period q is a maximal interval of places i with word i = word i + q, q more words long.  Periods are split into
octaves low <= q < high.  Every run worth reporting has an interval of at least ``spacing`` places there, so it holds a
multiple of that spacing, a boundary b; the Z-function of the words from b on tells how far each q of the octave holds after
b, the Z-function of the words before b, read backwards, how far it holds before b.  Both look two periods far only, so an
octave's boundaries are solved in tiles of a few periods, independently of each other; what a tile finds are fragments of
intervals, which are put together by artifact and period.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.shared import content_bytes, staged

LEAST = 12
#: Words of a tile between its first and last boundary, at least eight boundaries.
TILE = 4096
#: Words whose hash must recur one period on before a boundary next to them is looked at; no longer than any interval.
GRAM = 6
OPEN = "frame_id bigint, whole bigint, low int, at bigint, words array<int>, bounds array<int>, content binary"
FRAGMENT = "frame_id bigint, whole bigint, period bigint, `from` bigint, `to` bigint"


def word_codes(content: bytes) -> np.ndarray:
    """Place of the first equal word for each blank-separated word; bytes.split cuts at space and \\x09-\\x0D alone."""
    seen = {}
    return np.array([seen.setdefault(w, k) for k, w in enumerate(content.split())], np.int32)


def octaves(words: int) -> list[tuple[int, int, int]]:
    """(low, high, spacing) of the octaves of periods up to half of ``words``; the periods below 8 are one octave."""
    out, low = [(1, 8, GRAM)], 8
    while 2 * low <= words:
        out.append((low, 2 * low, low))
        low *= 2
    return out


def active_boundaries(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, np.ndarray]]:
    """(low, high, boundaries) of the octaves with boundaries that a run may hold.

    If b lies in an interval, one of the grams at b - 5 .. b recurs one period on; all other boundaries are left out.
    """
    n = len(codes)
    if n < least:
        return []
    wide, grams = codes.astype(np.uint64), np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams += wide[k : k + len(grams)]
    ranked = np.sort(grams)
    if not (ranked[1:] == ranked[:-1]).any():
        return []
    order = np.argsort(grams, kind="stable")
    new = np.append(True, grams[order[1:]] != grams[order[:-1]])
    group = np.cumsum(new)
    again = np.bincount(group)[group] > 1
    order, key = order[again], (group[again].astype(np.int64) << 32) + order[again]
    out = []
    for low, high, spacing in octaves(n):
        after = np.searchsorted(key, key + low)
        hit = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] - key < high)
        b = -(-order[hit] // spacing) * spacing
        b = np.unique(b[b < order[hit] + GRAM])
        if len(b):
            out.append((low, high, b))
    return out


def z_function(x: list) -> list[int]:
    """z[i]: how many values from i on equal those from the start on."""
    n = len(x)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(32)
def _least_factors(size: int) -> np.ndarray:
    """Least prime factor of every number below ``size``."""
    out = np.arange(size)
    for p in range(2, int(size**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part == np.arange(p * p, size, p)] = p
    return out


def _repeats_within(z: list[int], q: int, factors: np.ndarray) -> bool:
    """Whether the first q values are a shorter block written several times."""
    rest = q
    while rest > 1:
        p = int(factors[rest])
        if z[q // p] >= q - q // p:
            return True
        while rest % p == 0:
            rest //= p
    return False


def tile_fragments(words: list[int], bounds: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, from, to) fragments of the intervals around the boundaries, in places of the tile, merged where they meet.

    A fragment is reported if it lasts a period, or what the least length asks of periods below 8; longer blocks that repeat
    a shorter one are left to the octave of the shorter one.
    """
    factors, held, n = _least_factors(1 << high.bit_length()), {}, len(words)
    for b in bounds:
        ahead = z_function(words[b : b + 2 * high])
        begin, end = max(0, b - high), min(n, b + high)
        before = words[begin:b][::-1]
        behind = z_function([*before, -1, *words[begin:end][::-1]])
        shift = len(before) + 1 + end - b
        for q in range(low, min(high, len(ahead))):
            f = ahead[q]
            if not f:
                continue
            g = min(behind[shift - q], len(before)) if q <= end - b else 0
            if f + g >= q and not _repeats_within(ahead, q, factors):
                runs = held.setdefault(q, [])
                if runs and runs[-1][1] >= b - g:
                    runs[-1][1] = max(runs[-1][1], b + f)
                else:
                    runs.append([b - g, b + f])
    return [(q, s, e) for q, runs in held.items() for s, e in runs]


def _tiles(batches):
    """Tiles of every octave with active boundaries, and the content once, of artifacts that have any."""
    for batch in batches:
        for frame, whole, content in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "whole", "content"))):
            codes = word_codes(content)
            rows = []
            for low, high, b in active_boundaries(codes):
                step = max(8, TILE // max(low, GRAM)) * (GRAM if low == 1 else low)
                for part in np.split(b, np.flatnonzero(np.diff(b // step)) + 1):
                    start = max(0, int(part[0]) - high)
                    rows.append((low, start, codes[start : int(part[-1]) + 2 * high], (part - start).astype(np.int32), None))
            if rows:
                rows.append((0, 0, None, None, content))
            for at in range(0, len(rows), 16):
                low, start, words, bounds, texts = zip(*rows[at : at + 16])
                yield pa.RecordBatch.from_arrays([
                    pa.array([frame] * len(low), pa.int64()), pa.array([whole] * len(low), pa.int64()), pa.array(low, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(words, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.int32())), pa.array(texts, pa.binary()),
                ], ["frame_id", "whole", "low", "at", "words", "bounds", "content"])


def _solved(batches):
    for batch in batches:
        out, words, bounds = [], batch.column("words"), batch.column("bounds")
        for row, (frame, whole, low, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("frame_id", "whole", "low", "at")))):
            high = 8 if low == 1 else 2 * low
            out += [(frame, whole, q, at + s, at + e) for q, s, e in tile_fragments(words[row].as_py(), bounds[row].as_py(), low, high)]
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["frame_id", "whole", "period", "from", "to"])


def _settled(batches):
    """Artifacts without an active boundary: no run, all words stay."""
    for batch in batches:
        ids, kept = [], []
        for frame, content in zip(batch.column("frame_id").to_pylist(), batch.column("content").to_pylist()):
            if not active_boundaries(word_codes(content)):
                ids.append(frame)
                kept.append(b" ".join(content.split()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["frame_id", "kept"])


def _collapsed(batches):
    """Words that no run holds after its first period, of artifacts with their runs."""
    for batch in batches:
        kept = []
        for content, runs in zip(batch.column("content").to_pylist(), batch.column("runs").to_pylist()):
            words = content.split()
            change = np.zeros(len(words) + 1, np.int64)
            for r in runs or ():
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            stays = np.cumsum(change)[:-1] == 0
            kept.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s))
        yield pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array(kept, pa.binary()), batch.column("runs")], ["frame_id", "kept", "runs"])


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def stitched(fragments: DataFrame, least: int = LEAST) -> DataFrame:
    """(frame_id, whole, runs) of fragments (frame_id, whole, period, from, to): those of a period that meet are one interval."""
    once = fragments.groupBy("frame_id", "whole", "period", "from").agg(F.max("to").alias("to"))
    order = Window.partitionBy("frame_id", "whole", "period").orderBy("from")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col("from"), 0).otherwise(1)
    island = once.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    interval = island.groupBy("frame_id", "whole", "period", "_island").agg(F.min("from").alias("start"), F.max("to").alias("to"))
    length = F.col("to") - F.col("start") + F.col("period")
    runs = interval.select("frame_id", "whole", F.struct("start", "period", length.alias("length")).alias("run"))
    return runs.where(F.col("run.length") >= F.greatest(F.lit(least), 2 * F.col("run.period"))).groupBy("frame_id", "whole").agg(
        F.sort_array(F.collect_list("run")).alias("runs"))


def periodic_runs(artifacts: DataFrame, key: str = "frame_id", content: str = "content") -> DataFrame:
    """(key, runs ARRAY<STRUCT<start, period, length>>, kept BINARY) of the artifacts' blank-separated words.

    A run is a stretch of consecutive words with smallest period q and a length of at least max(12, 2 q) that no neighbour
    extends keeping the period; runs are sorted by start, then period.  ``kept`` are the words that no run holds after its
    first period, joined by one space.  One row per row: repeated rows are each answered, by runs that are searched in every
    one and counted once; rows with a null key take part; a null content counts as empty and has no run; words of any
    length and texts of any number of words are taken whole; columns other than key and content are not read; an
    empty table gives an empty one.

    Only artifacts in which six words recur leave their place: their tiles are dealt out by (artifact, octave, tile), equal ones
    of repeated rows as one, so a very long artifact is solved by many tasks; their contents meet the stitched runs again.
    """
    rows = artifacts.select(F.col(key).cast("bigint").alias("frame_id"), content_bytes(content).alias("content"))
    none = F.lit([]).cast(RUNS)
    settled = rows.mapInArrow(_settled, "frame_id bigint, kept binary").select("frame_id", none.alias("runs"), "kept")
    open_ = staged(rows.withColumn("whole", F.xxhash64("content")).mapInArrow(_tiles, OPEN))
    tiles = open_.where("low > 0").groupBy("frame_id", "whole", "low", "at").agg(F.first("words").alias("words"), F.first("bounds").alias("bounds"))
    runs = stitched(tiles.mapInArrow(_solved, FRAGMENT)).withColumnsRenamed({"frame_id": "_f", "whole": "_w"})
    contents = open_.where("low = 0").select("frame_id", "whole", "content")
    met = contents.join(runs, F.col("frame_id").eqNullSafe(F.col("_f")) & (F.col("whole") == F.col("_w")), "left").select("frame_id", "content", "runs")
    repeated = met.mapInArrow(_collapsed, f"frame_id bigint, kept binary, runs {RUNS}").select("frame_id", F.coalesce("runs", none).alias("runs"), "kept")
    return settled.union(repeated).withColumnRenamed("frame_id", key)
