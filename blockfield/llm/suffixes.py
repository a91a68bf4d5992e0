"""Repeated byte strings across artifacts: anchored suffixes sorted by hash comparison.

Every window of ``length`` bytes picks one k-gram inside it by content (its least hash, the last of equal ones), its anchor.
Equal windows pick equal anchors at equal offsets, so only windows under anchors that occur again need to be compared.
Those windows are suffixes of the anchor's surroundings: per anchor and offset they are put in order by a merge sort whose
comparison finds the common extension of two suffixes by binary search over prefix polynomial hashes (modulo 2^64), and
neighbours that agree over the whole length are verified byte by byte.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfield.llm.shared import content_bytes, in_runs, run_bounds, sorted_runs, staged

LENGTH = 400
GRAM = 64
#: Bytes hashed at once; longer artifacts are cut into pieces that overlap by length - 1.
PIECE = 1 << 19
#: Surroundings of one anchor that are sorted in one place; larger groups go through window rows.
GROUP = 4096
BASE = 0x9E3779B97F4A7C15 | 1
LOW = np.uint64((1 << 20) - 1)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
HASHES = "key bigint, ctx bigint, frame_id bigint, whole bigint, at bigint, lo int, hi int"


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of (byte + 1) * base^j over j < i, modulo 2^64."""
    up, _ = _powers(1 << max(10, len(data).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values (prefix and suffix minima of blocks)."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(pieces: list[bytes], length: int, gram: int):
    """(piece, key, ctx, at, lo, hi) arrays: the windows at - lo .. at - hi of a piece pick the gram at ``at``."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    h = prefix_hashes(data)
    _, down = _powers(1 << max(10, len(data).bit_length()))
    grams = _mixed((h[gram:] - h[:-gram]) * down[: len(data) - gram + 1])
    spot = np.arange(len(grams), dtype=np.uint64)
    least = _window_minima((grams & ~LOW) | (LOW - spot), length - gram + 1)
    picked = (LOW - (least & LOW)).astype(np.int64)
    start = np.arange(len(picked))
    piece = np.searchsorted(ends, start, side="right")
    ok = start + length <= ends[piece]
    start, picked, piece = start[ok], picked[ok], piece[ok]
    if not len(start):
        return None
    first = np.flatnonzero(np.append(True, (picked[1:] != picked[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:], len(start)) - 1
    at, s, e, piece = picked[first], start[first], start[last], piece[first]
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    lo, hi = at - s, at - e
    ctx = np.fromiter((digest(view[a:b], c) for a, b, c in zip(s.tolist(), (e + length).tolist(), (lo * length + hi).tolist())), np.uint64, len(s))
    return piece, grams[at].view(np.int64), ctx.view(np.int64), at - (ends[piece] - np.array([len(p) for p in pieces])[piece]), lo, hi


def _anchors(artifacts: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor of every artifact of at least ``length`` bytes."""
    def flush(held):
        found = anchors_of([c for _, _, _, c in held], length, gram)
        if found is None:
            return
        piece, key, ctx, at, lo, hi = found
        ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(piece))
        whole = np.array([h[1] for h in held], np.int64)[piece]
        at = at + np.array([h[2] for h in held], np.int64)[piece]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(ctx), ids, pa.array(whole), pa.array(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            ["key", "ctx", "frame_id", "whole", "at", "lo", "hi"],
        )

    def step(batches):
        held, size = [], 0
        for batch in batches:
            for frame, whole, content in zip(*(c.to_pylist() for c in batch.columns)):
                for cut in range(0, max(1, len(content) - length + 1), PIECE):
                    piece = content[cut : cut + PIECE + length - 1]
                    if size and size + len(piece) > PIECE:
                        yield from flush(held)
                        held, size = [], 0
                    held.append((frame, whole, cut, piece))
                    size += len(piece)
        if held:
            yield from flush(held)

    return artifacts.where(F.length("content") >= length).select("frame_id", "whole", "content").mapInArrow(step, HASHES)


def suffix_order(data: np.ndarray, h: np.ndarray, starts: np.ndarray, classes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by class and then content, and whether each one agrees with its successor over ``length``.

    A bottom-up merge sort: all runs of a level are merged at once, every suffix finding its rank in the sibling run by
    binary search; a comparison finds the common extension by binary search over the prefix hashes ``h``.
    """
    up, _ = _powers(1 << max(10, len(data).bit_length()))
    base, lift = h[starts], up[len(data) - starts]
    order = np.argsort(classes, kind="stable")
    ranked = classes[order]
    n = len(order)
    opens = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(opens, n))
    begin, count = np.repeat(opens, sizes), np.repeat(sizes, sizes)

    def extension(a, b):
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
        whole = (h[starts[a] + length] - base[a]) * lift[a] == (h[starts[b] + length] - base[b]) * lift[b]
        low[whole] = length
        while True:
            go = np.flatnonzero(low < high)
            if not len(go):
                return low
            x, y, mid = a[go], b[go], (low[go] + high[go] + 1) >> 1
            same = (h[starts[x] + mid] - base[x]) * lift[x] == (h[starts[y] + mid] - base[y]) * lift[y]
            low[go] = np.where(same, mid, low[go])
            high[go] = np.where(same, high[go], mid - 1)

    def less(a, b):
        """a before b, and whether they agree over the whole length."""
        common = extension(a, b)
        equal = common == length
        at = np.minimum(common, length - 1)
        return (data[starts[a] + at] < data[starts[b] + at]) & ~equal, equal

    width = 1
    while True:
        act = np.flatnonzero(count > width)
        if not len(act):
            break
        place = act - begin[act]
        half = place // width
        left = half % 2 == 0
        run = begin[act] + (half - half % 2) * width
        limit = begin[act] + count[act]
        sib0 = np.minimum(np.where(left, run + width, run), limit)
        sib1 = np.minimum(np.where(left, run + 2 * width, run + width), limit)
        me, lo, hi = order[act], sib0.copy(), sib1.copy()
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) >> 1
            before, equal = less(order[mid], me[go])
            right = before | (equal & ~left[go])
            lo[go] = np.where(right, mid + 1, lo[go])
            hi[go] = np.where(right, hi[go], mid)
        order[run + (place - half * width) + (lo - sib0)] = me
        width *= 2
    same = np.zeros(n, bool)
    pair = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(pair):
        a, b = order[pair], order[pair + 1]
        same[pair] = (h[starts[a] + length] - base[a]) * lift[a] == (h[starts[b] + length] - base[b]) * lift[b]
    return order, same


def repeated_offsets(surroundings: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
    """(far, near) per row: greatest and least window offset that another row of the group repeats; -1 where none."""
    data = np.frombuffer(b"".join(surroundings), np.uint8)
    h = prefix_hashes(data)
    base = np.cumsum([0] + [len(s) for s in surroundings[:-1]])
    per = lo - hi + 1
    row = np.repeat(np.arange(len(per)), per)
    step = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    offset = lo[row] - step
    starts = base[row] + step
    order, same = suffix_order(data, h, starts, group[row] * np.int64(length) + offset, length)
    at = np.flatnonzero(same)
    r, s, o = row[order[at]], row[order[at + 1]], offset[order[at]]
    far, near = np.full(len(per), -1, np.int64), np.full(len(per), length, np.int64)
    # Verified once per stretch of consecutive offsets that the same two rows share.
    by = np.lexsort((o, s, r))
    r, s, o = r[by], s[by], o[by]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1))) if len(r) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(r)) - 1 if len(r) else first
    for x, y, low, high in zip(r[first].tolist(), s[first].tolist(), o[first].tolist(), o[last].tolist()):
        a, b = surroundings[x][lo[x] - high : lo[x] - low + length], surroundings[y][lo[y] - high : lo[y] - low + length]
        true = [(low, high)] if a == b else [(v, v) for v in range(low, high + 1) if a[high - v :][:length] == b[high - v :][:length]]
        for least, most in true:
            for z in (x, y):
                far[z], near[z] = max(far[z], most), min(near[z], least)
    return far, near


FOUND = "key bigint, ctx bigint, far int, near int"


def _sorted_groups(length: int):
    def step(table: pa.Table):
        bounds = run_bounds(table, ["key"])
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        lo, hi = table["lo"].to_numpy().astype(np.int64), table["hi"].to_numpy().astype(np.int64)
        far, near = repeated_offsets(table["bytes"].to_pylist(), group, lo, hi, length)
        copied = table["n"].to_numpy() > 1
        far, near = np.where(copied, lo, far), np.where(copied, hi, near)
        keep = far >= 0
        yield pa.RecordBatch.from_arrays([
            pa.array(table["key"].to_numpy()[keep]), pa.array(table["ctx"].to_numpy()[keep]), pa.array(far[keep].astype(np.int32)), pa.array(near[keep].astype(np.int32)),
        ], ["key", "ctx", "far", "near"])

    return in_runs(step, ["key"], 1024)


def _window_rows(length: int):
    """Every window of every row: (key, ctx, o, one, two) with two hashes of its bytes."""
    def step(batches):
        for batch in batches:
            for key, ctx, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "lo", "hi", "bytes"))):
                o = list(range(lo, hi - 1, -1))
                cut = [data[lo - x : lo - x + length] for x in o]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(o), pa.int64()), pa.array([ctx] * len(o), pa.int64()), pa.array(o, pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(c) for c in cut], pa.binary()),
                ], ["key", "ctx", "o", "print"])

    return step


def repeated_spans(artifacts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(frame_id, whole, spans ARRAY<STRUCT<from, to>>) of ``artifacts(frame_id, whole, content BINARY)``; whole is a hash of content.

    Rows of one anchor with equal surroundings are counted, not collected, so a group of copies is one row before any
    group is formed.  Groups of more than ``group`` different surroundings are not sorted in one task: their windows
    become rows that are counted by Spark.
    """
    anchors = staged(_anchors(artifacts, length, gram))
    rep = F.min(F.struct("frame_id", "whole", "at")).alias("rep")
    around = anchors.groupBy("key", "ctx", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), rep)
    keys = around.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1").select("key", "kinds")
    around = staged(around.join(keys, "key"))
    sole = around.where("kinds = 1").select("key", "ctx", F.col("lo").alias("far"), F.col("hi").alias("near"))
    start = (F.col("at") - F.col("lo") + 1).cast("int")
    bytes_ = F.expr("substring(content, _from, _size)")
    reps = around.where("kinds > 1").select("key", "ctx", "lo", "hi", "n", "kinds", "rep.*").select(
        "key", "ctx", "lo", "hi", "n", "kinds", F.col("frame_id").alias("_f"), F.col("whole").alias("_w"),
        start.alias("_from"), (F.col("lo") - F.col("hi") + length).alias("_size"))
    # repeated rows of one id meet the same surroundings: one of each goes on, in the join's own partitions
    met = artifacts.join(reps, F.col("frame_id").eqNullSafe(F.col("_f")) & (F.col("whole") == F.col("_w"))).select(
        "_f", "_w", "key", "ctx", "lo", "hi", "n", "kinds", bytes_.alias("bytes"))
    open_ = staged(met.dropDuplicates(["_f", "_w", "key", "ctx", "lo", "hi"]).drop("_f", "_w"))
    small = sorted_runs(open_.where(F.col("kinds") <= group), ["key"]).mapInArrow(_sorted_groups(length), FOUND)
    windows = open_.where(F.col("kinds") > group).mapInArrow(_window_rows(length), "key bigint, ctx bigint, o int, print binary")
    again = windows.groupBy("key", "o", "print").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    large = windows.join(again, ["key", "o", "print"]).groupBy("key", "ctx").agg(F.max("o").alias("far"), F.min("o").alias("near"))
    copied = around.where((F.col("kinds") > group) & (F.col("n") > 1)).select("key", "ctx", F.col("lo").alias("far"), F.col("hi").alias("near"))
    found = staged(sole.union(small).union(large).union(copied))
    spans = anchors.join(found, ["key", "ctx"]).groupBy("frame_id", "whole", "at").agg(F.max("far").alias("far"), F.min("near").alias("near"))
    return spans.groupBy("frame_id", "whole").agg(F.collect_list(
        F.struct((F.col("at") - F.col("far")).alias("from"), (F.col("at") - F.col("near") + length).alias("to"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans put together."""
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _whole_chars(content: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts widened so that no UTF-8 character stays in part."""
    out = []
    for s, e in cut:
        while 0 < s < len(content) and content[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(content) and content[e] & 0xC0 == 0x80:
            e += 1
        out.append((s, e))
    return merged(out)


def whole_words(content: bytes, cut: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The cuts from their first whole word to the end of their last, where they hold ``words`` or more."""
    out = []
    for s, e in cut:
        inside = [m.span() for m in WORDS.finditer(content, s, e)]
        if inside and s and not content[s - 1 : s].isspace() and inside[0][0] == s:
            del inside[0]
        if inside and e < len(content) and not content[e : e + 1].isspace() and inside[-1][1] == e:
            del inside[-1]
        if len(inside) >= words:
            out.append((inside[0][0], inside[-1][1]))
    return out


def _kept(chars: bool, words: int):
    def step(batches):
        for batch in batches:
            contents = batch.column("content").to_pylist()
            kept, removed, count = [], [], []
            for content, spans in zip(contents, batch.column("spans").to_pylist()):
                cut = merged([(s["from"], s["to"]) for s in spans or []])
                if words:
                    cut = whole_words(content, cut, words)
                elif chars:
                    cut = _whole_chars(content, cut)
                edges = [0, *(x for c in cut for x in c), len(content)]
                kept.append(b"".join(content[s:e] for s, e in zip(edges[::2], edges[1::2])) if cut else content)
                removed.append(len(content) - len(kept[-1]))
                count.append(len(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column("frame_id"), batch.column("_carry"), pa.array([len(c) for c in contents], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                ["frame_id", "_carry", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return step


def remove_repeats(artifacts: DataFrame, key: str = "frame_id", content: str = "content", length: int = LENGTH, gram: int = GRAM,
                   group: int = GROUP, carry: tuple = (), chars: bool = False, words: int = 0) -> DataFrame:
    """Artifacts without the bytes that a ``length``-byte string starting elsewhere also covers.

    Returns (key, n_bytes, n_removed, n_spans, kept BINARY, *carry) per row: content counts as UTF-8 bytes, null as empty;
    strings never cross artifacts; every occurrence of a repeated string is cut, and strings are judged on the input.
    ``chars`` widens a cut so that no character stays in part, and ``kept`` is text.  With ``words``,
    cuts are of whole words, and those of fewer stay.  Artifacts shorter than ``length`` stay whole.  Repeated rows are copies of each other and are all cut; rows with a null key take part.  Columns other
    than ``carry`` are not read; an empty table gives an empty one.
    """
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_none"))
    rows = artifacts.select(F.col(key).cast("bigint").alias("frame_id"), content_bytes(content).alias("content"), held.alias("_carry")).withColumn("whole", F.xxhash64("content"))
    spans = repeated_spans(rows.drop("_carry"), length, gram, group).select(F.col("frame_id").alias("_f"), F.col("whole").alias("_w"), "spans")
    both = rows.join(spans, F.col("frame_id").eqNullSafe(F.col("_f")) & (F.col("whole") == F.col("_w")), "left").select("frame_id", "_carry", "content", "spans")
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    out = both.mapInArrow(_kept(chars, words), T.StructType([*both.schema.fields[:2], *counts, T.StructField("kept", T.BinaryType())]))
    text = F.col("kept").cast("string") if chars else F.col("kept")
    return out.select(F.col("frame_id").alias(key), "n_bytes", "n_removed", "n_spans", text.alias("kept"), *[F.col(f"_carry.{c}") for c in carry])
