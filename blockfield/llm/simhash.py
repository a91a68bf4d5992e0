"""Near-duplicate artifacts: SimHash fingerprints linked through covering bit masks.

The radius-r covering family has 2^(r+1) - 1 masks.  Bit i gets the vector i mod 2^(r+1) over GF(2); mask v keeps the bits
whose vector has odd inner product with v.  The vectors of r differing bits span at most r dimensions, so some nonzero v
is orthogonal to all of them: its mask keeps none of the differing bits, and the pair agrees in that table for certain.
"""

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.llm.components import components
from blockfield.llm.shared import content_bytes, in_runs, run_bounds, sorted_runs, staged

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints of one bucket that are compared in one place; larger buckets are split by a second family.
BUCKET = 4096
BLOCK = 1 << 16


def content_fingerprint(content: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the blank-separated words (ASCII case folded); zero without words."""
    words = content.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    starts = [e + 1 for e in ends[:-1]]
    last = ends[1:][shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + BLOCK], last[at:at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(artifacts: DataFrame, key: str = "frame_id", content: str = "content", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint BIGINT) of every artifact; a null or blank content has fingerprint zero, rows are kept as they are."""
    def step(batches):
        for batch in batches:
            found = [content_fingerprint(c, shingle) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["_key", "fingerprint"])

    rows = artifacts.select(F.col(key).cast("bigint").alias("_key"), content_bytes(content).alias("_content"))
    return rows.mapInArrow(step, "_key bigint, fingerprint bigint").withColumnRenamed("_key", key)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The masks of the covering family over the given bit positions, as signed 64-bit integers."""
    masks = []
    for v in range(1, 1 << (radius + 1)):
        kept = sum(1 << p for i, p in enumerate(positions) if bin(i % (1 << (radius + 1)) & v).count("1") % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _free(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _forest(codes: np.ndarray, ids: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join the same codes as all pairs within the radius do: a breadth-first search drops what it has reached."""
    ours, theirs = [], []
    left = np.arange(len(codes))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(codes[left] ^ codes[at]) <= radius
            found = left[near]
            ours += [ids[root]] * len(found)
            theirs += ids[found].tolist()
            queue += found.tolist()
            left = left[~near]
    return ours, theirs


LINKS = "a bigint, b bigint, tab int, code bigint, node bigint"


def _bucket_links(radius: int, limit: int | None):
    """Links of whole buckets; members of a bucket beyond the limit come back as (tab, code, node) for the second family."""
    keys = ["tab", "bucket"]

    def step(table: pa.Table):
        bounds = run_bounds(table, keys)
        size = np.diff(bounds)
        tab = table["tab"].to_numpy()
        code = table["code"].to_numpy().view(np.uint64)
        node = table["node"].to_numpy()
        two = bounds[:-1][size == 2]
        two = two[np.bitwise_count(code[two] ^ code[two + 1]) <= radius]
        ours, theirs, over = node[two].tolist(), node[two + 1].tolist(), []
        for s, e in zip(bounds[:-1][size > 2], bounds[1:][size > 2]):
            if limit and e - s > limit:
                over.append(np.arange(s, e))
                continue
            a, b = _forest(code[s:e], node[s:e], radius)
            ours += a
            theirs += b
        rest = np.concatenate(over) if over else np.zeros(0, np.int64)
        none = [None] * len(ours)
        yield pa.RecordBatch.from_arrays([
            pa.array(ours + [None] * len(rest), pa.int64()), pa.array(theirs + [None] * len(rest), pa.int64()),
            pa.array(none + tab[rest].tolist(), pa.int32()), pa.array(none + code.view(np.int64)[rest].tolist(), pa.int64()),
            pa.array(none + node[rest].tolist(), pa.int64()),
        ], ["a", "b", "tab", "code", "node"])

    return in_runs(step, keys, 1 << 16)


def _streamed_overflow(radius: int, limit: int):
    """As _bucket_links, for buckets of any size: a run that outgrows the limit is passed on in pieces, never held."""
    keys = ["tab", "bucket"]
    whole = _bucket_links(radius, None)

    def passed(rows: pa.Table):
        n = rows.num_rows
        none = pa.nulls(n, pa.int64())
        for batch in pa.table([none, none, rows["tab"].cast(pa.int32()), rows["code"], rows["node"]], ["a", "b", "tab", "code", "node"]).to_batches():
            yield batch

    def apply(batches):
        held, open_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held is not None:
                held = held.combine_chunks()
                bounds = run_bounds(held, keys)
                first = (held["tab"][0].as_py(), held["bucket"][0].as_py())
                if open_key == first:
                    yield from passed(held.slice(0, bounds[1]))
                    held = held.slice(bounds[1]) if bounds[1] < held.num_rows else None
                    continue
                open_key = None
                size, cut = np.diff(bounds), bounds[-2]
                big = np.flatnonzero(size > limit)
                if len(big):
                    s, e = bounds[big[0]], bounds[big[0] + 1]
                    if s:
                        yield from whole(held.slice(0, s).combine_chunks().to_batches())
                    yield from passed(held.slice(s, e - s))
                    open_key = (held["tab"][int(s)].as_py(), held["bucket"][int(s)].as_py())
                    held = held.slice(e) if e < held.num_rows else None
                    continue
                if cut:
                    yield from whole(held.slice(0, cut).combine_chunks().to_batches())
                    held = held.slice(cut)
                break
        if held is not None:
            yield from whole(held.combine_chunks().to_batches())

    return apply


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) node ids whose links connect distinct fingerprints exactly as all pairs within ``radius`` bits would.

    ``nodes(node, code)`` holds each code once.  A bucket of the first family shares half of the bits.  A bucket with more
    than ``bucket`` codes goes through a second family over its free bits; its buckets then fix 48 of 64 bits, hold at most
    2^16 codes, and are searched whole, so no size of group needs a cap.
    """
    masks = covering_masks(list(range(64)), radius)
    rows = nodes.select("node", "code", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tab"), F.col("code").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(masks)
    ])).alias("_t")).select("_t.tab", "_t.bucket", "code", "node")
    first = staged(sorted_runs(rows, ["tab", "bucket"]).mapInArrow(_streamed_overflow(radius, bucket), LINKS))
    second = [[m | s for s in covering_masks(_free(m & (1 << 64) - 1), radius)] for m in masks]
    over = first.where(F.col("node").isNotNull()).distinct().select("tab", "code", "node", F.posexplode(
        F.element_at(F.lit(second).cast("array<array<bigint>>"), F.col("tab") + 1)).alias("sub", "mask")
    ).select((F.col("tab") * 64 + F.col("sub")).alias("tab"), F.col("code").bitwiseAND(F.col("mask")).alias("bucket"), "code", "node")
    deeper = sorted_runs(over, ["tab", "bucket"]).mapInArrow(_bucket_links(radius, None), LINKS)
    return first.where(F.col("a").isNotNull()).select("a", "b").union(deeper.select("a", "b"))


def near_duplicate_artifacts(artifacts: DataFrame, key: str = "frame_id", content: str = "content", shingle: int = SHINGLE,
                             radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every artifact of a bundle corpus.

    Artifacts link at ``radius`` or fewer differing bits; component_id is the smallest key reachable.  Equal fingerprints
    meet in one node before any bucket is built, so a group of copies is one row there.  Null and blank contents share
    fingerprint zero.  A row with a null key links nothing by itself: it gets the component of its fingerprint, null if no
    keyed row has that fingerprint.  Repeated rows stay; other columns are not read; an empty table gives an empty one.
    """
    prints = staged(fingerprints(artifacts, key, content, shingle).withColumnRenamed(key, "_key"))
    nodes = staged(prints.where(F.col("_key").isNotNull()).groupBy(F.col("fingerprint").alias("code")).agg(F.min("_key").alias("node")))
    found = components(fingerprint_links(nodes, radius, bucket))
    by_code = nodes.join(found, "node", "left").select(F.col("code").alias("fingerprint"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(by_code, "fingerprint", "left").select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_component(artifacts: DataFrame, key: str = "frame_id", content: str = "content") -> DataFrame:
    """One row of every component, whole: of its rows that with the smallest key (null last), then the smallest hash of its
    content and of all columns.  Components are those of rows, so repeated keys with different contents are judged apart."""
    columns = artifacts.columns
    rows = staged(artifacts.select("*", F.monotonically_increasing_id().alias("_row")))
    found = near_duplicate_artifacts(rows, key="_row", content=content).select("_row", "component_id")
    order = F.struct(F.col(key).isNull().alias("_none"), key, F.xxhash64(content).alias("_content"), F.xxhash64(*columns).alias("_rest"), "_row")
    first = found.join(rows.select("_row", order.alias("_order")), "_row").groupBy("component_id").agg(F.min("_order").alias("_order"))
    return rows.join(first.select(F.col("_order._row").alias("_row")), "_row", "left_semi").select(*columns)
