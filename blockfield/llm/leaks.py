"""Fixture passages inside artifacts: prefix-filtered set join with exact verification.

An item's window (``words`` consecutive words, or all of a shorter item) is contained in an artifact only if all of its
shingles are, so one of them, the necessary prefix, is enough to find candidates: the rarest in the artifacts.  An
artifact's shingle joins the windows of that prefix; where the window would have to begin and end follows from the
shingle's place in both, and the words there are compared.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.shared import content_bytes, staged

WORDS = 10
SHINGLE = 5
#: Bits of the filter of fixture shingles, per shingle, and at least and at most; artifact shingles outside it are not shuffled.
BITS, FEWEST, MOST = 16, 1 << 18, 1 << 27
#: Hashes of words that a worker remembers.
REMEMBERED = 300_000
#: Bytes of words stay, A-Z as a-z; all other ASCII becomes a blank.
PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def plain_words(content: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return content.translate(PLAIN).split()


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _windows(words: int, shingle: int):
    """Every window of every item: its words, joined, their number, and each shingle of it with its place."""
    def step(batches):
        known = WordHashes()
        for batch in batches:
            out = [[] for _ in range(4)]
            for item, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = plain_words(content)
                size = min(words, len(w))
                h = shingle_hashes(w, min(shingle, size), known).view(np.int64).tolist() if w else []
                for at in range(len(w) - size + 1 if w else 0):
                    values = (item, b" ".join(w[at : at + size]), size, h[at : at + size - min(shingle, size) + 1])
                    for column, v in zip(out, values):
                        column.append(v)
            types = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["item", "window", "size", "hashes"])

    return step


class Filter:
    """Which shingle hashes may be those of fixtures: a bit map of bounded size; a set bit may be another's, an unset one is sure."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.map = np.zeros(bits // 8, np.uint8)
        for at, chunk in chunks.items():
            part = np.frombuffer(chunk, np.uint8)[: len(self.map)]
            self.map[at * 4096 : at * 4096 + len(part)] = part

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return np.flatnonzero(self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def filter_of(keys: DataFrame, count: int) -> Filter:
    """The bit map of the ``hash`` column; Spark sets the bits, at most MOST / 8 bytes come to the driver."""
    bits = min(MOST, max(FEWEST, 1 << (BITS * count).bit_length()))
    spot = F.col("hash").bitwiseAND(bits - 1)
    chunks = keys.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 32768).alias("chunk")).agg(F.expr("bitmap_construct_agg(spot % 32768)").alias("map"))
    return Filter(bits, {r["chunk"]: bytes(r["map"]) for r in chunks.collect()})


def _counted(shared, sizes: list[int]):
    """How often the fixtures' shingles stand in a batch of artifacts."""
    def step(batches):
        known, wanted = WordHashes(), shared.value
        for batch in batches:
            found = []
            for content in batch.column(0).to_pylist():
                w = plain_words(content)
                for size in sizes:
                    h = shingle_hashes(w, size, known)
                    found.append(h[wanted.places(h)])
            hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    return step


PLACES = "row bigint, frame_id bigint, n_words bigint, hash bigint, at bigint, lead int, around binary"


def _placed(shared, sizes: list[int], words: int):
    """One row per artifact with its number of words, and one per prefix shingle in it, with the words a window there can reach."""
    def step(batches):
        known, wanted = WordHashes(), shared.value
        for batch in batches:
            out = [[] for _ in range(7)]
            for row, frame, content in zip(*(batch.column(c).to_pylist() for c in ("row", "frame_id", "content"))):
                w = plain_words(content)
                rows = [(row, frame, len(w), None, None, None, None)]
                for size in sizes:
                    h = shingle_hashes(w, size, known)
                    for i in wanted.places(h).tolist():
                        lead = min(i, words - 1)
                        rows.append((row, frame, None, int(h[i : i + 1].view(np.int64)[0]), i, lead, b" ".join(w[i - lead : i + words])))
                for column, values in zip(out, zip(*rows)):
                    column += values
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["row", "frame_id", "n_words", "hash", "at", "lead", "around"])

    return step


def fixture_windows(fixtures: DataFrame, key: str = "frame_id", content: str = "content", words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """(item, window, size, hashes) of all windows of the fixtures; a null key or a content without words has none."""
    items = fixtures.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), content_bytes(content).alias("content"))
    return items.mapInArrow(_windows(words, shingle), "item string, window binary, size int, hashes array<bigint>")


def occurrences(artifacts: DataFrame, fixtures: DataFrame, words: int = WORDS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artifacts, found, items): (row, frame_id, n_words), (row, start, stop, window) and (window, item), all written.

    Both passes read every artifact whole.  The first counts the fixtures' shingles in the artifacts, the second finds the
    places of the prefixes: of each different window its rarest shingle, of equally rare ones the least hash, so that
    neighbouring windows share them.  A window with a shingle that no artifact holds is in none and drops out.
    """
    context = artifacts.sparkSession.sparkContext
    texts = artifacts.select(F.monotonically_increasing_id().alias("row"), "frame_id", "content")
    windows = staged(fixture_windows(fixtures, words=words, shingle=shingle))
    kinds = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    shingles = staged(kinds.select("window", "size", F.posexplode("hashes").alias("place", "hash")))
    keys = shingles.select("hash").distinct()
    sizes = sorted({min(shingle, r["size"]) for r in shingles.select("size").distinct().collect()})
    wanted = context.broadcast(filter_of(keys, keys.count()))
    seen = texts.select("content").mapInArrow(_counted(wanted, sizes), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    rare = shingles.join(seen, "hash", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("least"))
    prefixes = staged(rare.where("least.n > 0").select("window", "size", "least.hash", "least.place"))
    chosen = prefixes.select("hash").distinct()
    used = context.broadcast(filter_of(chosen, chosen.count()))
    near = staged(texts.mapInArrow(_placed(used, sizes, words), PLACES))
    # where the window would begin among the words around the shingle, and whether it fits there
    begin, apart = F.col("lead") - F.col("place"), F.split(F.col("around").cast("string"), " ")
    met = near.where("hash IS NOT NULL").join(prefixes, "hash").where(begin >= 0)
    met = met.where(F.array_join(F.slice(apart, begin + 1, F.col("size")), " ").cast("binary") == F.col("window"))
    start = F.col("at") - F.col("place")
    found = staged(met.select("row", start.alias("start"), (start + F.col("size")).alias("stop"), "window"))
    return near.where("hash IS NULL").select("row", "frame_id", "n_words"), found, windows.select("window", "item").distinct()


def fixture_leaks(artifacts: DataFrame, fixtures: DataFrame, key: str = "frame_id", content: str = "content", fixture_key: str = "frame_id",
                  fixture_content: str = "content", words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_words, n_hit, items ARRAY<STRING>) of the artifacts: which fixtures' passages stand in them.

    A window is ``words`` consecutive words of a fixture; a fixture of fewer words is one window.  n_hit counts the artifact's
    words inside any occurrence of a window, items are the fixtures with an occurring window, sorted as strings.  Words are
    compared exactly, after hashes have found the candidates.  One row per row, also of repeated keys; rows with a null key
    take part; a null content has no words, a null fixture or one with a null key no window; repeated fixtures count once;
    other columns are not read; an empty table of artifacts gives an empty one, one of fixtures no hit.
    """
    rows = artifacts.select(F.col(key).cast("bigint").alias("frame_id"), content_bytes(content).alias("content"))
    known = fixtures.select(F.col(fixture_key).alias("frame_id"), F.col(fixture_content).alias("content"))
    base, found, items = occurrences(rows, known, words, shingle)
    order = Window.partitionBy("row").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    hit = spans.select("row", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named = found.select("row", "window").distinct().join(items, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = base.join(hit, "row", "left").join(named, "row", "left")
    return out.select(F.col("frame_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
