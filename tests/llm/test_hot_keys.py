"""One key, or null, on nine tenths of the rows: results stay whole and no task takes most rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockfield.llm import catalog, mixing, packing, passages, suffixes, token_files
from blockfield.llm.shared import staged
from tests.llm.test_corpus import slow_cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = 20_000


@pytest.mark.parametrize("hot", [None, 5])
def test_mix(spark, hot):
    rows = spark.range(N).select(F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise(F.col("id") + 100).cast("bigint").alias("frame_id"), F.lit("s").alias("stage"), (F.col("id") % 3 * 5).alias("token_count"))
    weights = spark.createDataFrame([("s", 1)], "stage string, weight bigint")
    out = staged(mixing.mix_streams(rows, weights))
    total = sum(i % 3 * 5 for i in range(N))
    assert out.count() == N and out.agg(F.sum("taken")).first()[0] == total
    assert Counter(map(tuple, out.select("frame_id", "token_count").collect())) == Counter(map(tuple, rows.select("frame_id", "token_count").collect()))


def test_mix_takes_part_of_equal_rows(spark):
    """The fractional pass ends among copies: each copy is walked by itself."""
    rows = spark.createDataFrame([(1, "a", 10)] * 50 + [(2, "b", 10)] * 10, "frame_id bigint, stage string, token_count bigint")
    weights = spark.createDataFrame([("a", 1), ("b", 1)], "stage string, weight bigint")
    out = mixing.mix_streams(rows, weights).collect()
    assert sum(r.taken for r in out if r.stage == "a") == 300 and sum(r.taken for r in out if r.stage == "b") == 300
    assert Counter(r.part for r in out if r.stage == "a") == {10: 30, 0: 20}


@pytest.mark.parametrize("hot", [None, 5])
def test_packing(spark, hot):
    rows = spark.range(N).select(F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise(F.col("id") + 100).cast("bigint").alias("frame_id"), F.lit(5).cast("bigint").alias("token_count"))
    out = packing.pack_streams(rows, shelf=1000).collect()
    assert Counter((r.frame_id, r.token_count, r.start, r["size"]) for r in out) == Counter((r.frame_id, 5, 0, 5) for r in rows.collect())
    assert max(Counter(r.shelf for r in out).values()) < N / 10
    used = Counter()
    for r in out:
        used[r.shelf, r.sequence, r.offset] += 1
    assert max(used.values()) == 1


def test_token_files(spark):
    texts = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("frame_id"), F.concat_ws(" ", F.lit("same words"), (F.col("id") % 2).cast("string")).alias("content"))
    manifest = token_files.write_token_files(texts, catalog.vocabulary())
    files = manifest.collect()
    assert len(files) > 2 and max(f.artifacts for f in files) < 2000 and sum(f.artifacts for f in files) == 4000
    rows = sorted(token_files.read_artifact_ids(manifest).collect(), key=lambda r: r.start)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    keys = [r.frame_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_suffix_repeats_of_one_repeated_row(spark):
    """A row many times and a neighbour that shares a passage: the anchor's surroundings are met once."""
    import numpy as np

    rng = np.random.default_rng(3)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = text(500)
    rows = [(1, text(300) + shared)] * 300 + [(2, shared + text(200))]
    frame = spark.createDataFrame(rows, "frame_id bigint, content string").repartition(4)
    got = Counter((r.frame_id, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(frame).collect())
    assert got == {(1, 800, 1): 300, (2, 500, 1): 1}
    assert slow_cut([(1, rows[0][1]), (2, rows[-1][1])], 400)[1][2] == 500


def test_passages_of_one_repeated_row(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words))] * 300 + [(2, " ".join([*words[:60], "other", *words[61:]])), (3, "short text")]
    got = {r.frame_id: r.class_id for r in passages.near_duplicate_passages(spark.createDataFrame(rows, "frame_id bigint, content string").repartition(4)).collect()}
    assert got == {1: 1, 2: 1}
