"""Merkle manifests against trees built on the driver: nulls, ties, repeated rows, hot groups, lone leaves, tampering."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blockfield.llm import merkle

RECORDS = "frame_id bigint, artifact string, source string, content string, leaf string, path string, n bigint"
FIELDS = ("frame_id", "source", "artifact", "content")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fanout):
    """Root and, for every leaf, its path of (left, right)."""
    level, above, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, at in enumerate(above):
            run = at - at % fanout
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        above = [at // fanout for at in above]
        level = [digest(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def slow_manifest(rows, fanout):
    """(frame_id, artifact, leaf, subroot, root, path) of (frame_id, artifact, source, content) rows, as a multiset."""
    groups = defaultdict(list)
    for frame, artifact, source, content in rows:
        groups[artifact].append((frame is not None, frame or 0, digest(coded(frame), coded(source), coded(artifact), coded(content)), frame))
    order = sorted(groups, key=lambda a: (a is not None, (a or "").encode()))
    trees = {a: tree([leaf for _, _, leaf, _ in sorted(groups[a], key=lambda x: x[:3])], fanout) for a in order}
    root, tops = tree([trees[a][0] for a in order], fanout) if order else (None, [])
    return Counter((frame, a, leaf, trees[a][0], root, tuple(path + top)) for a, top in zip(order, tops)
                   for (_, _, leaf, frame), path in zip(sorted(groups[a], key=lambda x: x[:3]), trees[a][1]))


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", -1) for r in rows], RECORDS)


def got(df):
    return Counter((r.frame_id, r.artifact, r.leaf, r.subroot, r.root, tuple((s["left"], s["right"]) for s in r.path)) for r in df.collect())


def mixed():
    rows = [(i, ["a", "b", "é", "B", "ab", None][i * i % 6], "s" if i % 7 else None, None if i % 11 == 0 else f"text {i % 5} é") for i in range(230)]
    rows += [(7, "a", "s", "one"), (7, "a", "s", "two"), (7, "a", "s", "two"), (None, "a", "s", "x"), (None, "b", None, None), (1, "lone", "s", ""), (2, "", "s", "y" * 3000)]
    return rows


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_equals_trees(spark, fanout):
    rows = mixed()
    df = frame_of(spark, rows).repartition(3)
    assert got(merkle.merkle_manifest(df, FIELDS, fanout=fanout)) == slow_manifest(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65])
def test_sizes_around_full_runs(spark, n):
    rows = [(i, "a", None, str(i)) for i in range(n)]
    assert got(merkle.merkle_manifest(frame_of(spark, rows), FIELDS)) == slow_manifest(rows, 8)


def test_tampering_shows_and_other_records_verify(spark):
    df = frame_of(spark, mixed()).withColumn("seen", F.when(F.col("frame_id") % 3 == 0, merkle.leaf_digest("frame_id", "source", "artifact", F.concat("content", F.lit("!")))))
    out = merkle.merkle_manifest(df, FIELDS, carry=("seen", "n")).select(
        "frame_id", "leaf", "root", "n", "seen", merkle.folded_root("path", "leaf").alias("own"), merkle.folded_root("path", F.coalesce("seen", "leaf")).alias("folded"))
    rows = out.collect()
    assert all(r.own == r.root and r.n == -1 for r in rows) and len({r.root for r in rows}) == 1
    assert all((r.folded == r.root) == (r.seen is None or r.seen == r.leaf) for r in rows)
    assert any(r.folded != r.root for r in rows)


def test_proof_is_the_digest_of_all_siblings(spark):
    rows = [(i, "a", None, str(i)) for i in range(20)] + [(99, "z", None, None)]
    df = merkle.merkle_manifest(frame_of(spark, rows), FIELDS)
    pairs = df.select("path", merkle.proof_digest("path").alias("p")).collect()
    assert all(r.p == digest(*(s["left"] + s["right"] for s in r.path)) for r in pairs)
    lone = merkle.merkle_manifest(frame_of(spark, [(1, None, None, None)]), FIELDS).select("leaf", "subroot", "root", merkle.proof_digest("path").alias("p")).first()
    assert lone.leaf == lone.subroot == lone.root == digest("1:1", "-", "-", "-") and lone.p == digest()


def test_hot_group_of_one_repeated_record_spreads(spark):
    """Nine tenths of the rows are one record of one group: the ranges that number them stay small."""
    rows = [(5, "hot", "s", "same")] * 1800 + [(i, "cold", "s", str(i)) for i in range(200)]
    df = frame_of(spark, rows).repartition(4)
    placed = merkle.placed(df.select("artifact", "frame_id", F.lit("d").alias("digest")), "artifact", "frame_id", "digest")
    places = placed.where("artifact = 'hot'").select("place", "n").collect()
    assert sorted(p.place for p in places) == list(range(1800)) and {p.n for p in places} == {1800}
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(4, "artifact", "frame_id", "_row")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 900
    assert got(merkle.merkle_manifest(df, FIELDS)) == slow_manifest(rows, 8)


def test_empty(spark):
    assert merkle.merkle_manifest(frame_of(spark, []), FIELDS).collect() == []
