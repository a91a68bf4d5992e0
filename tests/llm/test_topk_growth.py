"""What nearest blocks moves: in clustered data the pages that travel grow with the blocks, not with blocks times queries."""

import numpy as np

from blockfield.llm import topk

SCHEMA = "block bigint, coefficients array<bigint>"


def clustered(n, rng, size=32, width=24):
    centres = rng.choice([-100, 100], (n // size, width))
    return [(i, (centres[i % len(centres)] + rng.integers(-5, 6, width)).tolist()) for i in range(n)]


def slow(queries, blocks, k):
    ids, m = np.array([b for b, _ in blocks]), np.array([v for _, v in blocks])
    out = set()
    for q, v in queries:
        scores = m @ np.array(v)
        ranked = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)}
    return out


def test_pages_that_travel_grow_with_the_blocks(spark, monkeypatch):
    moved, kept = [], topk.staged

    def watched(df):
        out = kept(df)
        if out.columns == ["grp", "page"]:
            moved[-1] += out.count()
        return out

    monkeypatch.setattr(topk, "staged", watched)
    sizes, rng = [1024, 2048, 4096, 8192], np.random.default_rng(2)
    for n in sizes:
        moved.append(0)
        blocks = clustered(n, rng)
        queries = [b for b in blocks if b[0] % 16 == 0]
        found = topk.nearest_blocks(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(blocks, SCHEMA), 3, page=32, shelf=8, group=16).collect()
        assert {tuple(r) for r in found} == slow(queries, blocks, 3)
    per_block = [m / n for m, n in zip(moved, sizes)]
    assert max(per_block[1:]) < 2.5 * max(per_block[0], 1 / 64) and moved[-1] < 0.25 * (sizes[-1] / 16 / 16) * (sizes[-1] / 32)


def test_hot_keys_do_not_fill_one_range(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 > 0 THEN 7L ELSE id END AS key", "array(id % 5, 1L) AS v")
    pages = topk.packed(rows, 100, 8, topk.sign_code("v")).select("page", "n").collect()
    per_part = {}
    for p in pages:
        per_part[p.page >> 32] = per_part.get(p.page >> 32, 0) + p.n
    assert sum(per_part.values()) == 5000 and max(per_part.values()) < 1500
