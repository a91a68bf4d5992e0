"""Periodic runs against a search of every period, on artifacts with planted periods, nulls, blanks, repeats and long texts."""

import hashlib
import zlib

import numpy as np
import pytest

from blockfield.llm import catalog, periods
from tests.llm.test_corpus import TEXT, WORD

SF = "/root/testdata/sf0.001"


def slow_runs(words, least=12):
    """(start, period, length): for every period the maximal intervals of equal words a period apart."""
    n, out = len(words), []
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - s + q
            block = codes[s : s + length]
            if length >= max(least, 2 * q) and not any((block[:-d] == block[d:]).all() for d in range(1, q)):
                out.append((s, q, length))
    return sorted(out)


def slow_kept(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng, words, n):
    """Words with nested periods: blocks of blocks, cut anywhere, between random words."""
    block = list(rng.choice(words, int(rng.integers(1, 9))))
    block = (block * int(rng.integers(1, 6)) + list(rng.choice(words, int(rng.integers(0, 4)))))
    tail = (block * (n // len(block) + 1))[: int(rng.integers(1, n))]
    return list(rng.choice(words, int(rng.integers(0, 30)))) + tail + list(rng.choice(words, int(rng.integers(0, 30))))


@pytest.fixture(scope="module")
def contents():
    rng = np.random.default_rng(11)
    words = ["a", "b", "w1", "w2", "é", "日本", "x²", "long-word", "A"]
    rows = [" ".join(planted(rng, words[: int(rng.integers(1, 9))], int(rng.integers(2, 400)))) for _ in range(120)]
    rows += [" ".join(rng.choice(words[:2], int(n))) for n in rng.integers(1, 300, 20)]
    rows += [" ".join(rng.choice([f"v{i}" for i in range(500)], 400)) for _ in range(10)]
    rows += [None, "", " \t\n", "one", "De " * 11, "De " * 12, "a\tb\n" * 6, "a\x1cb " * 12, "a b c\x0b" * 7, "a b c d e f g " * 2, "long " * 3000, ("p " * 7 + "q ") * 900 + "tail"]
    pairs = list(enumerate(rows))
    return pairs + [(3, rows[3]), (3, rows[3]), (5, rows[6]), (None, rows[7]), (None, rows[7]), (None, None)]


def test_equals_search_of_every_period(spark, contents):
    artifacts = spark.createDataFrame([(i, t, "clash", "clash") for i, t in contents], TEXT).withColumnRenamed("whole", "runs").repartition(3)
    got = [(r.frame_id, tuple(tuple(x[k] for k in ("start", "period", "length")) for x in r.runs), bytes(r.kept).decode()) for r in periods.periodic_runs(artifacts).collect()]
    want = []
    for i, t in contents:
        words = WORD.findall(t or "")
        runs = slow_runs(words)
        want.append((i, tuple(runs), slow_kept(words, runs)))
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(len(r[1]) for r in want) > 200


def test_octaves_cover_every_period_once():
    for n in (12, 100, 5000):
        seen = [q for low, high, _ in periods.octaves(n) for q in range(low, high)]
        assert seen == sorted(set(seen)) and seen[-1] >= n // 2


def test_tiles_stitch_a_run_longer_than_a_tile(spark):
    words = ["x"] * 50 + [f"k{i % 9}" for i in range(40_000)] + ["y"]
    artifacts = spark.createDataFrame([(1, " ".join(words), "", "")], TEXT)
    row = periods.periodic_runs(artifacts).collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 1, 50), (50, 9, 40_000)]
    assert bytes(row.kept).decode() == " ".join(["x"] + words[50:59] + ["y"])


def test_hot_repeated_rows_are_solved_once(spark):
    """Nine tenths of the rows are one artifact: its tiles and fragments are those of one row."""
    text = "a b c " * 40
    artifacts = spark.createDataFrame([(7, text, "", "")] * 900 + [(i, f"{i} " + text, "", "") for i in range(100)], TEXT)
    rows = periods.periodic_runs(artifacts).collect()
    assert len(rows) == 1000 and sum(r.frame_id == 7 for r in rows) == 901
    assert all(len(r.runs) == 1 and r.runs[0]["period"] == 3 for r in rows)


def test_empty(spark):
    assert periods.periodic_runs(spark.createDataFrame([], TEXT)).collect() == []


def test_query_equals_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = slow_runs(words) if len(words) < 3000 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        assert r.n_runs == len(runs)
        top = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
        assert (r.start, r.period, r.length) == (top or (None, None, None))
        assert r.exponent_milli == (1000 * top[2] // top[1] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_kept(words, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10
