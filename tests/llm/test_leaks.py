"""Fixture leaks against a scan of every window: short items, nulls, repeats, overlaps, hot passages and filter collisions."""

import re
from collections import Counter

import numpy as np
import pytest

from blockfield.llm import leaks
from tests.llm.test_corpus import TEXT

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIXTURES = "frame_id bigint, content string, item string, size string"


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_leaks(artifacts, fixtures, words=10):
    windows = {}
    for item, text in fixtures:
        w = plain(text)
        size = min(words, len(w))
        for at in range(len(w) - size + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add(str(item))
    sizes, out = sorted({len(x) for x in windows}), []
    for key, text in artifacts:
        w, hit, items = plain(text), set(), set()
        for m in sizes:
            for at in range(len(w) - m + 1):
                found = windows.get(tuple(w[at : at + m]))
                if found:
                    hit.update(range(at, at + m))
                    items |= found
        out.append((key, len(w), len(hit), tuple(sorted(items))))
    return Counter(out)


def tables():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "x2"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 40, 40))]
    items += [(100, "The"), (101, "the end"), (102, None), (103, ""), (104, " .,; "), (None, text(20)), (5, items[5][1]), (106, items[6][1]), (107, "a a a a a a a a a a a a"), (108, "B" + " b" * 6), (10, text(12)), (9, text(12))]
    rows = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 200, 60))]
    for i in range(40):
        body = plain(items[i][1])
        cut = body[int(rng.integers(0, 3)) :] if i % 3 else body
        sep = ["; ", "\n", " - ", "]["][i % 4]
        rows.append((200 + i, text(int(rng.integers(0, 30))) + " " + sep.join(cut).upper() + " " + text(int(rng.integers(0, 30)))))
    rows += [(300, None), (301, ""), (302, "...")] + [(303, "a " * 50), (304, "The END"), (305, "b " * 20), (None, items[7][1]), (200, rows[60][1]), (200, rows[60][1]), (306, text(5000) + " " + items[8][1])]
    rows.append((307, " ".join(plain(items[5][1])[:9])))
    return rows, items


@pytest.mark.parametrize("words,shingle", [(10, 5), (4, 5), (10, 1), (6, 3)])
def test_equals_scan_of_every_window(spark, words, shingle):
    rows, items = tables()
    artifacts = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], TEXT).withColumnRenamed("whole", "row").repartition(3)
    fixtures = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], FIXTURES)
    got = Counter((r.frame_id, r.n_words, r.n_hit, tuple(r["items"])) for r in leaks.fixture_leaks(artifacts, fixtures, words=words, shingle=shingle).collect())
    want = slow_leaks(rows, items, words)
    assert got == want and sum(1 for r in want if r[2]) > 30


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """The bit map only thins candidates: with all bits set by collisions the results are the same."""
    rows, items = tables()
    monkeypatch.setattr(leaks, "FEWEST", 8)
    monkeypatch.setattr(leaks, "MOST", 64)
    artifacts = spark.createDataFrame([(i, t, "", "") for i, t in rows], TEXT)
    fixtures = spark.createDataFrame([(i, t, "", "") for i, t in items], FIXTURES)
    got = Counter((r.frame_id, r.n_words, r.n_hit, tuple(r["items"])) for r in leaks.fixture_leaks(artifacts, fixtures).collect())
    assert got == slow_leaks(rows, items)


def test_hot_passage(spark):
    """Nine tenths of the artifacts hold one passage, and many fixtures share it."""
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"x{i} {passage} y{i}") for i in range(450)] + [(i, f"x{i} z{i}") for i in range(450, 500)]
    items = [(i, f"{passage} q{i}") for i in range(30)]
    artifacts = spark.createDataFrame([(i, t, "", "") for i, t in rows], TEXT)
    fixtures = spark.createDataFrame([(i, t, "", "") for i, t in items], FIXTURES)
    got = Counter((r.frame_id, r.n_words, r.n_hit, tuple(r["items"])) for r in leaks.fixture_leaks(artifacts, fixtures).collect())
    assert got == slow_leaks(rows, items)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], TEXT), spark.createDataFrame([], FIXTURES)
    some = spark.createDataFrame([(1, "one two", "", "")], TEXT)
    fixtures = spark.createDataFrame([(1, "two", "", "")], FIXTURES)
    assert leaks.fixture_leaks(none, fixtures).collect() == []
    row = leaks.fixture_leaks(some, no_items).collect()
    assert [(r.frame_id, r.n_words, r.n_hit, r["items"]) for r in row] == [(1, 2, 0, [])]
