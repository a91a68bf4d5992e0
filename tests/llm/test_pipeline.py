"""The pipeline's stages on the smallest given table."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.test_corpus import merge, slow_fingerprint

SF = "/root/testdata/sf0.001"


def slow_passages(rows, length, words):
    """Texts without the stretches of repeated byte strings that hold enough whole words."""
    seen = Counter()
    for _, text in rows:
        data = text.encode()
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = {}
    for key, text in rows:
        data, gone = text.encode(), set()
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = [(s, e) for s, e in zip(sorted(i for i in gone if i - 1 not in gone), sorted(i + 1 for i in gone if i + 1 not in gone))]
        for s, e in reversed(runs):
            inside = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", data) if s <= m.start() and m.end() <= e]
            if len(inside) >= words:
                data = data[: inside[0].start()] + data[inside[-1].end() :]
        out[key] = data.decode()
    return out


def test_passages_of_more_than_fifty_words_go_and_other_documents_stay(spark):
    """Passages of 51 words, in two documents each, from short and long words, at any place; shared texts of 50 words stay."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = {i: text(int(n)) for i, n in enumerate(rng.integers(60, 400, 40))}
    passages = {100 + 2 * k: text(51) for k in range(20)}
    assert all(pipeline.PASSAGE_BYTES <= len(p) for p in passages.values())
    rows, bare = dict(clean), {}
    for key, passage in passages.items():
        for i in (key, key + 1):
            before, after = text(int(rng.integers(5, 80))), text(int(rng.integers(0, 80)))
            rows[i], bare[i] = f"{before} {passage} {after}", (before, after)
    short = text(50)
    stays = {200: f"{text(30)} {short} {text(30)}", 201: f"{text(20)} {short} {text(40)}"}
    rows.update(stays)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in pipeline.suffix_dedup(spark, docs, None).collect()}
    assert all(got[i] == t for i, t in {**clean, **stays}.items())
    assert all(got[i].split() == " ".join(bare[i]).split() for i in bare)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mix to weights", "best-fit packing"]
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])
    assert "pipeline" in entry.queries() and all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 11))


def test_decisions(stages):
    docs, good, single, cut, mixed, packed = [s.collect() for s in stages]
    assert 0 < len(good) < len(docs) and {r.doc_id for r in good} <= {r.doc_id for r in docs}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in good}
    label = merge([(a, b) for a, p in prints.items() for b, q in prints.items() if bin(p ^ q).count("1") <= 4], set(prints))
    assert {r.doc_id for r in single} == set(label.values())
    want = slow_passages([(r.doc_id, r.text) for r in single], pipeline.PASSAGE_BYTES, pipeline.PASSAGE_WORDS)
    assert {r.doc_id: r.text for r in cut} == want
    often = Counter(r.doc_id for r in mixed)
    assert set(often) <= {r.doc_id for r in cut} and max(often.values()) <= 3
    words = sum(len(r.text.split()) for r in cut)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) < 0.2 * words
    assert Counter(r.doc_id for r in packed if r.start == 0) == often


def test_labelled_good_documents_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1 and len(texts[i].split()) >= 10]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_a_component_stays(spark, stages):
    """Whole rows repeated, null ids (unique, repeated, copy of a row with an id), and an id repeated with another text."""
    cut = {r.doc_id: r.text for r in stages[3].collect()}
    docs = [r for r in stages[2].collect() if len(r.text.encode()) >= 400 and cut[r.doc_id] == r.text][:5]
    assert len(docs) == 5
    a, b, c, d, e = [tuple(r) for r in docs]
    none = lambda r: (None, *r[1:])
    rows = spark.createDataFrame([a, a, none(b), none(c), none(c), none(a), d, (d[0], *e[1:])], stages[2].schema).repartition(3)
    want = Counter([a, none(b), none(c), d, (d[0], *e[1:])])
    got = pipeline.simhash_dedup(spark, rows, SF)
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, pipeline.suffix_dedup(spark, got, SF).collect())) == want


def test_run_on_repeated_rows_and_null_ids(spark, tmp_path):
    """Every row twice and every third id null: about the words of one row of each component, with and without ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    good = [r.text for r in pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()]
    prints = {t: slow_fingerprint(t) for t in set(good)}
    label = merge([(a, b) for a, p in prints.items() for b, q in prints.items() if bin(p ^ q).count("1") <= 4], set(prints))
    kept = slow_passages(list(enumerate(set(label.values()))), pipeline.PASSAGE_BYTES, pipeline.PASSAGE_WORDS)
    words = sum(len(t.split()) for t in kept.values())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id is None for r in got} == {True, False}
    assert abs(sum(r["size"] for r in got) - words) < 0.2 * words
