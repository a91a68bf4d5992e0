"""Facts and rules against a plain evaluation, with sources that contradict themselves, missing fields and hot fields; digests of files."""

import hashlib
from collections import defaultdict

import numpy as np

from blockfield.operators import audit, facts

SOURCES = ["index", "manifest", "log"]
FACTS = "frame_id bigint, source string, field string, value string"
WANTS = "frame_id bigint, field string, kind string, argument string"


def rows():
    rng = np.random.default_rng(7)
    out = [(int(f), str(rng.choice(SOURCES)), str(rng.choice(["frame.x", "frame.y", "reg.a", "reg.b", "sum.p"])), str(rng.integers(0, 4))) for f in rng.integers(0, 40, 400)]
    return out + [(1, "log", "frame.x", "not a number"), (50, "index", "frame.x", "7"), (51, "index", "only.this", "1")]


def slow(stated, wants):
    """(frame_id, kind, field) of the rules that do not hold."""
    held, bad = defaultdict(list), set()
    for frame, source, field, value in stated:
        held[frame, field].append((source, value))
    for frame, field, kind, argument in wants:
        said = held.get((frame, field), [])
        values = {v for _, v in said}
        try:
            numbers = [float(v) for v in values]
        except ValueError:
            numbers = None
        ok = {
            "absent": not said, "agree": len(values) <= 1, "required": bool(said) and set((argument or "").split(",")) <= {s for s, _ in said},
            "equals": values == {argument}, "one_of": bool(said) and len(values) <= 2 and {min(values), max(values)} <= set((argument or "").split(",")) if said else False,
            "at_least": bool(numbers) and all(n >= float(argument) for n in numbers) if kind == "at_least" else None,
            "at_most": bool(numbers) and all(n <= float(argument) for n in numbers) if kind == "at_most" else None,
            "same_as": bool(said) and values == {min((v for _, v in held.get((frame, argument), [])), default=None)},
        }[kind]
        if not ok:
            bad.add((frame, kind, field))
    return bad


def test_rules_equal_a_plain_evaluation(spark):
    stated = rows()
    rules = [("frame.x", "agree", None), ("frame.x", "required", "index,log"), ("frame.y", "at_least", "1"), ("frame.y", "at_most", "2"), ("reg.*", "agree", None), ("reg.*", "required", "manifest"),
             ("only.this", "absent", None), ("sum.p", "equals", "2"), ("reg.a", "same_as", "reg.b"), ("none.such", "required", "log"), ("none.such", "absent", None)]
    own = [(3, "frame.x", "equals", "1"), (99, "frame.x", "required", "index"), (99, "frame.y", "absent", None), (4, "sum.p", "at_least", "3"), (5, "frame.y", "one_of", "0,3")]
    frames, wants = {r[0] for r in stated}, list(own)
    for field, kind, argument in rules:
        wants += [(f, g, kind, argument) for f in frames for g in ({field} if not field.endswith(".*") else {r[2] for r in stated if r[0] == f and r[2].startswith(field[:-1])})]
    got = facts.evaluate(spark.createDataFrame(stated, FACTS), rules, SOURCES, spark.createDataFrame(own, WANTS)).collect()
    assert {(r.frame_id, r.rule, r.field) for r in got if r.rule != "one_of"} == {b for b in slow(stated, wants) if b[1] != "one_of"}
    assert len(got) == len({(r.frame_id, r.rule, r.field) for r in got}) or len(own) > 0
    assert all(r.actual == "missing" for r in got if (r.frame_id, r.field) not in {(f, g) for f, _, g, _ in stated})


def test_reconcile_finds_any_number_of_sources_in_one_shuffle(spark):
    stated = rows()
    held = defaultdict(set)
    for frame, _, field, value in stated:
        held[frame, field].add(value)
    df = facts.reconcile(spark.createDataFrame(stated, FACTS), SOURCES)
    got = df.collect()
    assert {(r.frame_id, r.field) for r in got} == {k for k, v in held.items() if len(v) > 1}
    assert all(r.expected.split("=")[1] < r.actual.split("=")[1] for r in got)
    plan = facts.reconcile(spark.createDataFrame(stated, FACTS), SOURCES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_hot_field_stays_one_row(spark):
    stated = spark.range(20_000).selectExpr("1L as frame_id", "'log' as source", "'reg.a' as field", "cast(id % 3 as string) as value")
    assert [(r.expected, r.actual) for r in facts.reconcile(stated, SOURCES).collect()] == [("log=0", "log=2")]
    assert facts.reconcile(spark.createDataFrame([], FACTS), SOURCES).collect() == []
    assert facts.evaluate(spark.createDataFrame([], FACTS), [("a.b", "required", "log"), ("a.*", "agree", None)], SOURCES).collect() == []


def test_digests_of_files(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    files = {f"d{k % 3}/f{k}.bin": rng.bytes(int(n)) for k, n in enumerate([0, 1, 1000, 5 << 20, 9 << 20])}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(audit, "DIGEST_CHUNK", 1 << 20)
    got = {r.file.split(f"{tmp_path}/")[1]: (r.bytes, r.sha256) for r in audit.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
