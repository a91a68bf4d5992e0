"""Named queries against their reference SQL at the smallest scale, and the registry's own rules."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "prj06_xyb", "join01_pad", "agg01_contrast_cells", "job09_raw_quant", "agg07_cfl", "prj17_quantize", "win02_dc_tokens",
    "win05_metadata_tokens", "win06_ac_tokens", "job18_all_tokens_estimated", "job11_choose_shape", "job12_adjust_quant", "job21_compare_runs",
    "job23_audit_bundles", "src02_words_csv", "src03_words_bin", "job22_assemble_blocks", "flt06_value_ranges", "agg13_declared_counts",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_reference_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    reference = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(reference.columns)
    got = normal(df.collect(), df.columns)
    assert got and got == normal(reference.fetchall(), reference.columns)


#: Queries that run jobs to build their plan (files written, streams drained, counts taken) are planned by the sample above or by their own tests.
EAGER = ("src", "snk", "str", "op", "pipeline")


def test_every_query_is_planned(spark):
    """Analysis of every registered query whose plan needs no job of its own: a column that is missing shows here."""
    names = [n for n in entry.queries() if not n.startswith(EAGER)]
    assert len(names) > 120
    bad = {}
    for name in names:
        try:
            assert entry.queries()[name](spark, SF).columns
        except Exception as fault:  # noqa: BLE001  collected, so that one run names all
            bad[name] = str(fault)[:200]
    assert not bad


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["nonzeros"] > 0 for r in rows)
