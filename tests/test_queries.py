"""The registered queries: coverage of the inventory, readable oracles, and a sample run against them."""
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
INVENTORY = {"a": 28, "b": 25, "c": 14, "d": 28, "e": 18, "f": 11, "g": 19, "h": 14, "i": 7, "j": 15, "k": 8}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_inventory_row_has_a_query():
    have = {found.group() for n in entry_point.queries() if (found := re.match(r"[a-k]\d+(?=_)", n))}
    want = {f"{s}{i}" for s, n in INVENTORY.items() for i in range(1, n + 1)}
    assert want - have == set()
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_oracles_parse(duck):
    for name, sql in entry_point.oracle_sql().items():
        duck.execute("EXPLAIN " + sql)


SAMPLE = ["a15_quality_report", "b14_defect_score", "c10_resolved_rates", "d9_ring_statistics", "e14_f1_threshold", "f8_conformal_sweep", "h3_policy_comparison",
          "i4_shrunk_estimates", "j1_drift_windows_streamed", "j9_decisions_with_outcomes", "j10_entity_state", "j15_late_rows", "k7_evidence"]


def _key(row):
    return repr([round(x, 3) if isinstance(x, float) else x for x in row])


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    cur = duck.execute(entry_point.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()), key=_key)
    assert sorted((tuple(r) for r in df.collect()), key=_key) == want


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() >= 1


@pytest.mark.parametrize("name", ["b15_payment_fallback", "b16_cyclic_hour", "b17_channel_risk", "b18_log_transforms", "b19_basket_vs_locality", "b20_smoothed_rate"])
def test_scalar_query_equals_oracle(spark, duck, name):
    """Queries that name their columns only when they run: an import they miss shows nowhere else."""
    df = entry_point.queries()[name](spark, SF)
    cur = duck.execute(entry_point.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
