"""The registered queries: contract, and a sample against SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from cohortcast.sources.tables import SCHEMAS

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("scan_star", "outcome_target", "event_conditional_stats", "two_pass_match", "first_threshold", "ecdf_against_ref",
          "archetype_rules", "rule_points", "talking_points", "page_files", "clean_export", "final_blend", "metrics_rollup", "calibration_bins", "temporal_folds", "class_summary")


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in queries)
    assert not [s for s in oracles.values() if re.search(r"\busing sample\b|\btablesample\b", s, re.I)]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in SCHEMAS:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain(df.columns, df.collect()) == plain(cols, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert "entity_id" in df.columns and df.count() > 0


def test_outcome_and_features_share_a_panel(spark, monkeypatch):
    """Model rows work out the panel once, and both sides are what they are from panels of their own."""
    from cohortcast.plans import base, models
    from __spark_entry__ import SMOKE_DIR
    made, panel = [], base.panel
    monkeypatch.setattr(base, "panel", lambda *a: made.append(a) or panel(*a))
    assert models.cohort_rows(spark, SMOKE_DIR).count() > 0 and len(made) == 1
    for got, want in zip(base.outcome_and_features(spark, SMOKE_DIR), (base.outcome(spark, SMOKE_DIR), base.features(spark, SMOKE_DIR))):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
