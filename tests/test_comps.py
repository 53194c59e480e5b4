"""Comparable search against brute force: with and without the cell grid, with nulls and ties."""

import numpy as np
import pytest

from cohortcast.operators import comps as cp

FEATURES = ["a", "b", "c", "d"]


def rows(n=320, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        block = "p" if rng.random() < 0.7 else "q"
        vals = [float(x) for x in rng.normal(size=4).round(2)]
        if rng.random() < 0.15:
            vals[int(rng.integers(0, 4))] = None
        if rng.random() < 0.1:
            vals = [0.0, 0.0, 0.0, 0.0]  # many equal rows
        out.append((i, block, 2000 + int(rng.integers(0, 4)), int(rng.integers(1, 263)), *vals, float(i)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "entity_id BIGINT, position STRING, cohort_year INT, slot INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, y DOUBLE").repartition(4)


def brute(spec, params):
    par = {(r["position"], r["cohort"]): r for r in params.collect()}
    all_rows = rows()
    want = {}
    for q in all_rows:
        p = par.get((q[1], q[2]))
        if p is None or p["n_pool"] < spec.min_pool:
            continue
        cands = []
        for r in all_rows:
            if r[1] != q[1] or (r[2] >= q[2] if spec.strict else r[0] == q[0]):
                continue
            total = weight = 0.0
            for (lo, hi, w), inv in zip(spec.layout, p["inv"]):
                size = hi - lo
                diff = np.array([np.nan if q[4 + i] is None or r[4 + i] is None else (q[4 + i] - r[4 + i]) / p["scale"][i] for i in range(lo, hi)])
                frac = np.sum(~np.isnan(diff)) / size
                d = np.nan_to_num(diff)
                total += w * frac * max(0.0, d @ np.array(inv).reshape(size, size) @ d)
                weight += w * frac
            cands.append((abs(q[3] - r[3]), r[0], np.sqrt(total / weight) if weight > 0 else np.inf))
        inside = [c for c in cands if c[0] <= spec.window]
        if len(inside) < spec.k:
            inside = sorted(cands)[:3 * spec.k]
        want[q[0]] = sorted((round(c[2], 7), c[1]) for c in inside)[:spec.k]
    return want


SPECS = {
    "plain": cp.CompSpec({"all": FEATURES}, covariance=False, k=5, window=20),
    "grid": cp.CompSpec({"all": FEATURES}, covariance=False, k=5, window=20, rows_per_cell=2),
    "mahalanobis-grid": cp.CompSpec({"m": ["a", "b", "c"], "n": ["d"]}, {"m": 1.5, "n": 0.5}, k=4, window=60, rows_per_cell=2),
    "leaky-mixed": cp.CompSpec({"m": ["a", "b"], "n": ["c", "d"]}, k=4, window=60, strict=False, rows_per_cell=6),
    "narrow": cp.CompSpec({"all": FEATURES}, covariance=False, k=6, window=1),
}


@pytest.mark.parametrize("name", list(SPECS))
def test_search_equals_brute_force(data, name):
    spec = SPECS[name]
    params = cp.search_params(data, cp.cohort_years(data, "cohort_year"), spec)
    got = {}
    for r in cp.nearest_comps(data, data, spec, ["y"], params).collect():
        got.setdefault(r["entity_id"], []).append((r["comp_rank"], round(r["distance"], 7), r["comp_id"]))
        assert r["y"] == float(r["comp_id"])
    want = brute(spec, params)
    assert set(got) == set(want)
    for i, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
        assert [f[1] for f in sorted(found)] == pytest.approx([w[0] for w in want[i]], abs=2e-6)


def test_nearest_slots_only_look_back(data):
    spec = SPECS["plain"]
    near = cp.nearest_by_slot(data, data, cp.cohort_years(data, "cohort_year"), spec, 4)
    rows_ = near.join(data.selectExpr("entity_id as comp_id", "cohort_year as comp_year"), "comp_id").collect()
    assert rows_ and all(r["comp_year"] < r["cohort"] for r in rows_)
    assert max(r["slot_rank"] for r in rows_) == 4


def test_features_and_reasons(data):
    spec = SPECS["plain"]
    params = cp.search_params(data, cp.cohort_years(data, "cohort_year"), spec)
    found = cp.nearest_comps(data, data, spec, ["y"], params)
    out = cp.comp_features(data, found, params, spec, "y", bust_below=300.0).collect()
    assert len(out) == 320
    first = min(r["cohort_year"] for r in out)
    for r in out:
        if r["cohort_year"] == first:
            assert r["n_pool_used"] == 0 and r["comp_weighted_ppg"] is None
        elif r["comp_bust_rate"] is not None:
            assert 0 <= r["comp_bust_rate"] <= 1
    reasons = cp.comp_reasons(found, data, data, params, spec, {"a": "A", "b": "B", "c": "C", "d": ""}).limit(50).collect()
    assert all(len(r["reasons"].split(", ")) <= 3 for r in reasons)


def test_variants_equal_searches_of_their_own(data):
    base = {"m": ["a", "b"], "n": ["c", "d"]}
    cases = [((1.5, 0.5), 20), ((0.0, 1.0), 60)]
    params = cp.search_params(data, cp.cohort_years(data, "cohort_year"), cp.CompSpec(base))
    from pyspark.sql import functions as F
    variants = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("weights"), F.lit(window).alias("window")) for w, window in cases])
    both = cp.nearest_comps(data, data, cp.CompSpec(base, k=4, rows_per_cell=8), [], params, variants).collect()
    for weights, window in cases:
        spec = cp.CompSpec(base, dict(zip(base, weights)), k=4, window=window)
        got = {}
        for r in both:
            if (tuple(r["variant"]["weights"]), r["variant"]["window"]) == (weights, window):
                got.setdefault(r["entity_id"], []).append(round(r["distance"], 7))
        want = brute(spec, params)
        assert set(got) == set(want) and all(sorted(got[i]) == pytest.approx([w[0] for w in want[i]], abs=2e-6) for i in got)


@pytest.mark.parametrize("name", ["plain", "mahalanobis-grid", "leaky-mixed", "narrow"])
def test_blocks_equal_brute_force(data, name):
    """Blocks of two rows, so that every kind of row goes through them; ties go to the smaller id."""
    from dataclasses import replace
    spec = replace(SPECS[name], rows_per_block=2, rows_per_cell=1000)
    params = cp.search_params(data, cp.cohort_years(data, "cohort_year"), spec)
    got = {}
    for r in cp.nearest_comps(data, data, spec, ["y"], params).collect():
        got.setdefault(r["entity_id"], []).append((r["comp_rank"], round(r["distance"], 7), r["comp_id"]))
    want = brute(spec, params)
    assert set(got) == set(want)
    for i, found in got.items():
        assert [f[1] for f in sorted(found)] == pytest.approx([w[0] for w in want[i]], abs=2e-6)
        assert all(a[2] < b[2] for a, b in zip(sorted(found), sorted(found)[1:]) if a[1] == b[1] == 0.0)


SETTINGS = [((p, m), float(w)) for p, m in ((1.5, 1.0), (1.0, 1.0), (1.0, 1.5), (2.0, 0.5)) for w in (20, 40, 80)]


def kernel(settings, factor=1.0, n=3000):
    """The search of one cell in this process: the comparables of every query, and how many pairs of rows were measured."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    f, slots = rng.normal(size=(n, 4)), rng.integers(1, 200, n)
    f[rng.random(n) < 0.1, 3] = np.nan
    f[::7, 2] = 0.5  # ties along one feature
    spec = cp.CompSpec({"m": ["a", "b"], "n": ["c", "d"]}, k=6, rows_per_block=16)
    asked = np.sort(rng.choice(np.flatnonzero((slots > 80) & (slots < 120)), 300, replace=False))
    asked = asked[np.argsort(np.isnan(f[asked, 3]), kind="stable")]

    def batch(rows, side):
        none, size = pa.array([0] * len(rows), pa.int32()), len(rows)
        features = [[None if np.isnan(x) else float(x) * factor for x in r] for r in f[rows]]
        inv = [[[1.0, 0.3, 0.3, 1.0], [1.0, 0.0, 0.0, 2.0]]] * size if side else [None] * size
        return pa.RecordBatch.from_arrays([
            none, pa.array([side] * size, pa.int32()), pa.array(rows, pa.int64()), pa.array([2001 if side else 2000] * size, pa.int64()), pa.array(slots[rows].astype(float)),
            pa.array(features, pa.list_(pa.float64())), pa.array([[1.0] * 4 if side else None] * size, pa.list_(pa.float64())), pa.array(inv, pa.list_(pa.list_(pa.float64()))),
            pa.StructArray.from_arrays([none], ["none"]), pa.array([False] * size), pa.StructArray.from_arrays([none], ["none"]), pa.nulls(size, pa.list_(pa.float64()))],
            names=["cell", "side", "id", "year", "slot", "f", "scale", "inv", "payload", "again", "own", "far"])

    measured, forms = [], cp._Measure.forms

    def counted(self, qm, columns, blocks):
        out = forms(self, qm, columns, blocks)
        measured.append(out[0].size)
        return out

    cp._Measure.forms = counted
    try:
        found = [r for b in cp._search(spec, settings)(iter([batch(np.arange(n), 0), batch(asked, 1)])) for r in b.to_pylist()]
    finally:
        cp._Measure.forms = forms
    return {r["qid"]: [[(round(x["distance"] / factor, 7), x["comp_id"]) for x in c] for c in r["lists"]] for r in found}, sum(measured), f, slots


def test_one_visit_serves_all_variants():
    """Twelve variants cost about one search, and each gets what it would get alone."""
    together, pairs, f, slots = kernel(SETTINGS)
    alone = [kernel([s]) for s in SETTINGS]
    assert pairs < 4 * max(a[1] for a in alone) and pairs < sum(a[1] for a in alone) / 3
    assert all(lists == [a[0][q][0] for a in alone] for q, lists in together.items())
    for q, lists in list(together.items())[::10]:
        d = np.nan_to_num(f[q] - f)
        have = (~np.isnan(f[q] - f)).reshape(-1, 2, 2).mean(axis=2)
        forms = np.stack([d[:, 0] ** 2 + 0.6 * d[:, 0] * d[:, 1] + d[:, 1] ** 2, d[:, 2] ** 2 + 2 * d[:, 3] ** 2], axis=1)
        for ((weights, window), got) in zip(SETTINGS, lists):
            w = have * weights
            distance = np.where(np.abs(slots - slots[q]) <= window, np.sqrt((w * forms).sum(axis=1) / w.sum(axis=1)), np.inf).round(7)
            assert [c for _, c in got] == np.lexsort((np.arange(len(f)), distance))[:6].tolist()


def test_distances_of_any_size():
    """Distances that leave no room for the row in one number give the same neighbours."""
    small, _, *_ = kernel(SETTINGS[:4])
    large, _, *_ = kernel(SETTINGS[:4], factor=2.0 ** 40)
    assert {q: [[c for _, c in x] for x in lists] for q, lists in small.items()} == {q: [[c for _, c in x] for x in lists] for q, lists in large.items()}


def test_lists_beside_the_query(data):
    """One row per query and variant, repeated ids included, and the errors of their estimates."""
    from pyspark.sql import functions as F
    base = {"m": ["a", "b"], "n": ["c", "d"]}
    cases = [((1.5, 0.5), 20), ((1.0, 1.0), 60)]
    variants = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("weights"), F.lit(window).alias("window")) for w, window in cases])
    params = cp.search_params(data, cp.cohort_years(data, "cohort_year"), cp.CompSpec(base))
    twice = data.where("entity_id % 50 = 0").withColumn("y", F.col("y") + 1000)
    found = cp.nearest_comps(data.union(twice), data, cp.CompSpec(base, k=4), ["y"], params, variants, beside=["y"])
    rows_ = found.collect()
    want = [brute(cp.CompSpec(base, dict(zip(base, w)), k=4, window=window), params) for w, window in cases]
    asked = [(r["entity_id"], r["y"]) for r in data.union(twice).collect()]
    assert sorted((r["entity_id"], r["y"], r["variant"]) for r in rows_) == sorted((i, y, v) for i, y in asked for v in (0, 1) if i in want[v])
    for r in rows_:
        if r["entity_id"] % 50:
            assert [c["distance"] for c in r["comps"]] == pytest.approx([w[0] for w in want[r["variant"]][r["entity_id"]]], abs=2e-6)
        assert len(r["comps"]) == 4 and all(c["y"] == float(c["comp_id"]) for c in r["comps"])
    settings = [(2, 0.5), (4, 1.0)]
    got = {(r["variant"], r["k"], r["bandwidth"]): (r["n"], r["rmse"]) for r in cp.comp_errors(found, "y", "y", settings).collect()}
    for v in (0, 1):
        for k, bw in settings:
            miss = []
            for r in rows_:
                if r["variant"] == v:
                    sim = [np.exp(-c["distance"] / bw) for c in r["comps"][:k]]
                    miss.append(sum(s * c["y"] for s, c in zip(sim, r["comps"])) / sum(sim) - r["y"])
            assert got[v, k, bw][0] == len(miss) and got[v, k, bw][1] == pytest.approx(np.sqrt(np.mean(np.square(miss))))
