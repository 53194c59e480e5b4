"""Learned recipe and model bundles on small generated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.operators import bundle as bd
from cohortcast.operators import models as md

SPEC = bd.BundleSpec(("x", "z", "flat", "none"), {"seen": ["z"]}, "year", "hit", "log_y", "bucket", 5, {"lo": 0.2, "hi": 0.8}, md.Trees(rounds=4, sample=1.0), 3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, z = (float(v) for v in rng.normal(size=2))
        y = 2 * x + float(rng.normal())
        group = "ab"[i % 2] if i < 280 else "rare"
        rows.append((i, group, 2000 + i % 5, x if i % 7 else None, z, int(i % 3 > 0), 1.0, None, y, int(y > 0), y, int(np.digitize(y, [-2, -0.5, 0.5, 2])) if group != "b" else None))
    rows.append((300, None, 2004, None, None, None, None, None, 0.0, 0, 0.0, None))
    kinds = "id INT, grp STRING, year INT, x DOUBLE, z DOUBLE, seen INT, flat DOUBLE, none DOUBLE, y DOUBLE, hit INT, log_y DOUBLE, bucket INT"
    return spark.createDataFrame(rows, kinds).repartition(3).cache()


def test_recipe_learns_and_is_saved(spark, data, tmp_path):
    bd.Recipe(SPEC.features, SPEC.fills).fit(data.where("year < 2003")).write().save(str(tmp_path / "r"))
    model = bd.RecipeModel.load(str(tmp_path / "r"))
    assert model.getOrDefault("kept") == ["x", "z"]
    early = [r for r in data.where("year < 2003").collect()]
    x_med = np.median([r["x"] for r in early if r["x"] is not None])
    z_med = np.median([0.0 if r["seen"] == 0 else r["z"] for r in early])
    for r in model.transform(data).join(data.select("id", F.col("x").alias("x0"), F.col("z").alias("z0")), "id").collect():
        z = 0.0 if r["seen"] == 0 else r["z0"]
        assert r["x"] == pytest.approx(r["x0"] if r["x0"] is not None else x_med) and r["z"] == pytest.approx(z if z is not None else z_med)
        assert (r["flat"], r["none"]) == (1.0, 0.0) and list(r["features"]) == [r["x"], r["z"]]


def test_time_cuts():
    assert bd.time_cuts({2000: 10, 2001: 10, 2002: 10, 2003: 10}) == (2002, 2003)
    assert bd.time_cuts({2000: 1, 2001: 1}) == (2000, 2001)
    assert bd.time_cuts({2000: 1, 2001: 99}) == (2000, 2001)  # nothing is left to fit before 2000, so no early stop
    assert bd.time_cuts({2000: 1, 2001: 1, 2002: 99}) == (2001, 2002)
    with pytest.raises(ValueError, match="two years"):
        bd.time_cuts({2000: 50})


def test_bundles_by_group(spark, data, tmp_path):
    bundles = bd.fit_bundles(data.where("year < 2004"), "grp", SPEC)
    assert set(bundles) == {"a", "b", bd.REST} and bundles["b"].buckets is None
    fresh = bd.score_bundles(data, "grp", bundles)
    names = bd.save_bundles(bundles, str(tmp_path / "all"))
    rows = bd.score_bundles(data, "grp", bd.load_bundles(spark, str(tmp_path / "all"), names)).collect()
    assert len(rows) == 301
    want = {r["id"]: r for r in fresh.collect()}
    for r in rows:
        assert r["bundle"] == (r["grp"] if r["grp"] in ("a", "b") else bd.REST)
        assert (r["p_raw"], r["p_made_it"], r["value"], r["lo"], r["hi"]) == pytest.approx([want[r["id"]][c] for c in ("p_raw", "p_made_it", "value", "lo", "hi")])
        assert 0 <= r["p_made_it"] <= 1 and r["lo"] <= r["hi"] and (r["probs"] is None) == (r["bundle"] == "b")
    late = [r for r in rows if r["year"] == 2004 and r["grp"]]
    base = np.mean([r["hit"] for r in rows if r["year"] < 2004])
    assert sum((r["p_made_it"] - r["hit"]) ** 2 for r in late) < sum((base - r["hit"]) ** 2 for r in late)
    with pytest.raises(ValueError, match="lack"):
        bundles["a"].score(data.drop("x"))
    with pytest.raises(ValueError, match="no bundle"):
        bd.score_bundles(data, "grp", {"a": bundles["a"]})


def test_calibrator_sees_later_years_only(spark, data):
    """Flipped labels of the calibration year change the map but not the model that scored it."""
    train = data.where("grp = 'a'")
    years = {r["year"]: r["count"] for r in train.groupBy("year").count().collect()}
    _, calibrate = bd.time_cuts(years)
    flipped = train.withColumn("hit", F.when(F.col("year") >= calibrate, 1 - F.col("hit")).otherwise(F.col("hit")))
    first, other = bd.fit_bundle(train, SPEC, years), bd.fit_bundle(flipped, SPEC, years)
    assert list(first.calibrator.boundaries) and list(first.calibrator.predictions) != list(other.calibrator.predictions)
    assert first.classifier.getNumTrees == other.classifier.getNumTrees


def test_rows_lie_in_order_of_their_positions(spark, monkeypatch):
    """One panel makes the rows, and each file holds a position's rows together."""
    from cohortcast.plans import base, bundles
    from __spark_entry__ import SMOKE_DIR
    made, panel = [], base.panel
    monkeypatch.setattr(base, "panel", lambda *a: made.append(a) or panel(*a))
    x = bundles.bundle_rows(spark, SMOKE_DIR)
    assert len(made) == 1 and x.count() == base.cohort(spark, SMOKE_DIR).count()
    for path in x.inputFiles():
        rows = [r["position"] for r in spark.read.parquet(path).select("position").collect()]
        assert sum(a != b for a, b in zip(rows, rows[1:])) < max(1, len(set(rows)))


def test_bundles_are_saved_and_loaded_side_by_side(spark, monkeypatch, tmp_path):
    import threading
    both = threading.Barrier(2, timeout=20)
    saved = {}

    class Slow:
        def __init__(self, name):
            self.name = name

        def save(self, path):
            both.wait()
            saved[path] = self.name

    def load(spark, path):
        both.wait()
        return saved[path]

    monkeypatch.setattr(bd.Bundle, "load", staticmethod(load))
    names = bd.save_bundles({n: Slow(n) for n in ("b", "a")}, str(tmp_path))
    assert names == ["a", "b"] and bd.load_bundles(spark, str(tmp_path), names) == {"a": "a", "b": "b"}
