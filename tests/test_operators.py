"""Matching, layouts, events, folds and exports on small rows with nulls, ties and duplicates."""

import json

import pytest
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators import evaluate, events, export, grouped, match, pages, panel, recipe, stats
from cohortcast.sources import layouts
from cohortcast.streaming.incremental import fill_missing


def rowset(df, *cols):
    rows = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def test_two_pass_match_keeps_rows(spark):
    left = spark.createDataFrame([
        (1, "joe smith", "ohio state"), (2, "michael jones jr", "texas"), (3, "nobody", "iowa"), (4, None, "utah"), (5, None, "utah")],
        "id INT, name STRING, school STRING")
    st = spark.createDataFrame([
        ("joe smith", "tiny college", 900, 1), ("joe smith", "ohio state", 100, 2), ("mike jones", "texas", 50, 3),
        ("mike jones", "texas", 70, 4), (None, "utah", 10, 5)], "name STRING, school STRING, yards INT, sid INT")
    out = match.two_pass_match(left, st, "id", "name", "school", ["yards", "sid"], [F.col("yards").desc(), F.col("sid").asc()])
    got = {r["id"]: (r["yards"], r["match_pass"]) for r in out.collect()}
    # the school known on the left beats the larger volume; nulls never match
    assert got == {1: (100, 1), 2: (70, 2), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_attach_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k STRING, v DOUBLE")
    assert rowset(grouped.center_in_group(df, ["k"], "v", "c"), "v", "c") == [(1.0, -1.0), (3.0, 1.0), (5.0, 0.0)]


def test_zscore_without_spread_only_centres(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 7.0), ("c", 1.0), ("c", 3.0)], "k STRING, v DOUBLE")
    got = rowset(grouped.zscore_in_group(df, ["k"], ["v"]), "k", "v_z")
    assert got[:3] == [("a", 0.0), ("a", 0.0), ("b", 0.0)] and got[3][1] == pytest.approx(-0.70710678)


def test_others_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", None), ("b", None)], "k STRING, v INT")
    assert sorted(rowset(grouped.others_total(df, ["k"], "v", "o"), "k", "v", "o"), key=str) == sorted(
        [("a", 1, 5), ("a", 5, 1), ("a", None, None), ("b", None, None)], key=str)


def test_choice_does_not_depend_on_partitioning(spark):
    rows = [(i % 7, i % 5, i) for i in range(200)]
    def run(n):
        df = spark.createDataFrame(rows, "k INT, v INT, id INT").repartition(n)
        return rowset(grouped.best_row(df, ["k"], [F.col("v").desc(), F.col("id").asc()]))
    assert run(1) == run(7)


def test_modal_value_ties_by_name(spark):
    df = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "b"), ("t", "a"), ("u", None)], "k STRING, v STRING")
    assert rowset(grouped.modal_value(df, ["k"], "v", "m")) == [("t", "a")]


def test_reattribution(spark):
    df = spark.createDataFrame([
        ("X", "Jeremiyah Love"), ("X", "Jeremiyah Love"), ("X", "James Love"), ("X", "#22 J.Love rushed to 38"), ("Y", "#22 J.Love rushed to 38"),
        ("X", "#1 ??? rushed"), ("X", "#5 Q. rushed")], "team STRING, who STRING")
    args = ("who", "team", presets.CORRUPTED_NAME, presets.CORRUPTED_INITIAL, presets.CORRUPTED_LAST)
    got = rowset(events.reattribute(df, *args), "team", "who")
    assert got.count(("X", "Jeremiyah Love")) == 3 and ("Y", "#22 J.Love rushed to 38") in got and len(got) == 7
    assert ("X", "#5 Q. rushed") not in rowset(events.reattribute(df, *args, drop_unparsed=True), "team", "who")


def test_in_play_margin(spark):
    df = spark.createDataFrame([(None,), (28,), (-28,), (29,)], "score_diff INT")
    assert rowset(events.in_play(df)) == [(-28,), (28,)]


def test_peer_flag_needs_another(spark):
    df = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("t", 3, True), ("u", 4, False)], "k STRING, id INT, e BOOLEAN")
    assert rowset(match.peer_flag(df, ["k"], "id", F.col("e"), "f"), "id", "f") == [(1, 0), (2, 1), (3, 0), (4, 0)]


def test_layouts(spark):
    a = spark.createDataFrame([(2020, "x"), (2021, "x")], "season INT, k STRING")
    b = spark.createDataFrame([(2021, "y", 1), (2022, "y", 2)], "season INT, k STRING, n INT")
    assert sorted(rowset(layouts.era_union(a, b, "season", 2021)), key=str) == [(2020, "x", None), (2021, "y", 1), (2022, "y", 2)]
    pref = layouts.prefer_sources([a, b.drop("n")], ["season"])
    assert rowset(pref) == [(2020, "x"), (2021, "x"), (2022, "y")]
    assert [f.dataType.simpleString() for f in layouts.conform(a, "k STRING, season BIGINT, extra DOUBLE").schema] == ["string", "bigint", "double"]
    with pytest.raises(layouts.DuplicateKeyError):
        layouts.assert_unique(spark.createDataFrame([(1,), (1,)], "k INT"), ["k"])
    n = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "k INT, n INT")
    assert rowset(layouts.deaggregate(n, "n", "i"), "k", "i") == [(1, 1), (1, 2)]


def test_incremental_computes_only_missing(spark, tmp_path):
    src = spark.createDataFrame([(2020, 1), (2020, 2), (2021, 3)], "season INT, v INT")
    seen = []
    def compute(df):
        seen.append(sorted(r[0] for r in df.select("season").distinct().collect()))
        return df.groupBy("season").agg(F.sum("v").alias("v"))
    fill_missing(src.where("season = 2020"), str(tmp_path / "t"), "season", compute)
    out = fill_missing(src, str(tmp_path / "t"), "season", compute)
    assert seen == [[2020], [2021]] and rowset(out) == [(2020, 3), (2021, 3)]


def test_page_entries(spark):
    new = "<strong>Bears: <a href='x'>Al Abe, QB, USC</a></strong><strong>noise: one</strong><strong>Jets: Bo Bee, WR, Miami, FL</strong>"
    old = "<b> Lions: Cy Coe, RB, LSU </b>"
    df = spark.createDataFrame([(1, new), (2, old), (3, None)], "page INT, html STRING")
    out = pages.labelled_entries(df, ["page"], "html", [r"(?s)<strong>([^<:]+):\s*(.+?)</strong>", r"<b>\s*([^<:]+?):\s*([^<]+?)\s*</b>"], ["name", "position", "school"])
    assert rowset(out, "page", "team", "name", "position", "school") == [
        (1, "Bears", "Al Abe", "QB", "USC"), (1, "Jets", "Bo Bee", "WR", "Miami, FL"), (2, "Lions", "Cy Coe", "RB", "LSU")]
    many = pages.number_in_order(out, "page", "pos", "at")
    assert rowset(many, "at", "name") == [(0, "Al Abe"), (1, "Bo Bee"), (2, "Cy Coe")]
    by_odd = pages.number_in_order(out.withColumn("odd", F.col("page") % 2), "page", "pos", "at", within=["odd"])
    assert rowset(by_odd, "page", "at") == [(1, 0), (1, 1), (2, 0)]


def test_page_files_round_trip(spark, tmp_path):
    from cohortcast.sources import layouts
    df = spark.createDataFrame([(2020, 1, "line one\nline two"), (2020, 2, "short"), (2021, 1, "é" * 12)], "year INT, no INT, html STRING")
    layouts.write_pages(df, str(tmp_path / "p"), ["year", "no"], "html")
    back = layouts.read_pages(spark, str(tmp_path / "p"), "year INT, no INT", shortest=10)
    assert [(r["page"], r["year"], r["no"], r["html"] and r["html"].strip()) for r in back.orderBy("year", "no").collect()] == [
        ("year=2020/no=1", 2020, 1, "line one\nline two"), ("year=2020/no=2", 2020, 2, None), ("year=2021/no=1", 2021, 1, "é" * 12)]


def test_clean_numbers(spark):
    from cohortcast.sources import layouts
    df = spark.createDataFrame([(1, float("nan"), 0.125), (2, 2.5, None)], "k INT, x DOUBLE, y DOUBLE")
    assert rowset(layouts.clean_numbers(df, 2), "k", "x", "y") == [(1, None, 0.12), (2, 2.5, None)]


def test_talking_points(spark):
    from cohortcast import talking_points as tp
    from cohortcast.operators import rules
    row = {"role": "receiver", "slot": 10, "round": 1, "rec_yards": 1250.7, "ypr": 11.96, "td_rate": None, "rush_yards": 2000.0, "ypc": None, "share": None,
           "back_rec_yards": None, "height_in": 75, "weight": 200, "forty": None, "stars": None, "tier": "G5", "p_made_it": 0.799, "bust_rate": 0.0, "comp_ppg": 7.0}
    quiet = {**{k: None for k in row}, "role": "back", "slot": 40, "round": 2}
    kinds = {"role": "STRING", "tier": "STRING", "slot": "INT", "round": "INT", "height_in": "INT", "weight": "INT", "stars": "INT"}
    df = spark.createDataFrame([tuple(r.values()) for r in (row, quiet)], ", ".join(f"{k} {kinds.get(k, 'DOUBLE')}" for k in row))

    def points(side):
        return rules.first_points(rules.fired_points(tp.CHAINS, side, "role"), rules.fired_points(tp.FALLBACKS, side, "role"), tp.LIMIT)

    loud, still = df.select("role", points(tp.FOR).alias("f"), points(tp.AGAINST).alias("a")).orderBy(F.desc("role")).collect()
    assert loud["f"] == ["One of the first 15 picks (round 1, #10)", "A 1250-yard final season, among the best", "Stands 75 in tall"]
    assert loud["a"] == ["Gains just 12.0 yards a catch", "Played against weaker teams", "The model gives only 80%"]
    assert still["f"] == ["A round 2 pick"] and still["a"] == ["Round 2 limits the chances"]


def test_folds_never_look_ahead(spark):
    df = spark.createDataFrame([(y, y % 2) for y in range(2010, 2020)], "year INT, y INT")
    f = evaluate.rolling_folds(df, "year", [2015, 2017])
    assert f.where("role = 'train' and year >= fold").count() == 0 and f.where("role = 'test' and year != fold").count() == 0
    e = evaluate.expanding_folds(df, "year", [2012], 3)
    assert rowset(e.groupBy("role").count()) == [("test", 3), ("train", 3)]
    assert evaluate.usable_folds(f, [], "y", 6, 1, 1).select("fold").collect()[0][0] == 2017


def test_interval_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.65, 0.6500001, 1.0, 1.1, None)], "x DOUBLE")
    assert [r[0] for r in df.select(evaluate.interval_label(F.col("x"), presets.CALIBRATION_BREAKS)).collect()] == [0, 0, 1, 6, None, None]


def test_combiner_grid_size_and_lofo(spark):
    assert len(evaluate.combiner_settings()) == 737
    rows = [("p", y, "a" if i % 2 else "b", 1.0, 0.0, 1.0, 10, float(e)) for i, (y, e) in enumerate([(1, 5), (1, 9), (2, 7), (2, 1)])]
    errors = spark.createDataFrame(rows, "position STRING, fold INT, transform STRING, alpha DOUBLE, beta DOUBLE, gamma DOUBLE, n BIGINT, err DOUBLE")
    got = rowset(evaluate.leave_one_fold_out(errors, ["position"], "fold"), "fold", "transform", "test_mae")
    assert got == [(1, "a", 0.9), (2, "b", 0.7)]


def test_lines_of_a_group_are_ordered(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 100 - i, None if i % 3 else 1.5) for i in range(25)] + [(2, 99, 1, 2.0)], "g INT, id INT, slot INT, v DOUBLE")
    export.write_documents(export.lines_per_group(df.repartition(5), "g", ["slot", "id"], ["id", "slot", "v"]), str(tmp_path / "d"), "g")
    lines = [json.loads(t) for f in sorted((tmp_path / "d" / "g=1").glob("part-*")) for t in f.read_text().splitlines()]
    assert [x["slot"] for x in lines] == sorted(100 - i for i in range(25))
    assert lines[0] == {"id": 24, "slot": 76, "v": 1.5} and lines[1]["v"] is None


def test_comp_document_shape(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id INT")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id INT, rank INT, name STRING")
    got = {r["id"]: json.loads(r["document"]) for r in export.documents_with_children(parents, kids, "id", "rank", ["name"]).collect()}
    assert got[1] == {"id": 1, "children": [{"rank": 1, "name": "a"}, {"rank": 2, "name": "b"}]} and got[2]["children"] == []


def test_value_curve_matches_least_squares(spark):
    import numpy as np
    rows = [(s, float(60 / (s + 3))) for s in range(1, 40) for _ in range(s % 3 + 1)]
    df = spark.createDataFrame(rows, "slot INT, av DOUBLE")
    x = np.array([r[0] for r in rows], float)
    b = np.polyfit(x, np.log(np.array([r[1] for r in rows]) + 1), 2)
    got = {r["slot"]: r for r in panel.value_curve(df, "slot", "av", 50).collect()}
    assert got[1]["worth"] == pytest.approx(100) and got[7]["log_pred"] == pytest.approx(np.polyval(b, 7), abs=1e-6)


def test_past_covariance_is_pairwise_and_past(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [("p", 2000 + i % 4, *[None if rng.random() < 0.2 else float(v) for v in rng.normal(size=2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "k STRING, y INT, a DOUBLE, b DOUBLE")
    got = {(r["cohort"], r["i"], r["j"]): r["cov"] for r in stats.past_covariance(df, ["k"], "y", ["a", "b"]).collect()}
    past = [(r[2], r[3]) for r in rows if r[1] < 2002 and r[2] is not None and r[3] is not None]
    assert got[(2002, 0, 1)] == pytest.approx(np.cov(np.array(past).T)[0, 1]) and got[(2000, 0, 0)] is None


def test_recipe_edges(spark):
    df = spark.createDataFrame([(1, 0, "en", 4.0), (2, 1, None, None), (3, None, "xx", 2.0)], "id INT, has_f INT, lang STRING, f DOUBLE")
    assert rowset(recipe.zero_fill(df, {"has_f": ["f"], "gone": ["f"]}), "id", "f")[0] == (1, 0.0)
    assert rowset(recipe.one_hot(df, "lang", ["en"]), "id", "lang_en", "lang_unknown") == [(1, 1, 0), (2, 0, 1), (3, 0, 1)]
    assert rowset(recipe.impute(df, recipe.learn_medians(df, ["f"]), ["f"]), "id", "f")[1] == (2, 3.0)
    const = spark.createDataFrame([(1.0,)] * 30, "c DOUBLE")
    assert recipe.near_zero_variance(const, ["c"]).first()["near_zero"]


def test_nearest_texts_against_all_pairs(spark):
    import random
    from cohortcast.operators import match
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12))) for _ in range(400)}) + ["a", "é", "abab", "aaaa", "aaa"]
    asks = ["abcde", "", "zzzz", "aaaaa", "a", "dead bee", "zz", "abababab"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = match.nearest_texts(spark.createDataFrame([(a,) for a in asks + [None]], "q STRING"), spark.createDataFrame([(t,) for t in texts + texts[:9] + [None]], "t STRING"), "q", "t", 4)
    want = {a: sorted((distance(a, t), t) for t in set(texts))[:4] for a in asks}
    rows = {}
    for r in got.collect():
        rows.setdefault(r["ask"], []).append((r["dist"], r["text"]))
    assert {a: sorted(v) for a, v in rows.items()} == want


def test_key_choice_follows_the_profile(spark):
    from cohortcast.operators import match
    left = spark.createDataFrame([(i, f"s{i}" if i % 4 else None, f"name {i}" + (" jr" if i == 5 else "")) for i in range(40)], "id INT, score STRING, name STRING")
    stats = lambda has, same: spark.createDataFrame([(f"s{i}" if i < has else None, f"name {i}" if i < same else f"other {i}", i) for i in range(40)], "score STRING, name STRING, v INT")
    run = lambda s: {r["id"]: (r["match_key"], r["v"]) for r in match.auto_key_match(left, s, "id", ["score", "name"], "name", ["v"], [F.col("v").asc()]).collect()}
    by_score = run(stats(40, 0))
    assert by_score == {i: ("score", i) if i % 4 else (None, None) for i in range(40)}
    by_name = run(stats(5, 40))
    assert by_name == {i: ("name", i) if i != 5 else ("name_stripped", 5) for i in range(40)}
    assert run(stats(40, 40).drop("score"))[7] == ("name", 7)
    profile = {r["candidate"]: r for r in match.key_profile(left, stats(5, 40), ["score", "name"]).collect()}
    assert (profile["score"]["in_left"], profile["score"]["in_right"], profile["score"]["shared"], profile["name"]["shared"]) == (30, 5, 3, 39)
