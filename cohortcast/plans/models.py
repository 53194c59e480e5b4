"""Model families. Predictions depend on the tree library, so rows, not values, are compared."""

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.functions import scores as sc
from cohortcast.operators import evaluate as ev
from cohortcast.operators import models as md
from cohortcast.operators import recipe as rc
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.blends import role
from cohortcast.plans.recipe import docs
from cohortcast.plans.registry import query
from cohortcast.session import materialize, scratch_path

DOC_FEATURES = ["n_chars", "n_words", "n_stops", "n_lines", "lang_en", "lang_fr", "lang_unknown"]
FAST = md.Trees(rounds=5, depth=3)


def doc_rows(spark, d):
    """Labelled documents through the whole recipe: zero fill, one-hot, imputation, weights."""
    x = rc.one_hot(rc.zero_fill(docs(spark, d), {"has_stops": ["n_stops"], "has_lines": ["n_lines"]}), "lang", ["en", "fr"])
    x = rc.impute(x, rc.learn_medians(x.where("year < 2020"), ["n_stops", "n_lines"]), ["n_stops", "n_lines"])
    x = rc.class_balance(x, "quality", "class_weight").withColumn(
        "w", F.col("class_weight") * rc.era_weight(F.col("year"), presets.EARLY_ERA_BEFORE, presets.EARLY_ERA_WEIGHT))
    return materialize(x.select("doc_id", "year", "quality", "w", *DOC_FEATURES), "doc-rows")


COHORT_FEATURES = ["log_slot", "age", "rating", "yards_final", "ypr", "games_final", "forty", "weight", "has_final"]


def cohort_rows(spark, d):
    """Cohort members with imputed features, outcome, bucket and log outcome."""
    o, f = base.outcome_and_features(spark, d)
    f = f.join(o.select("entity_id", "made_it", "ppg"), "entity_id").select(
        "entity_id", "name", "position", "cohort_year", "slot", "made_it", "ppg", F.log("slot").alias("log_slot"), "age", "rating",
        F.coalesce("yards_final", F.lit(0.0)).alias("yards_final"), F.coalesce("ypr", F.lit(0.0)).alias("ypr"),
        F.coalesce("games_final", F.lit(0)).cast("double").alias("games_final"), "forty", F.col("weight").cast("double").alias("weight"),
        F.col("yards_final").isNotNull().cast("double").alias("has_final"),
        F.when(F.col("ppg") > 0, F.log("ppg")).alias("log_ppg"))
    f = f.withColumn("role", role()).withColumn("bucket", sc.assign_bucket(F.col("ppg"), F.col("role")))
    f = materialize(f, "cohort-raw")
    med = rc.learn_medians(f.where("cohort_year < 2000"), ["forty", "weight"])
    return materialize(rc.impute(f, med, ["forty", "weight"]), "cohort-rows")


MIN_TRAIN_ROWS = 20


def test_years(x) -> list[int]:
    """Classes with enough earlier rows to fit on, in order; one row per class year reaches the driver."""
    per_year = sorted((r["cohort_year"], r["count"]) for r in x.groupBy("cohort_year").count().collect())
    seen, out = 0, []
    for year, n in per_year:
        if seen >= MIN_TRAIN_ROWS:
            out.append(year)
        seen += n
    return out


@query("gbt_classify")
def gbt_classify(spark, d):
    x = doc_rows(spark, d)
    model = md.fit_classifier(x.where("year < 2018"), DOC_FEATURES, "quality", "w", FAST)
    path = scratch_path(spark, "model")
    md.save_model(model, path)
    scored = md.probability_of(PipelineModel.load(path), x.where("year >= 2018"), "p_made_it")
    return scored.select("doc_id", "year", "quality", r6(F.col("p_made_it")).alias("p_made_it"))


@query("gbt_regress")
def gbt_regress(spark, d):
    x = cohort_rows(spark, d)

    def fit_predict(train, test):
        model = md.fit_regressor(train.where("made_it = 1"), COHORT_FEATURES, "log_ppg", None, FAST)
        return md.prediction_of(model, test, "prod_pred", log_scale=True)

    return md.cross_validate(x, "cohort_year", test_years(x.where("made_it = 1")), fit_predict, threads=4).select(
        "entity_id", "position", "fold", "ppg", r6(F.col("prod_pred")).alias("prod_pred"))


@query("quantile_boost")
def quantile_boost(spark, d):
    """Upper quantile of the outcome by tree leaf, for every class from the ones before it."""
    x = cohort_rows(spark, d).where("made_it = 1")

    def fit_predict(train, test):
        return md.fit_leaf_quantiles(train, COHORT_FEATURES, "log_ppg", {"log_q70": 0.7}).predict(test)

    out = md.cross_validate(x, "cohort_year", test_years(x), fit_predict, threads=4)
    return out.select("entity_id", "position", "fold", "ppg", r6(F.exp("log_q70")).alias("q70"))


@query("tune_time_folds")
def tune_time_folds(spark, d):
    x = doc_rows(spark, d)
    evaluator = BinaryClassificationEvaluator(labelCol="quality", rawPredictionCol="rawPrediction")

    def auc(train, test, trees):
        return evaluator.evaluate(md.fit_classifier(train, DOC_FEATURES, "quality", "w", trees).transform(test))

    grid = [md.Trees(rounds=3, depth=2), md.Trees(rounds=3, depth=3)]
    found = md.tune(x, "year", [2012, 2017], presets.FOLD_HORIZON, grid, auc)
    table = spark.createDataFrame([(s.rounds, s.depth, v, n) for s, v, n in found], "rounds INT, depth INT, auc DOUBLE, n_folds INT")
    return table.withColumn("best", (F.col("auc") == max(v for _, v, _ in found)).cast("int"))


ISOTONIC_SQL = """
    WITH t AS (SELECT p_made_it AS x, avg(CAST(made_it AS DOUBLE)) AS y, CAST(count(*) AS DOUBLE) AS w FROM oos
               WHERE test_year < 1999 AND p_made_it IS NOT NULL GROUP BY 1),
    c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, y * w AS yw, w, sum(y * w) OVER (ORDER BY x) AS sy, sum(w) OVER (ORDER BY x) AS sw FROM t),
    low AS (SELECT a.i AS a, b.i AS b, min((b.sy - a.sy + a.yw) / (b.sw - a.sw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m
            FROM c a JOIN c b ON b.i >= a.i),
    f AS (SELECT c.x, max(low.m) AS y FROM c JOIN low ON low.b = c.i GROUP BY c.x),
    q AS (SELECT entity_id, position, test_year, p_made_it AS p,
                 (SELECT max(x) FROM f WHERE x <= p_made_it) AS x0, (SELECT min(x) FROM f WHERE x >= p_made_it) AS x1 FROM oos WHERE test_year >= 1999)
    SELECT entity_id, position, round(p, 6) AS p_made_it, round(CASE WHEN p IS NULL THEN NULL WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL OR x0 = x1 THEN a.y
             ELSE a.y + (b.y - a.y) * (p - x0) / (x1 - x0) END, 6) AS p_iso
    FROM q LEFT JOIN f a ON a.x = q.x0 LEFT JOIN f b ON b.x = q.x1"""


@query("isotonic_calibrate", ISOTONIC_SQL)
def isotonic_calibrate(spark, d):
    o = materialize(base.oos(spark, d).select("entity_id", "position", "test_year", "made_it", "p_made_it"), "isotonic")
    model = md.fit_isotonic(o.where("test_year < 1999"), "p_made_it", "made_it")
    return md.apply_isotonic(model, o.where("test_year >= 1999"), "p_made_it", "p_iso").select(
        "entity_id", "position", r6(F.col("p_made_it")).alias("p_made_it"), r6(F.col("p_iso")).alias("p_iso"))


@query("bucket_multiclass")
def bucket_multiclass(spark, d):
    x = cohort_rows(spark, d).where("bucket IS NOT NULL")

    def fit_predict(train, test):
        model = md.fit_buckets(train, COHORT_FEATURES, "bucket", trees=10)
        return md.bucket_probabilities(model, test, "p", 5).select("entity_id", F.posexplode("p").alias("bucket", "p"))

    return md.cross_validate(x, "cohort_year", test_years(x), fit_predict, threads=4).withColumn("p", r6(F.col("p")))


LEAN = ["log_slot", "age", "rating", "forty", "weight"]


def lean_rows(spark, d):
    """Rows of the ordinal model: the positions that have bucket cuts."""
    return cohort_rows(spark, d).where("bucket IS NOT NULL")


def scaled(train, test):
    """Both sides of a fold with the lean features in units of its training rows; one without spread there says nothing."""
    from cohortcast.operators.stats import standardize_with
    columns = ["entity_id", "position", "cohort_year", "ppg", "bucket", *[F.coalesce(f"{c}_std", F.lit(0.0)).alias(c) for c in LEAN]]
    return tuple(standardize_with(side, train, LEAN).select(*columns) for side in (train, test))


@query("ordinal_logit")
def ordinal_logit(spark, d):
    x = lean_rows(spark, d)

    def fit_predict(train, test):
        train, test = scaled(train, test)
        m = md.fit_ordinal(train, LEAN, "bucket", 5)
        return test.select("entity_id", F.posexplode(m.probabilities()).alias("bucket", "p"))

    return md.cross_validate(x, "cohort_year", test_years(x), fit_predict, threads=4).withColumn("p", r6(F.col("p")))


REPLICATES = 30


@query("bootstrap_intervals")
def bootstrap_intervals(spark, d):
    """Intervals of the latest class from refits on Poisson-weighted rows of the earlier ones."""
    x = lean_rows(spark, d)
    last = test_years(x)[-1]
    train, test = scaled(x.where(F.col("cohort_year") < last), x.where(F.col("cohort_year") == last))
    ms = md.fit_bootstrap(materialize(train, "bootstrap"), "entity_id", LEAN, "bucket", 5, replicates=REPLICATES, iterations=10)
    rows = test.select("entity_id", F.explode(md.intervals(ms, 5)).alias("b")).select("entity_id", "b.*")
    return rows.withColumns({c: r6(F.col(c)) for c in ("p", "p_lo", "p_hi")})


@query("importance")
def importance(spark, d):
    x = doc_rows(spark, d)
    model = md.fit_classifier(x, DOC_FEATURES, "quality", "w", md.Trees(rounds=3))
    return md.importance_table(spark, model, DOC_FEATURES)


def hurdle_cv(x, features, trees=md.Trees(rounds=3), calibrate=False):
    """Rolling hurdle estimate: probability of making it times the back-transformed log outcome.

    With `calibrate` the probability first goes through a map learned from earlier classes' out-of-sample ones.
    """
    def fit_predict(train, test):
        p = md.fit_classifier(train, features, "made_it", None, trees)
        v = md.fit_regressor(train.where("made_it = 1"), features, "log_ppg", None, trees)
        scored = md.prediction_of(v, md.probability_of(p, test, "p_made_it"), "prod_pred", log_scale=True)
        return scored.select("entity_id", "position", "cohort_year", "made_it", "ppg", "p_made_it", "prod_pred")
    years = test_years(x.where("made_it = 1"))
    scored = md.cross_validate(x, "cohort_year", years, fit_predict, threads=4)
    scored = md.calibrate_forward(scored, "fold", years, "p_made_it", "made_it", "p_iso") if calibrate else scored.withColumn("p_iso", F.col("p_made_it"))
    return scored.withColumn("exp_ppg", F.greatest(F.col("p_iso") * F.col("prod_pred"), F.lit(0.0)))


def metrics(oos):
    out = ev.error_table(oos, "position", ev.error_aggregates("ppg", "exp_ppg", "p_made_it", "made_it"))
    return out.withColumns({c: r6(F.col(c)) for c in ("mae", "rmse", "cor", "bias", "accuracy", "brier")})


@query("temporal_cv")
def temporal_cv(spark, d):
    return metrics(hurdle_cv(cohort_rows(spark, d), COHORT_FEATURES, calibrate=True))


@query("ablation_delta")
def ablation_delta(spark, d):
    """Error with a feature group left out, next to the error with all features."""
    x = cohort_rows(spark, d)
    variants = {"all": COHORT_FEATURES, "no_production": [f for f in COHORT_FEATURES if f not in ("yards_final", "ypr", "games_final")]}
    runs = None
    for name, feats in variants.items():
        run = hurdle_cv(x, feats).withColumn("variant", F.lit(name))
        runs = run if runs is None else runs.unionByName(run)
    err = F.abs(F.col("exp_ppg") - F.col("ppg"))
    wide = runs.groupBy("position").pivot("variant", list(variants)).agg(F.avg(err))
    return wide.select("position", r6(F.col("all")).alias("mae_all"), r6(F.col("no_production")).alias("mae_without"),
                       r6(F.col("no_production") - F.col("all")).alias("delta"))


@query("cv_param_sweep")
def cv_param_sweep(spark, d):
    """Training start year as a swept parameter."""
    x = cohort_rows(spark, d)
    rows = None
    for start in (1996, 1998):
        run = metrics(hurdle_cv(x.where(F.col("cohort_year") >= start), COHORT_FEATURES)).withColumn("start_year", F.lit(start))
        rows = run if rows is None else rows.unionByName(run)
    return rows.where("position = 'ALL'").select("start_year", "n", "mae", "rmse", "cor", "bias")


TAUS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)


@query("tau_sweep")
def tau_sweep(spark, d):
    """Pinball loss, error, bias and correlation of the leaf quantiles over all classes, per quantile level."""
    x = cohort_rows(spark, d).where("made_it = 1")
    names = {f"q{i}": tau for i, tau in enumerate(TAUS)}

    def fit_predict(train, test):
        return md.fit_leaf_quantiles(train, COHORT_FEATURES, "log_ppg", names, depth=2).predict(test)

    scored = md.cross_validate(x, "cohort_year", test_years(x), fit_predict, threads=4)
    long = scored.select("log_ppg", "ppg", F.explode(F.array(*[
        F.struct(F.lit(tau).alias("tau"), F.col(n).alias("q")) for n, tau in names.items()])).alias("s")).select("log_ppg", "ppg", "s.*")
    miss = F.exp("q") - F.col("ppg")
    out = long.groupBy("tau").agg(
        F.count("*").alias("n"), F.avg(ev.pinball(F.col("log_ppg"), F.col("q"), F.col("tau"))).alias("pinball"),
        F.avg((F.col("log_ppg") <= F.col("q")).cast("double")).alias("covered"), F.avg(F.abs(miss)).alias("mae"), F.avg(miss).alias("bias"),
        F.corr(F.exp("q"), F.col("ppg")).alias("cor"))
    return out.withColumns({c: r6(F.col(c)) for c in ("pinball", "covered", "mae", "bias", "cor")})


GRID_WEIGHTS = ((1.5, 1.0), (1.0, 1.0), (1.0, 1.5), (2.0, 0.5))  # production, measurables
GRID_WINDOWS = (20, 40, 80)
GRID_K = (4, 8, 12)
GRID_BANDWIDTHS = (0.5, 1.0, 2.0)


def grid_search_sql():
    """Partial forms per category once, then every weight vector and window as a re-ranking of the pairs."""
    k = max(GRID_K)
    cells = ", ".join(f"({p}::DOUBLE, {m}::DOUBLE, {w})" for p, m in GRID_WEIGHTS for w in GRID_WINDOWS)
    return f"""
    WITH parts AS (
      SELECT a.entity_id, a.comp_id, a.comp_ppg, a.gap,
             (CASE WHEN d0 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d1 IS NULL THEN 0 ELSE 0.5 END) AS f1,
             greatest(0, coalesce(a00 * d0 * d0, 0) + coalesce(2 * a01 * d0 * d1, 0) + coalesce(a11 * d1 * d1, 0)) AS q1,
             (CASE WHEN d2 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d3 IS NULL THEN 0 ELSE 0.5 END) AS f2,
             greatest(0, coalesce(b00 * d2 * d2, 0) + coalesce(2 * b01 * d2 * d3, 0) + coalesce(b11 * d3 * d3, 0)) AS q2,
             row_number() OVER (PARTITION BY a.entity_id ORDER BY gap, comp_id) AS gap_rk
      FROM all_pairs a JOIN comp_inv v ON v.position = a.position AND v.cohort = a.cohort_year),
    cells(p, m, w) AS (VALUES {cells}),
    counted AS (SELECT *, count(*) FILTER (WHERE gap <= w) OVER (PARTITION BY entity_id, w, p, m) AS n_in FROM parts, cells),
    ranked AS (SELECT p, m, w, entity_id, comp_ppg, distance, row_number() OVER (PARTITION BY p, m, w, entity_id ORDER BY distance, comp_id) AS rk FROM (
      SELECT *, round(coalesce(sqrt((p * f1 * q1 + m * f2 * q2) / nullif(p * f1 + m * f2, 0)), CAST('inf' AS DOUBLE)), 9) AS distance FROM counted)
      WHERE CASE WHEN n_in >= {k} THEN gap <= w ELSE gap_rk <= {3 * k} END),
    est AS (SELECT p, m, w, k, bw, entity_id, sum(exp(-distance / bw) * comp_ppg) / nullif(sum(exp(-distance / bw)), 0) AS est
      FROM ranked, (VALUES {", ".join(f"({n})" for n in GRID_K)}) ks(k), (VALUES {", ".join(f"({b}::DOUBLE)" for b in GRID_BANDWIDTHS)}) bs(bw) WHERE rk <= k GROUP BY ALL),
    errors AS (SELECT p AS w_production, m AS w_measurables, CAST(w AS INTEGER) AS slot_window, CAST(k AS INTEGER) AS k, bw AS bandwidth, count(*) AS n,
      sqrt(avg(pow(est - o.ppg, 2))) AS rmse FROM est JOIN comp_base o ON o.entity_id = est.entity_id WHERE est IS NOT NULL GROUP BY ALL)
    SELECT w_production, w_measurables, slot_window, k, bandwidth, n, round(rmse, 6) AS rmse FROM errors"""


@query("comp_grid_search", grid_search_sql())
def comp_grid_search(spark, d):
    """Error of the comparables of every class under category weights, slot windows, numbers of neighbours and bandwidths.

    One search serves all: a query asks once per weight vector and window, keeps the largest number of neighbours, and
    smaller numbers and the bandwidths are prefixes and reweightings of its result.
    """
    from cohortcast.operators import comps as cp
    from cohortcast.plans.comps import MAHAL, comp_base
    b = comp_base(spark, d)
    variants = F.array(*[F.struct(F.array(F.lit(p), F.lit(m)).alias("weights"), F.lit(w).alias("window")) for p, m in GRID_WEIGHTS for w in GRID_WINDOWS])
    spec = cp.CompSpec(MAHAL.categories, k=max(GRID_K))
    found = cp.nearest_comps(b, b, spec, ["comp_ppg"], variants=variants, beside=["ppg"])
    errors = cp.comp_errors(found, "ppg", "comp_ppg", [(k, bw) for k in GRID_K for bw in GRID_BANDWIDTHS])
    errors = errors.withColumn("variant", F.get(variants, F.col("variant")))
    return errors.select(F.col("variant.weights")[0].alias("w_production"), F.col("variant.weights")[1].alias("w_measurables"),
                         F.col("variant.window").alias("slot_window"), "k", "bandwidth", "n", r6(F.col("rmse")).alias("rmse"))


@query("score_cohort")
def score_cohort(spark, d):
    """Flagship: attach features and comparables, and score every class with models of the classes before it.

    The combined probability uses a map learned from earlier classes' out-of-sample scores.
    """
    from cohortcast.operators import comps as cp
    from cohortcast.plans.comps import EUCLID
    x = cohort_rows(spark, d).withColumn("comp_ppg", F.col("ppg"))
    years = test_years(x.where("bucket IS NOT NULL"))

    def fit_predict(train, test):
        p = md.fit_classifier(train, COHORT_FEATURES, "made_it", None, FAST)
        v = md.fit_regressor(train.where("made_it = 1"), COHORT_FEATURES, "log_ppg", None, FAST)
        b = md.fit_buckets(train.where("bucket IS NOT NULL"), COHORT_FEATURES, "bucket", trees=10)
        scored = md.prediction_of(v, md.probability_of(p, test, "p_made_it"), "log_pred")
        return md.bucket_probabilities(b, scored, "probs", 5)

    scored = md.cross_validate(x, "cohort_year", years, fit_predict, threads=4)
    s = md.calibrate_forward(scored, "fold", years, "p_made_it", "made_it", "p_iso")
    params = cp.search_params(x, cp.cohort_years(x, "cohort_year"), EUCLID)
    found = cp.nearest_comps(x, x, EUCLID, ["comp_ppg"], params)
    comp = cp.comp_features(x, found, params, EUCLID, "comp_ppg").select("entity_id", "comp_weighted_ppg", "comp_bust_rate", "n_pool_used")
    s = s.join(comp, "entity_id", "left")
    s = s.withColumn("p_eff", sc.deployed_combiner(F.col("role"), F.col("p_made_it"), F.col("p_iso")))
    s = s.withColumns({"exp_ppg": sc.hurdle(F.col("p_eff"), F.col("log_pred")),
                       "exp_ppg_bucket": sc.expectation(F.col("probs"), sc.midpoints_of(F.col("role")))})
    s = s.withColumn("model_ppg", sc.blend(F.col("role"), F.col("exp_ppg"), F.col("exp_ppg_bucket"), presets.HURDLE_WEIGHT))
    s = s.withColumn("final_ppg", sc.blend(F.col("role"), F.col("model_ppg"), F.col("comp_weighted_ppg"), presets.MODEL_WEIGHT))
    return s.select("entity_id", "name", "position", "cohort_year", "slot", *[r6(F.col(c)).alias(c) for c in (
        "p_made_it", "p_eff", "exp_ppg", "exp_ppg_bucket", "comp_weighted_ppg", "comp_bust_rate", "final_ppg")], "n_pool_used")
