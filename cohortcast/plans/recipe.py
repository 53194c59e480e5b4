"""Recipe families on labelled documents."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators import recipe as rc
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.sources.tables import load

DOCS_SQL = """
    SELECT d.doc_id, CAST(2000 + d.doc_id % 24 AS INTEGER) AS year, lang, source, l.quality,
           CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS n_words,
           CASE WHEN d.doc_id % 4 <> 0 THEN CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) END AS n_stops,
           CAST(length(text) - length(replace(text, '\n', '')) AS DOUBLE) AS n_lines,
           CASE WHEN d.doc_id % 100 = 7 THEN 1.0 ELSE 0.0 END AS rare,
           CASE WHEN d.doc_id % 24 >= 8 THEN 1 ELSE 0 END AS has_stops, CASE WHEN d.doc_id % 24 >= 4 THEN 1 ELSE 0 END AS has_lines
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""".replace("\\n", "' || chr(10) || '")


def docs(spark, d):
    """Labelled documents with numeric text features; whole texts, counted in the JVM."""
    t, k = F.col("text"), F.col("doc_id")

    def count_of(ch):
        return (F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("double")

    rows = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select(
        "doc_id", (2000 + k % 24).cast("int").alias("year"), "lang", "source", "quality",
        F.col("n_chars").cast("double").alias("n_chars"), (count_of(" ") + 1).alias("n_words"),
        F.when(k % 4 != 0, count_of(".")).alias("n_stops"), count_of("\n").alias("n_lines"),
        F.when(k % 100 == 7, 1.0).otherwise(0.0).alias("rare"),
        (k % 24 >= 8).cast("int").alias("has_stops"), (k % 24 >= 4).cast("int").alias("has_lines"))


@query("era_zero_fill", f"""
    SELECT doc_id, CASE WHEN has_stops = 0 THEN 0 ELSE n_stops END AS n_stops, CASE WHEN has_lines = 0 THEN 0 ELSE n_lines END AS n_lines FROM ({DOCS_SQL})""")
def era_zero_fill(spark, d):
    out = rc.zero_fill(docs(spark, d), {"has_stops": ["n_stops"], "has_lines": ["n_lines"], "has_other": ["absent"]})
    return out.select("doc_id", "n_stops", "n_lines")


@query("one_hot", f"""
    SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS lang_en, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS lang_fr,
           CASE WHEN lang IN ('en', 'fr') THEN 0 ELSE 1 END AS lang_unknown FROM ({DOCS_SQL})""")
def one_hot(spark, d):
    return rc.one_hot(docs(spark, d).select("doc_id", "lang"), "lang", ["en", "fr"]).drop("lang")


@query("median_impute", f"""
    WITH x AS (SELECT * FROM ({DOCS_SQL})), m AS (SELECT median(n_stops) AS med FROM x WHERE year < 2016)
    SELECT doc_id, round(coalesce(n_stops, med), 6) AS n_stops FROM x, m WHERE year >= 2016""")
def median_impute(spark, d):
    x = docs(spark, d)
    med = rc.learn_medians(x.where("year < 2016"), ["n_stops", "n_lines"])
    return rc.impute(x.where("year >= 2016"), med, ["n_stops", "n_lines"]).select("doc_id", r6(F.col("n_stops")).alias("n_stops"))


NZV = ("n_chars", "n_words", "n_stops", "n_lines", "rare")


@query("near_zero_var", f"""
    WITH x AS (SELECT * FROM ({DOCS_SQL})), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v FROM x WHERE {c} IS NOT NULL" for c in NZV)}),
    c AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS rk FROM (SELECT feature, v, count(*) AS n FROM l GROUP BY feature, v)),
    f AS (SELECT feature, count(*) AS n_unique, sum(n) AS n_rows, max(CASE WHEN rk = 1 THEN n END) AS n1, max(CASE WHEN rk = 2 THEN n END) AS n2 FROM c GROUP BY 1),
    g AS (SELECT feature, n_unique, coalesce(CAST(n1 AS DOUBLE) / n2, 0) AS fr, 100.0 * n_unique / n_rows AS pu FROM f)
    SELECT feature, n_unique, round(fr, 6) AS freq_ratio, round(pu, 6) AS pct_unique, n_unique = 1 OR (fr > 19 AND pu <= 10) AS near_zero FROM g""")
def near_zero_var(spark, d):
    out = rc.near_zero_variance(docs(spark, d), NZV)
    return out.withColumns({"freq_ratio": r6(F.col("freq_ratio")), "pct_unique": r6(F.col("pct_unique"))})


@query("case_weights", f"""
    WITH x AS (SELECT * FROM ({DOCS_SQL}))
    SELECT doc_id, CAST(CASE WHEN year < 2010 THEN 0.4 ELSE 1 END AS DOUBLE) AS era_weight,
           round(CASE WHEN quality = 1 THEN (SELECT CAST(sum(1 - quality) AS DOUBLE) / sum(quality) FROM x) ELSE 1 END, 6) AS class_weight FROM x""")
def case_weights(spark, d):
    x = docs(spark, d).select("doc_id", "year", "quality")
    out = rc.class_balance(x, "quality", "class_weight")
    return out.select("doc_id", rc.era_weight(F.col("year"), presets.EARLY_ERA_BEFORE, presets.EARLY_ERA_WEIGHT).alias("era_weight"),
                      r6(F.col("class_weight")).alias("class_weight"))
