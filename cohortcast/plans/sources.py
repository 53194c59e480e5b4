"""Scans, layouts and sinks."""

from pyspark.sql import functions as F

from cohortcast.operators.grouped import best_row
from cohortcast.plans import base
from cohortcast.plans.registry import query
from cohortcast.session import scratch_path
from cohortcast.sources import layouts
from cohortcast.sources.tables import load
from cohortcast.streaming.incremental import fill_missing

ORDER_YEARS = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders {where} GROUP BY 1"""


def yearly(df):
    return df.groupBy("season").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def orders_by_season(spark, d):
    return load(spark, d, "orders").withColumn("season", F.year("o_orderdate"))


@query("scan_star", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 45 AND 50
      AND year(l_shipdate) IN (1997, 1998)""")
def scan_star(spark, d):
    li = load(spark, d, "lineitem")
    ship = F.col("l_shipdate")
    start, end = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    return li.where(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(45, 50)
                    & (ship >= start) & (ship < end)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query("scan_partitioned", ORDER_YEARS.format(where="WHERE year(o_orderdate) IN (1996, 1999)"))
def scan_partitioned(spark, d):
    path = scratch_path(spark, "orders-by-season")
    orders_by_season(spark, d).write.partitionBy("season").parquet(path)
    return yearly(spark.read.parquet(path).where(F.col("season").isin(1996, 1999)))


@query("incremental_missing_partitions", ORDER_YEARS.format(where=""))
def incremental_missing_partitions(spark, d):
    path = scratch_path(spark, "yearly")
    src = orders_by_season(spark, d)
    fill_missing(src.where("season < 1998"), path, "season", yearly)
    return fill_missing(src, path, "season", yearly)


@query("csv_roundtrip", """
    SELECT o_orderkey AS order_id, o_orderpriority AS priority, o_totalprice AS price
    FROM orders""")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    layouts.write_csv(load(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price")), path)
    return layouts.read_csv(spark, path, "order_id BIGINT, priority STRING, price DOUBLE")


@query("json_docs_read", """
    SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(l_linenumber AS INTEGER) AS line, l_quantity AS qty
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def json_docs_read(spark, d):
    path = scratch_path(spark, "json")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    li = load(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    docs = (orders.join(li, F.col("order_id") == F.col("l_orderkey"))
            .groupBy("order_id").agg(F.collect_list(F.struct("line", "qty")).alias("lines")))
    docs.write.json(path)
    return layouts.read_documents(
        spark, path, "order_id BIGINT, lines ARRAY<STRUCT<line: INT, qty: DOUBLE>>", "lines")


@query("source_priority", """
    WITH src AS (
      SELECT o_custkey AS entity_id, o_totalprice AS price, 0 AS pr FROM orders WHERE year(o_orderdate) = 2001
      UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders WHERE year(o_orderdate) = 2000
      UNION ALL SELECT o_custkey, o_totalprice, 2 FROM orders WHERE year(o_orderdate) < 2000)
    SELECT entity_id, count(*) AS n, round(sum(price), 2) AS price
    FROM (SELECT *, min(pr) OVER (PARTITION BY entity_id) AS best FROM src) WHERE pr = best GROUP BY entity_id""")
def source_priority(spark, d):
    o = orders_by_season(spark, d).select(F.col("o_custkey").alias("entity_id"), "season", F.col("o_totalprice").alias("price"))
    chain = [o.where("season = 2001"), o.where("season = 2000"), o.where("season < 2000")]
    best = layouts.prefer_sources(chain, ["entity_id"])
    return best.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("era_union", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey AS order_id,
           CASE WHEN year(o_orderdate) >= 1999 THEN o_orderpriority END AS priority
    FROM orders""")
def era_union(spark, d):
    o = orders_by_season(spark, d).select("season", F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))
    return layouts.era_union(o.drop("priority"), o, "season", 1999).select("season", "order_id", "priority")


@query("team_games", """
    SELECT team, season, count(*) AS games, count(*) AS games_again
    FROM (SELECT DISTINCT team, season, game FROM plays) GROUP BY team, season""")
def team_games(spark, d):
    per_game = base.plays(spark, d).select("team", "season", "game").distinct()
    counted = layouts.team_games(per_game, ["team", "season"], "games")
    again = layouts.team_games(counted, ["team", "season"], "games").withColumnRenamed("games", "games_again")
    return counted.join(again, ["team", "season"])


@query("deaggregate", """
    SELECT entity_id, season, CAST(i AS INTEGER) AS game_no FROM panel, unnest(range(1, games + 1)) AS t(i)""")
def deaggregate(spark, d):
    return layouts.deaggregate(base.panel(spark, d).select("entity_id", "season", "games"), "games", "game_no").drop("games")


@query("optional_lookup", """
    SELECT entity_id, n_name AS nation, CASE WHEN n_name IS NULL THEN 0 ELSE 1 END AS has_nation,
           CAST(NULL AS DOUBLE) AS grade, 0 AS has_grade
    FROM cohort LEFT JOIN nation ON CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE -n_nationkey END = school_id""")
def optional_lookup(spark, d):
    c = base.cohort(spark, d).select("entity_id", "school_id")
    key = F.col("n_nationkey")  # from 10 on under numbers that no member has
    nations = load(spark, d, "nation").select(
        F.when(key < 10, key).otherwise(-key).alias("school_id"), F.col("n_name").alias("nation"))
    out = layouts.optional_lookup(c, nations, ["school_id"], {"nation": "string"}, "has_nation")
    return layouts.optional_lookup(out, None, ["school_id"], {"grade": "double"}, "has_grade").drop("school_id")


@query("assert_unique_key", """
    SELECT entity_id, n_name AS nation, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_dup_keys
    FROM cohort JOIN nation ON n_nationkey = school_id""")
def assert_unique_key(spark, d):
    nations = layouts.assert_unique(load(spark, d, "nation"), ["n_nationkey"])
    dups = layouts.duplicate_keys(load(spark, d, "orders"), ["o_custkey"]).agg(F.count("*"))
    out = base.cohort(spark, d).join(nations, F.col("school_id") == F.col("n_nationkey"))
    return out.select("entity_id", F.col("n_name").alias("nation"), dups.scalar().alias("n_dup_keys"))


@query("star_left_join", """
    SELECT c_custkey AS entity_id, n_name AS nation, r_name AS region, count(o_orderkey) AS n_orders
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY ALL""")
def star_left_join(spark, d):
    places = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    counts = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = load(spark, d, "customer")
    return (c.join(places, c.c_nationkey == F.col("n_nationkey"), "left")
            .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").alias("entity_id"), F.col("n_name").alias("nation"),
                    F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n_orders")))


@query("basic_agg", """
    SELECT position, count(*) AS n, CAST(sum(slot) AS BIGINT) AS slots, round(avg(rating), 6) AS mean_rating,
           max(rating) AS max_rating, min(rating) AS min_rating, round(median(rating), 6) AS median_rating
    FROM cohort GROUP BY position""")
def basic_agg(spark, d):
    from cohortcast.operators.grouped import attach
    from cohortcast.operators.ranks import exact_quantiles
    c = base.cohort(spark, d)
    stats = c.groupBy("position").agg(
        F.count("*").alias("n"), F.sum("slot").alias("slots"), F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.max("rating").alias("max_rating"), F.min("rating").alias("min_rating"))
    med = exact_quantiles(c, ["position"], "rating", [0.5], ["__m"])
    return attach(stats, med, ["position"]).withColumn("median_rating", base.r6(F.col("__m"))).drop("__m")


@query("argmax_dedupe", """
    SELECT entity_id, season, team, lines, qty FROM roster""")
def argmax_dedupe(spark, d):
    return base.roster(spark, d)


@query("distinct_keys", """
    SELECT DISTINCT entity_id, team FROM team_panel""")
def distinct_keys(spark, d):
    return best_row(base.team_panel(spark, d), ["entity_id", "team"], [F.col("season").asc()]).select("entity_id", "team")
