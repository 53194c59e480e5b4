"""Text keys, recodes, search and re-attribution."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.functions import text as tx
from cohortcast.operators import match
from cohortcast.operators import events as ev
from cohortcast.operators.grouped import best_row, top_per_group
from cohortcast.plans import base
from cohortcast.plans.registry import query
from cohortcast.sources.tables import load


def sql_list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CLEAN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z ]', '', 'g'), '\s+', ' ', 'g'))"
STRIP = r"regexp_replace({0}, '\s+(jr|sr|ii|iii|iv|v)$', '')"
FOLD = f"translate(lower({{0}}), '{presets.ACCENT_FROM}', '{presets.ACCENT_TO}')"
SCHOOL = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
          r"lower({0}), '\.', '', 'g'), '\bst\b', 'state', 'g'), '\s*\([^)]+\)', '', 'g'),"
          r" 'ala-', 'alabama ', 'g'), 'la-', 'louisiana ', 'g'), '\s+', ' ', 'g'))")
CN = CLEAN.format("person")
SN = STRIP.format(CN)


@query("name_keys", rf"""
    SELECT person_id, {CN} AS name_clean, {SN} AS name_stripped,
           trim(regexp_replace(regexp_replace({FOLD.format('person')}, '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) AS name_search,
           trim(regexp_replace(regexp_replace(regexp_replace(lower(person), '\s+(jr|sr|ii|iii|iv|v)\.?$', ''), '[^a-z ]', '', 'g'), '\s+', ' ', 'g')) AS name_plain,
           {SCHOOL.format('school')} AS school_norm, regexp_extract({SN}, '(\S+)$', 1) AS last_name,
           substr({CN}, 1, 1) AS initial,
           CASE WHEN official_id IS NOT NULL THEN 'id:' || official_id
                ELSE 'fallback|' || CAST(draft_year AS VARCHAR) || '|' || {CN} || '|' || {SCHOOL.format('school')} END AS key
    FROM people WHERE NOT regexp_matches(person, '^#')""")
def name_keys(spark, d):
    person, school = F.col("person"), F.col("school")
    clean = tx.clean_name(person)
    return base.people(spark, d).where(~person.rlike(presets.PLACEHOLDER_NAME)).select(
        "person_id", clean.alias("name_clean"), tx.strip_suffix(clean).alias("name_stripped"),
        tx.search_name(person).alias("name_search"), tx.suffix_first_name(person).alias("name_plain"),
        tx.normalize_school(school).alias("school_norm"), tx.last_token(tx.strip_suffix(clean)).alias("last_name"),
        tx.first_initial(clean).alias("initial"),
        tx.identity_key(F.col("official_id"), F.col("draft_year"), clean, tx.normalize_school(school)).alias("key"))


@query("suffix_variants", rf"""
    WITH p AS (SELECT person_id, {CN} AS name_clean, {SCHOOL.format('school')} AS school_norm, price FROM people),
    u AS (SELECT * FROM p UNION ALL
          SELECT person_id, {STRIP.format('name_clean')}, school_norm, price FROM p WHERE {STRIP.format('name_clean')} <> name_clean)
    SELECT name_clean, school_norm, person_id, price FROM (
      SELECT *, row_number() OVER (PARTITION BY name_clean, school_norm ORDER BY price DESC, person_id) AS rn FROM u) WHERE rn = 1""")
def suffix_variants(spark, d):
    from cohortcast.operators.match import add_stripped_variants
    p = base.people(spark, d).select("person_id", tx.clean_name(F.col("person")).alias("name_clean"),
                                     tx.normalize_school(F.col("school")).alias("school_norm"), "price")
    return add_stripped_variants(p, "name_clean", ["school_norm"], [F.col("price").desc(), F.col("person_id").asc()])


def case_map(col, table):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {col} END"


@query("dictionary_recode", rf"""
    SELECT person_id, {case_map('team', presets.TEAM_ALIASES)} AS team_code,
           {case_map(CN, {'blue o bolt': 'bolt blue', 'small oring': 'sam ring'})} AS name_fixed
    FROM people""")
def dictionary_recode(spark, d):
    return base.people(spark, d).select(
        "person_id", tx.recode(F.col("team"), presets.TEAM_ALIASES).alias("team_code"),
        tx.recode(tx.clean_name(F.col("person")), {"blue o bolt": "bolt blue", "small oring": "sam ring"}).alias("name_fixed"))


@query("slugify", r"""
    SELECT person_id, regexp_replace(regexp_replace(lower(person), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
           || '-' || CAST(draft_year AS VARCHAR) AS slug
    FROM people""")
def slugify(spark, d):
    return base.people(spark, d).select("person_id", tx.slug(F.col("person"), F.col("draft_year")).alias("slug"))


@query("parse_feet_inches", r"""
    SELECT person_id, CAST(12 * TRY_CAST(regexp_extract(ht, '^(\d+)-(\d+)$', 1) AS INTEGER)
           + TRY_CAST(regexp_extract(ht, '^(\d+)-(\d+)$', 2) AS INTEGER) AS INTEGER) AS height_in
    FROM people""")
def parse_feet_inches(spark, d):
    return base.people(spark, d).select("person_id", tx.feet_inches(F.col("ht")).alias("height_in"))


@query("tier_classify", f"""
    SELECT person_id, CASE WHEN school IN ({sql_list(presets.P4_SCHOOLS)}) THEN 'P4'
           WHEN conference IN ({sql_list(presets.G5_CONFERENCES)}) THEN 'G5' ELSE 'Other' END AS tier
    FROM people""")
def tier_classify(spark, d):
    tier = (F.when(F.col("school").isin(*presets.P4_SCHOOLS), "P4")
            .when(F.col("conference").isin(*presets.G5_CONFERENCES), "G5").otherwise("Other"))
    return base.people(spark, d).select("person_id", tier.alias("tier"))


@query("entity_search", rf"""
    SELECT person_id, person, school, draft_year FROM people
    WHERE (contains(lower(person), 'ring') OR contains(lower(school), 'ring')) AND draft_year >= 2010 AND size >= 20""")
def entity_search(spark, d):
    q = "ring"
    hit = F.lower("person").contains(q) | F.lower("school").contains(q)
    return base.people(spark, d).where(hit & (F.col("draft_year") >= 2010) & (F.col("size") >= 20)).select(
        "person_id", "person", "school", "draft_year")


@query("fuzzy_suggest", rf"""
    SELECT ask, name_clean, dist FROM (
      SELECT ask, name_clean, dist, row_number() OVER (PARTITION BY ask ORDER BY dist, name_clean) AS rn FROM (
        SELECT ask, name_clean, CAST(levenshtein(ask, name_clean) AS INTEGER) AS dist
        FROM (SELECT DISTINCT {CN} AS name_clean FROM people), (VALUES ('smal rong'), ('blu gear'), ('hot plat')) v(ask)))
    WHERE rn <= 5""")
def fuzzy_suggest(spark, d):
    names = base.people(spark, d).select(tx.clean_name(F.col("person")).alias("name_clean")).distinct()
    asks = spark.createDataFrame([(a,) for a in ("smal rong", "blu gear", "hot plat")], "ask STRING")
    return match.nearest_texts(asks, names, "ask", "name_clean", 5).withColumnRenamed("text", "name_clean")


@query("name_reattribution", r"""
    WITH n AS (
      SELECT p_partkey AS play_id, CAST(p_partkey % 3 AS INTEGER) AS team,
             upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
             || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS full_name
      FROM part),
    plays_x AS (
      SELECT play_id, team, CASE WHEN play_id % 5 <> 0 THEN full_name
             WHEN play_id % 25 = 0 THEN '#' || (play_id % 99) || ' X.Nobody rushed to 38'
             ELSE '#' || (play_id % 99) || ' ' || substr(full_name, 1, 1) || '.' || split_part(full_name, ' ', 2) || ' rushed to 38' END AS player
      FROM n),
    lk AS (
      SELECT team, initial, last_name, name FROM (
        SELECT *, row_number() OVER (PARTITION BY team, initial, last_name ORDER BY k DESC, name) AS rn FROM (
          SELECT team, substr(player, 1, 1) AS initial, regexp_extract(player, '(\S+)$', 1) AS last_name, player AS name, count(*) AS k
          FROM plays_x WHERE NOT regexp_matches(player, '^#\d+\s+[A-Z]\.') GROUP BY ALL)) WHERE rn = 1)
    SELECT p.play_id, p.team, coalesce(lk.name, p.player) AS player
    FROM plays_x p LEFT JOIN lk ON regexp_matches(p.player, '^#\d+\s+[A-Z]\.') AND lk.team = p.team
      AND lk.initial = regexp_extract(p.player, '^#\d{1,3}\s([A-Z])', 1)
      AND lk.last_name = regexp_extract(p.player, '^#\d{1,3}\s[A-Z]\.([A-Za-z''\-]+)', 1)""")
def name_reattribution(spark, d):
    k = F.col("p_partkey")
    full = F.initcap("p_name")
    last = F.split_part(full, F.lit(" "), F.lit(2))
    tag = F.concat(F.lit("#"), (k % 99).cast("string"))
    plays = load(spark, d, "part").select(
        k.alias("play_id"), (k % 3).cast("int").alias("team"),
        F.when(k % 5 != 0, full)
        .when(k % 25 == 0, F.concat(tag, F.lit(" X.Nobody rushed to 38")))
        .otherwise(F.concat(tag, F.lit(" "), F.substring(full, 1, 1), F.lit("."), last, F.lit(" rushed to 38"))).alias("player"))
    return ev.reattribute(plays, "player", "team", presets.CORRUPTED_NAME, presets.CORRUPTED_INITIAL, presets.CORRUPTED_LAST)


LI = "regexp_extract_all(html, '<a href=\"([^\"<>]*)\">([^<]*)</a>', {0})"


@query("page_extract", f"""
    WITH m AS (SELECT page_id, {LI.format(1)} AS hrefs, {LI.format(2)} AS labels FROM pages),
    e AS (SELECT page_id, unnest(range(1, len(hrefs) + 1)) AS pos, hrefs, labels FROM m)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, hrefs[pos] AS href, labels[pos] AS label,
           CAST(length(hrefs[pos]) - length(replace(hrefs[pos], '/', '')) AS INTEGER) AS slashes,
           split_part(hrefs[pos], '/', 1) AS lead,
           CAST(row_number() OVER (ORDER BY page_id, pos) - 1 AS BIGINT) AS global_pos
    FROM e""")
def page_extract(spark, d):
    from cohortcast.operators.pages import extract_links
    return extract_links(load(spark, d, "pages"), "page_id", "html")
