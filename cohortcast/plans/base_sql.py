"""Shared views of the oracle SQL. Each mirrors one function of `base`."""

from __future__ import annotations

import re

VIEWS = {
    "per_order": """
        SELECT l_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS qty,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
        FROM lineitem GROUP BY l_orderkey""",
    "panel": """
        SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS season,
               count(*) AS games, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(qty) AS BIGINT) AS qty,
               CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(returned) AS BIGINT) AS returned
        FROM orders JOIN per_order ON o_orderkey = l_orderkey
        GROUP BY o_custkey, year(o_orderdate)""",
    "cohort": """
        SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS position,
               CAST(1996 + c_custkey % 5 AS INTEGER) AS cohort_year,
               CAST(1 + floor((10000 - c_acctbal) / 42) AS INTEGER) AS slot,
               c_nationkey AS school_id, c_acctbal AS rating
        FROM customer""",
    "outcome_seasons": """
        SELECT c.entity_id, c.position, c.cohort_year, p.season - c.cohort_year + 1 AS season_num,
               p.games, p.cents / 3999971.0 / p.games AS season_ppg
        FROM cohort c JOIN panel p ON c.entity_id = p.entity_id
        WHERE p.season BETWEEN c.cohort_year AND c.cohort_year + 2""",
    "production": """
        SELECT entity_id, position, cohort_year, avg(season_ppg) AS raw_ppg,
               sum(season_ppg * games) / sum(games) AS weighted_ppg,
               CAST(sum(games) AS BIGINT) AS top2_games, count(*) AS n_qual
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
                        ORDER BY season_ppg DESC, season_num) AS rn
              FROM outcome_seasons WHERE games >= 2)
        WHERE rn <= 2 GROUP BY entity_id, position, cohort_year""",
    "shrunk": """
        SELECT *, (top2_games * weighted_ppg + 10 * avg(weighted_ppg) OVER (PARTITION BY position))
                  / (top2_games + 10) AS shrunk_ppg
        FROM production""",
    "outcome": """
        SELECT c.entity_id, c.name, c.position, c.cohort_year, c.slot, c.school_id, c.rating,
               s.raw_ppg, s.weighted_ppg, s.shrunk_ppg, s.top2_games, s.n_qual,
               CASE WHEN s.shrunk_ppg IS NOT NULL THEN 1 ELSE 0 END AS made_it,
               coalesce(s.shrunk_ppg, 0) AS ppg
        FROM cohort c LEFT JOIN shrunk s ON c.entity_id = s.entity_id""",
    "measures": """
        SELECT entity_id, position, cohort_year, slot, school_id, rating, name,
               CASE WHEN entity_id % 13 <> 0 THEN CAST(68 + entity_id % 9 AS INTEGER) END AS height_in,
               CASE WHEN entity_id % 11 <> 0 THEN CAST(180 + (entity_id * 7) % 61 AS INTEGER) END AS weight,
               CASE WHEN entity_id % 5 <> 0 THEN (430 + (entity_id * 13) % 40) / 100.0 END AS forty,
               20 + ((entity_id * 3) % 50) / 10.0 AS age
        FROM cohort""",
    "features": """
        SELECT m.*, f.cents / 10000.0 AS yards_final, f.lines AS rec_final, f.games AS games_final,
               q.cents / 10000.0 AS yards_penult,
               f.cents / 10000.0 / f.lines AS ypr,
               CAST(f.returned AS DOUBLE) / f.lines AS td_rate,
               f.cents / 10000.0 / f.games AS yards_per_game
        FROM measures m
        LEFT JOIN panel f ON f.entity_id = m.entity_id AND f.season = m.cohort_year - 1
        LEFT JOIN panel q ON q.entity_id = m.entity_id AND q.season = m.cohort_year - 2""",
    "team_panel": """
        SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS season,
               s_nationkey AS team, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS qty
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
        GROUP BY o_custkey, year(o_orderdate), s_nationkey""",
    "roster": """
        SELECT entity_id, season, team, lines, qty
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, season
                        ORDER BY qty DESC, lines DESC, team) AS rn FROM team_panel)
        WHERE rn = 1""",
    "plays": """
        SELECT event_id, user_id AS player, CAST(user_id % 10 AS INTEGER) AS team,
               CAST(1 + (user_id % 3) AS INTEGER) AS season,
               CAST(ts AS DATE) AS game, event_type AS kind,
               CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS yards, CASE WHEN event_id % 13 <> 0 THEN value END AS epa,
               CAST(1 + event_id % 4 AS INTEGER) AS down,
               CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 71 AS INTEGER) - 35 END AS score_diff
        FROM events""",
    "live_plays": "SELECT * FROM plays WHERE abs(score_diff) <= 28",
    "people": """
        SELECT p_partkey AS person_id,
               upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', ' O''')
               || CASE WHEN p_partkey % 7 = 0 THEN ' Jr.' WHEN p_partkey % 11 = 0 THEN ' III'
                       WHEN p_partkey % 13 = 0 THEN ' é2' ELSE '' END AS person,
               CASE p_partkey % 6 WHEN 0 THEN 'Ohio St.' WHEN 1 THEN 'Miami (FL)' WHEN 2 THEN 'Ala-Birmingham'
                    WHEN 3 THEN 'Georgia' WHEN 4 THEN 'Boise State' ELSE 'Ohio State' END AS school,
               CASE p_partkey % 5 WHEN 0 THEN 'SEC' WHEN 1 THEN 'Sun Belt' WHEN 2 THEN 'Mountain West'
                    WHEN 3 THEN NULL ELSE 'Big Ten' END AS conference,
               CASE p_partkey % 4 WHEN 0 THEN 'KAN' WHEN 1 THEN 'GNB' WHEN 2 THEN 'DAL' ELSE 'SD' END AS team,
               CASE WHEN p_partkey % 9 <> 0
                    THEN CAST(5 + p_partkey % 2 AS VARCHAR) || '-' || CAST(p_partkey % 12 AS VARCHAR)
                    ELSE 'n/a' END AS ht,
               CASE WHEN p_partkey % 4 <> 0 THEN 'X' || CAST(p_partkey AS VARCHAR) END AS official_id,
               CAST(2000 + p_partkey % 20 AS INTEGER) AS draft_year, p_size AS size, p_retailprice AS price
        FROM part""",
    "oos_raw": """
        SELECT entity_id, name, position, cohort_year AS test_year, slot, made_it, ppg,
               CAST(least(6, 1 + floor((slot - 1) / 44)) AS INTEGER) AS round,
               ((entity_id * 7919) % 997) / 1994.0 + 0.45 * made_it + 0.02 AS p_made_it,
               1 + ((entity_id * 104729) % 10007) / 1250.875 AS prod_pred,
               ((entity_id * 31) % 1013) / 1013.0 AS u1, ((entity_id * 57) % 499) / 499.0 AS u2
        FROM outcome""",
    "oos": """
        SELECT *, 0.9 * p_made_it + 0.03 AS p_iso, p_made_it * prod_pred AS exp_ppg,
               CASE WHEN entity_id % 19 <> 0 THEN 0.5 * ppg + 4 * u1 END AS exp_ppg_bucket,
               CASE WHEN entity_id % 23 <> 0 THEN 0.6 * ppg + 3 * u2 END AS comp_ppg
        FROM oos_raw""",
    "bucket_probs": """
        SELECT entity_id, position, test_year, ppg, i AS bucket, w / sum(w) OVER (PARTITION BY entity_id) AS p,
               v / sum(v) OVER (PARTITION BY entity_id) AS q
        FROM (SELECT o.*, CAST(i AS INTEGER) AS i,
                     (1 + ((entity_id * (2 * i + 3) + 5 * i) % 101)) / 101.0 AS w,
                     (1 + ((entity_id * (2 * i + 5) + 7 * i) % 103)) / 103.0 AS v
              FROM oos_raw o, range(5) r(i))""",
    "comp_base": """
        SELECT f.*, o.ppg, o.made_it FROM features f JOIN outcome o ON o.entity_id = f.entity_id""",
    "comp_cohorts": "SELECT DISTINCT cohort_year AS cohort FROM cohort",
    "comp_long": """
        SELECT position, cohort_year, 0 AS i, CAST(yards_final AS DOUBLE) AS v FROM features WHERE yards_final IS NOT NULL
        UNION ALL SELECT position, cohort_year, 1, ypr FROM features WHERE ypr IS NOT NULL
        UNION ALL SELECT position, cohort_year, 2, forty FROM features WHERE forty IS NOT NULL
        UNION ALL SELECT position, cohort_year, 3, CAST(weight AS DOUBLE) FROM features WHERE weight IS NOT NULL""",
    "comp_scale": """
        SELECT position, cohort, i, CASE WHEN mad > 0 THEN mad * 1.4826 ELSE 1 END AS scale FROM (
          SELECT position, cohort, i, median(abs(v - m)) AS mad FROM (
            SELECT l.position, c.cohort, l.i, l.v, median(l.v) OVER (PARTITION BY l.position, c.cohort, l.i) AS m
            FROM comp_long l JOIN comp_cohorts c ON l.cohort_year < c.cohort) GROUP BY ALL)""",
    "comp_wide": """
        SELECT position, cohort, max(CASE WHEN i = 0 THEN scale END) AS s0, max(CASE WHEN i = 1 THEN scale END) AS s1,
               max(CASE WHEN i = 2 THEN scale END) AS s2, max(CASE WHEN i = 3 THEN scale END) AS s3
        FROM comp_scale GROUP BY position, cohort""",
    "comp_pool": """
        SELECT f.position, c.cohort, count(*) AS n_pool FROM features f JOIN comp_cohorts c ON f.cohort_year < c.cohort GROUP BY ALL""",
    "comp_cov": """
        SELECT f.position, c.cohort, var_samp(CASE WHEN yards_final IS NOT NULL THEN yards_final END) AS v0, var_samp(ypr) AS v1,
               covar_samp(CASE WHEN ypr IS NOT NULL THEN CAST(yards_final AS DOUBLE) END, CASE WHEN yards_final IS NOT NULL THEN ypr END) AS c01,
               var_samp(forty) AS v2, var_samp(weight) AS v3,
               covar_samp(CASE WHEN weight IS NOT NULL THEN CAST(forty AS DOUBLE) END, CASE WHEN forty IS NOT NULL THEN CAST(weight AS DOUBLE) END) AS c23
        FROM features f JOIN comp_cohorts c ON f.cohort_year < c.cohort GROUP BY ALL""",
    "comp_inv": """
        SELECT position, cohort, v1 / (v0 * v1 - 0.81 * c01 * c01) AS a00, v0 / (v0 * v1 - 0.81 * c01 * c01) AS a11,
               -0.9 * c01 / (v0 * v1 - 0.81 * c01 * c01) AS a01, v3 / (v2 * v3 - 0.81 * c23 * c23) AS b00,
               v2 / (v2 * v3 - 0.81 * c23 * c23) AS b11, -0.9 * c23 / (v2 * v3 - 0.81 * c23 * c23) AS b01
        FROM (SELECT position, cohort, coalesce(v0, 1) AS v0, coalesce(v1, 1) AS v1, coalesce(c01, 0) AS c01,
                     coalesce(v2, 1) AS v2, coalesce(v3, 1) AS v3, coalesce(c23, 0) AS c23 FROM comp_cov)""",
    "all_pairs": """
        SELECT q.entity_id, q.position, q.cohort_year, p.entity_id AS comp_id, p.ppg AS comp_ppg, p.name AS comp_name,
               abs(q.slot - p.slot) AS gap,
               (CAST(q.yards_final AS DOUBLE) - p.yards_final) AS d0, (q.ypr - p.ypr) AS d1, (q.forty - p.forty) AS d2, (q.weight - p.weight) AS d3
        FROM comp_base q JOIN comp_pool n ON n.position = q.position AND n.cohort = q.cohort_year AND n.n_pool >= 30
        JOIN comp_base p ON p.position = q.position AND p.cohort_year < q.cohort_year""",
    "euclid_pairs": """
        SELECT a.*, round(coalesce(sqrt(CASE WHEN coalesce(d0, d1, d2, d3) IS NULL THEN NULL ELSE
               coalesce(pow(d0 / s0, 2), 0) + coalesce(pow(d1 / s1, 2), 0) + coalesce(pow(d2 / s2, 2), 0) + coalesce(pow(d3 / s3, 2), 0) END),
               CAST('inf' AS DOUBLE)), 9) AS distance
        FROM all_pairs a JOIN comp_wide w ON w.position = a.position AND w.cohort = a.cohort_year""",
    "mahal_pairs": """
        SELECT a.*, round(coalesce(sqrt(
               (1.5 * (CASE WHEN d0 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d1 IS NULL THEN 0 ELSE 0.5 END)
                    * greatest(0, coalesce(a00 * d0 * d0, 0) + coalesce(2 * a01 * d0 * d1, 0) + coalesce(a11 * d1 * d1, 0))
                + (CASE WHEN d2 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d3 IS NULL THEN 0 ELSE 0.5 END)
                    * greatest(0, coalesce(b00 * d2 * d2, 0) + coalesce(2 * b01 * d2 * d3, 0) + coalesce(b11 * d3 * d3, 0)))
               / nullif(1.5 * (CASE WHEN d0 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d1 IS NULL THEN 0 ELSE 0.5 END)
                + (CASE WHEN d2 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d3 IS NULL THEN 0 ELSE 0.5 END), 0)), CAST('inf' AS DOUBLE)), 9) AS distance
        FROM all_pairs a JOIN comp_inv v ON v.position = a.position AND v.cohort = a.cohort_year""",
    "euclid_comps": """
        SELECT entity_id, position, cohort_year, comp_id, comp_ppg, comp_name, distance, CAST(rk AS INTEGER) AS comp_rank, d0, d1, d2, d3 FROM (
          SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY distance, comp_id) AS rk FROM (
            SELECT *, count(*) FILTER (WHERE gap <= 40) OVER (PARTITION BY entity_id) AS n_in,
                   row_number() OVER (PARTITION BY entity_id ORDER BY gap, comp_id) AS gap_rk FROM euclid_pairs)
          WHERE CASE WHEN n_in >= 8 THEN gap <= 40 ELSE gap_rk <= 24 END) WHERE rk <= 8""",
    "mahal_comps": """
        SELECT entity_id, position, cohort_year, comp_id, comp_ppg, distance, CAST(rk AS INTEGER) AS comp_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY distance, comp_id) AS rk FROM (
            SELECT *, count(*) FILTER (WHERE gap <= 40) OVER (PARTITION BY entity_id) AS n_in,
                   row_number() OVER (PARTITION BY entity_id ORDER BY gap, comp_id) AS gap_rk FROM mahal_pairs)
          WHERE CASE WHEN n_in >= 8 THEN gap <= 40 ELSE gap_rk <= 24 END) WHERE rk <= 8""",
}


def with_views(sql: str) -> str:
    """Prefix `sql` with the shared views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in needed)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
