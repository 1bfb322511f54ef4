"""Independent SQL for every query, for any engine that reads the same tables.

Series over time are computed here by laying events against all period points,
not with the moves used by the Spark operators.
"""

from __future__ import annotations

from hearthline.sources.tables import PRIORITY_TYPES


def r(expr: str, digits: int) -> str:
    """Rounded value without negative zero."""
    return f"(ROUND({expr}, {digits}) + 0.0)"


def q(expr: str, p: float) -> str:
    """Interpolated quantile."""
    return f"QUANTILE_CONT({expr}, {p})"


SCORE = "16.0::DOUBLE - SQRT(o_totalprice) / 75.0::DOUBLE"

CTES = {
    "menage": """
        SELECT c_custkey AS menage_ano,
               CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'Urbain' ELSE 'Rural' END AS milieu,
               CAST(r_regionkey AS BIGINT) AS region_id,
               CASE WHEN c_custkey % 97 <> 0 THEN r_name END AS region,
               CAST(n_nationkey AS BIGINT) AS province_id,
               n_name AS province,
               c_custkey % 50 AS commune_id,
               n_name || '-' || CAST(c_custkey % 5 AS VARCHAR) AS commune,
               c_mktsegment AS type_menage,
               c_custkey % 14 + 1 AS taille_menage,
               CASE c_custkey % 4 WHEN 0 THEN 'Marié(e)' WHEN 1 THEN 'Célibataire'
                    WHEN 2 THEN 'Divorcé(e)' ELSE 'Séparé(e)' END AS etat_matrimonial_cm,
               CASE WHEN c_custkey % 2 = 0 THEN 'Homme' ELSE 'Femme' END AS genre_cm,
               c_custkey % 2 + 1 AS sexe_id,
               CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS TIMESTAMP) AS date_naissance_cm
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "score_rows": f"""
        SELECT o_custkey AS menage_ano, o_orderkey AS score_id_ano,
               CASE LEFT(o_orderpriority, 1) WHEN '1' THEN 'inscription' WHEN '2' THEN 'mise à jour du dossier'
                    WHEN '3' THEN 'révision de score' WHEN '4' THEN 'réclamation' WHEN '5' THEN 'radiation' END AS type_demande,
               CASE WHEN o_orderkey % 10 = 0 THEN {SCORE} - 0.1::DOUBLE END AS score_corrige,
               {SCORE} AS score_calcule,
               o_orderdate AS date_calcul
        FROM orders""",
    "copies": """
        SELECT *, score_id_ano * 2 AS line_no FROM score_rows
        UNION ALL
        SELECT menage_ano, score_id_ano, type_demande, score_corrige, score_calcule + 0.25::DOUBLE,
               date_calcul + CASE WHEN score_id_ano % 100 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL (-3) DAY END,
               score_id_ano * 2 + 1
        FROM score_rows WHERE score_id_ano % 50 = 0""",
    "clean_copies": """
        SELECT *, COALESCE(score_corrige, score_calcule) AS score_final,
               score_corrige IS NOT NULL AND score_corrige IS DISTINCT FROM score_calcule AS was_corrected
        FROM copies WHERE COALESCE(score_corrige, score_calcule) <= 15""",
    "scores": """
        SELECT *, COALESCE(score_corrige, score_calcule) AS score_final,
               score_corrige IS NOT NULL AND score_corrige IS DISTINCT FROM score_calcule AS was_corrected
        FROM score_rows WHERE COALESCE(score_corrige, score_calcule) <= 15""",
    "programmes": """
        SELECT c_custkey AS menage_ano, 'AMOT' AS programme FROM customer WHERE c_custkey % 3 = 0
        UNION SELECT c_custkey, 'ASD' FROM customer WHERE c_custkey % 4 = 0
        UNION SELECT c_custkey, 'AMOA' FROM customer WHERE c_custkey % 11 = 0""",
    "benef": """
        SELECT o_custkey AS menage_ano, CASE WHEN o_custkey % 2 = 0 THEN 'AMOT' ELSE 'ASD' END AS partner_id,
               o_orderpriority AS motif, o_orderdate AS date_insert, o_orderstatus = 'O' AS actif
        FROM orders""",
    "named": """
        SELECT s.*, COALESCE(p.programme, 'NON CLASSIFIE') AS programme
        FROM scores s LEFT JOIN programmes p ON s.menage_ano = p.menage_ano""",
    "limited": """
        SELECT *, CASE programme WHEN 'AMOT' THEN 9.3264284::DOUBLE WHEN 'ASD' THEN 9.743001::DOUBLE END AS threshold
        FROM named""",
    "events_": """
        SELECT *, score_final - threshold AS dist_threshold,
               COALESCE(score_final - threshold < 0, FALSE) AS eligible,
               COALESCE(ABS(score_final - threshold) <= 0.10::DOUBLE, FALSE) AS "near_0.10",
               COALESCE(ABS(score_final - threshold) <= 0.25::DOUBLE, FALSE) AS "near_0.25",
               COALESCE(ABS(score_final - threshold) <= 0.50::DOUBLE, FALSE) AS "near_0.50"
        FROM limited""",
    "master": """
        SELECT e.*, m.* EXCLUDE (menage_ano)
        FROM events_ e LEFT JOIN menage m ON e.menage_ano = m.menage_ano""",
    "dated": """
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY menage_ano, date_calcul
                                                    ORDER BY programme, score_id_ano) AS rn FROM master)
        WHERE rn = 1""",
    "paired": """
        SELECT *, LAG(score_final) OVER w AS score_avant, score_final AS score_apres,
               LAG(date_calcul) OVER w AS date_avant, date_calcul AS date_apres, LAG(eligible) OVER w AS elig_avant
        FROM dated WINDOW w AS (PARTITION BY menage_ano ORDER BY date_calcul)""",
    "delta": """
        SELECT *, score_apres - score_avant AS "delta_ISE", ABS(score_apres - score_avant) AS abs_delta,
               DATESUB('day', date_avant, date_apres) AS days_between,
               CASE WHEN DATESUB('day', date_avant, date_apres) > 90
                    THEN (score_apres - score_avant) / DATESUB('day', date_avant, date_apres) END AS delta_distribue,
               CASE WHEN elig_avant THEN 'eligible' ELSE 'excluded' END AS side_avant,
               CASE WHEN eligible THEN 'eligible' ELSE 'excluded' END AS side_apres,
               CASE WHEN eligible AND NOT elig_avant THEN 'gained'
                    WHEN elig_avant AND NOT eligible THEN 'lost' ELSE 'stable' END AS status_change
        FROM paired WHERE score_avant IS NOT NULL""",
    "weekly_one": """
        SELECT * FROM (SELECT *, DATE_TRUNC('week', date_apres) AS week, ROW_NUMBER() OVER (
            PARTITION BY menage_ano, DATE_TRUNC('week', date_apres)
            ORDER BY days_between DESC, abs_delta DESC, date_apres DESC, score_id_ano DESC) AS pick FROM delta)
        WHERE pick = 1""",
    "flags": """
        SELECT programme, menage_ano, DATE_TRUNC('month', date_calcul) AS month,
               ARG_MAX(eligible, (date_calcul, score_id_ano)) AS flag
        FROM events_ GROUP BY 1, 2, 3""",
    "stepped": """
        SELECT menage_ano, programme, eligible,
               LAG(eligible) OVER (PARTITION BY menage_ano, programme ORDER BY date_calcul, score_id_ano) AS was
        FROM events_""",
    "reentry": """
        SELECT menage_ano, programme, CAST(COUNT(*) FILTER (WHERE eligible AND NOT was) AS BIGINT) AS n_reentries,
               BOOL_OR(eligible) AS ever_eligible, NOT BOOL_AND(eligible) AS ever_lost
        FROM stepped GROUP BY 1, 2""",
    "reentry_lines": """
        SELECT programme, CASE WHEN n_reentries > 0 THEN CAST(n_reentries AS VARCHAR)
                    WHEN NOT ever_lost THEN 'toujours éligible' WHEN NOT ever_eligible THEN 'jamais éligible'
                    ELSE 'perdu sans retour' END AS label FROM reentry""",
    "reentry_sum": f"""
        SELECT k.programme, k.label AS n_reentries, COUNT(l.label) AS n_menages,
               {r('COUNT(l.label) * 100.0::DOUBLE / t.total', 2)} AS pct_menages
        FROM (SELECT DISTINCT programme, label FROM reentry_lines UNION
              SELECT p.programme, x.label FROM (SELECT DISTINCT programme FROM reentry) p,
                     (VALUES ('toujours éligible'), ('jamais éligible'), ('perdu sans retour')) x(label)) k
        JOIN (SELECT programme, COUNT(*) AS total FROM reentry GROUP BY 1) t ON t.programme = k.programme
        LEFT JOIN reentry_lines l ON l.programme = k.programme AND l.label = k.label
        GROUP BY k.programme, k.label, t.total""",
    # household states for the weekly series
    "acts": """
        SELECT menage_ano, date_calcul, score_id_ano, type_demande AS kind,
               CASE WHEN type_demande <> 'radiation' THEN score_final END AS score
        FROM scores""",
    "firsts": """
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY menage_ano ORDER BY date_calcul, score_id_ano) AS k,
                              MIN(date_calcul) OVER () AS t0 FROM acts)
        WHERE k = 1 AND kind <> 'inscription' AND date_calcul > t0""",
    "seeded": """
        SELECT a.menage_ano, a.date_calcul, a.score_id_ano, a.score FROM acts a
        LEFT JOIN firsts f ON a.menage_ano = f.menage_ano AND a.date_calcul = f.date_calcul
        WHERE f.menage_ano IS NULL
        UNION ALL SELECT menage_ano, t0, score_id_ano, score FROM firsts""",
    "lives": """
        SELECT *, LEAD(date_calcul) OVER (PARTITION BY menage_ano ORDER BY date_calcul, score_id_ano) AS nxt
        FROM seeded""",
    "points": """
        SELECT UNNEST(GENERATE_SERIES(DATE_TRUNC('week', MIN(date_calcul)), DATE_TRUNC('week', MAX(date_calcul)),
                                      INTERVAL 7 DAY)) AS point FROM scores""",
    "alive": """
        SELECT p.point, l.menage_ano, l.score FROM lives l JOIN points p
            ON p.point >= l.date_calcul AND (l.nxt IS NULL OR p.point < l.nxt)
        WHERE l.score IS NOT NULL""",
    "series": f"""
        SELECT point AS date_calcul, CAST(NULL AS VARCHAR) AS milieu, CAST(NULL AS VARCHAR) AS region,
               CAST(NULL AS VARCHAR) AS genre_cm, COUNT(*) AS n_menages,
               {r('AVG(score)', 6)} AS score_mean, {r('MEDIAN(score)', 6)} AS score_median,
               {r('STDDEV_POP(score)', 6)} AS score_std, {r('MIN(score)', 6)} AS score_min, {r('MAX(score)', 6)} AS score_max,
               {r(q('score', 0.1), 6)} AS score_p10, {r(q('score', 0.25), 6)} AS score_p25,
               {r(q('score', 0.75), 6)} AS score_p75, {r(q('score', 0.9), 6)} AS score_p90
        FROM alive GROUP BY point""",
    "alive_dims": """
        SELECT a.point, a.score, d.dim, CASE d.dim WHEN 'milieu' THEN m.milieu WHEN 'region' THEN m.region
                    WHEN 'genre_cm' THEN m.genre_cm END AS member
        FROM alive a LEFT JOIN menage m ON a.menage_ano = m.menage_ano,
             (VALUES ('all'), ('milieu'), ('region'), ('genre_cm')) d(dim)""",
    "near_lives": """
        SELECT programme, menage_ano, date_calcul, dist_threshold AS dist,
               CASE WHEN type_demande <> 'radiation' THEN score_final END AS score,
               LEAD(date_calcul) OVER (PARTITION BY programme, menage_ano ORDER BY date_calcul, score_id_ano) AS nxt
        FROM events_ WHERE programme <> 'NON CLASSIFIE'""",
    "near_points": """
        SELECT UNNEST(GENERATE_SERIES(DATE_TRUNC('week', MIN(date_calcul)), DATE_TRUNC('week', MAX(date_calcul)),
                                      INTERVAL 7 DAY)) AS week FROM near_lives""",
    "near_alive": """
        SELECT p.week, l.programme, l.score, l.dist FROM near_lives l JOIN near_points p
            ON p.week >= l.date_calcul AND (l.nxt IS NULL OR p.week < l.nxt)
        WHERE l.score IS NOT NULL AND l.dist IS NOT NULL""",
    "sizes": "SELECT taille_menage, COUNT(*) AS n_menages FROM menage WHERE taille_menage <= 12 GROUP BY 1",
    "traj": """
        SELECT menage_ano, COUNT(score_final) AS n_events,
               ARG_MAX(score_final, (date_calcul, programme, score_id_ano)) AS score_actuel,
               MIN(score_final) AS score_min, MAX(score_final) AS score_max,
               MIN(date_calcul) AS date_premier, MAX(date_calcul) AS date_dernier,
               ARG_MIN(eligible, (date_calcul, programme, score_id_ano)) AS eligible_inscription,
               ARG_MAX(eligible, (date_calcul, programme, score_id_ano)) AS eligible_actuel,
               BOOL_OR(type_demande = 'radiation') AS est_radie,
               ARG_MAX(type_demande, (date_calcul, programme, score_id_ano)) AS last_type,
               DATESUB('day', MIN(date_calcul), MAX(date_calcul)) AS jours_dans_systeme
        FROM events_ GROUP BY 1""",
    "changes": "SELECT menage_ano, COUNT(*) FILTER (WHERE eligible <> elig_avant) AS n_changes FROM paired GROUP BY 1",
    "traj_status": """
        SELECT t.* EXCLUDE (last_type),
               CASE WHEN last_type = 'radiation' THEN 'radiation' WHEN n_changes > 1 THEN 'fluctuating'
                    WHEN eligible_inscription AND eligible_actuel THEN 'stable_eligible'
                    WHEN NOT eligible_inscription AND NOT eligible_actuel THEN 'stable_excluded'
                    WHEN eligible_actuel THEN 'gained' ELSE 'lost' END AS statut_actuel
        FROM traj t JOIN changes c ON t.menage_ano = c.menage_ano""",
    "flow_moves": """
        SELECT programme, month, flag, LAG(flag) OVER (PARTITION BY programme, menage_ano ORDER BY month) AS was
        FROM flags""",
    "benef_flags": """
        SELECT partner_id, menage_ano, DATE_TRUNC('month', date_insert) AS month,
               ARG_MAX(actif, (date_insert, motif, actif)) AS flag
        FROM benef GROUP BY 1, 2, 3""",
    # stock by definition: last flag of every household up to the month
    "benef_months": "SELECT DISTINCT partner_id, month FROM benef_flags",
    "benef_stock": """
        SELECT m.partner_id, m.month, COUNT(*) FILTER (WHERE s.flag) AS on_, COUNT(*) FILTER (WHERE NOT s.flag) AS off_
        FROM benef_months m JOIN (
            SELECT *, LEAD(month) OVER (PARTITION BY partner_id, menage_ano ORDER BY month) AS nxt FROM benef_flags) s
          ON s.partner_id = m.partner_id AND s.month <= m.month AND (s.nxt IS NULL OR m.month < s.nxt)
        GROUP BY 1, 2""",
    "benef_moves": """
        SELECT partner_id, month, COUNT(*) FILTER (WHERE flag AND NOT COALESCE(was, FALSE)) AS became_on,
               COUNT(*) FILTER (WHERE NOT flag AND was) AS became_off
        FROM (SELECT *, LAG(flag) OVER (PARTITION BY partner_id, menage_ano ORDER BY month) AS was FROM benef_flags)
        GROUP BY 1, 2""",
    "benef_flow": """
        SELECT s.month AS date, s.partner_id AS programme, on_ AS unique_menages_eligible,
               off_ AS unique_menages_not_eligible, became_on AS menages_became_eligible,
               became_off AS menages_became_ineligible
        FROM benef_stock s JOIN benef_moves m ON s.partner_id = m.partner_id AND s.month = m.month""",
    "prog_months": "SELECT DISTINCT programme, month FROM flags",
    "prog_stock": """
        SELECT m.programme, m.month, COUNT(*) FILTER (WHERE s.flag) AS pool_end
        FROM prog_months m JOIN (
            SELECT *, LEAD(month) OVER (PARTITION BY programme, menage_ano ORDER BY month) AS nxt FROM flags) s
          ON s.programme = m.programme AND s.month <= m.month AND (s.nxt IS NULL OR m.month < s.nxt)
        GROUP BY 1, 2""",
    "prog_moves": """
        SELECT programme, month, COUNT(*) FILTER (WHERE flag AND NOT was) AS entries,
               COUNT(*) FILTER (WHERE NOT flag AND was) AS exits
        FROM flow_moves GROUP BY 1, 2""",
    "churn": """
        SELECT s.month AS date, s.programme,
               COALESCE(LAG(pool_end) OVER (PARTITION BY s.programme ORDER BY s.month), 0) AS pool_start,
               pool_end, entries, exits
        FROM prog_stock s JOIN prog_moves m ON s.programme = m.programme AND s.month = m.month""",
    "vol_weekly": f"""
        SELECT week, COUNT(*) AS n_menages, {r('AVG("delta_ISE")', 6)} AS mean_delta,
               {r('MEDIAN("delta_ISE")', 6)} AS median_delta, {r('STDDEV("delta_ISE")', 6)} AS sigma_delta,
               {r(q('"delta_ISE"', 0.1), 6)} AS p10_delta, {r(q('"delta_ISE"', 0.25), 6)} AS p25_delta,
               {r(q('"delta_ISE"', 0.75), 6)} AS p75_delta, {r(q('"delta_ISE"', 0.9), 6)} AS p90_delta
        FROM weekly_one GROUP BY week""",
    "abs_weekly": f"""
        SELECT week, COUNT(*) AS n_menages, {r('AVG(abs_delta)', 6)} AS mean_abs_delta,
               {r('MEDIAN(abs_delta)', 6)} AS median_abs_delta, {r(q('abs_delta', 0.1), 6)} AS p10_abs_delta,
               {r(q('abs_delta', 0.25), 6)} AS p25_abs_delta, {r(q('abs_delta', 0.75), 6)} AS p75_abs_delta,
               {r(q('abs_delta', 0.9), 6)} AS p90_abs_delta, {r(q('abs_delta', 0.99), 6)} AS p99_abs_delta,
               {r('AVG(CASE WHEN "delta_ISE" < 0 THEN abs_delta END)', 6)} AS mean_improvement,
               {r('AVG(CASE WHEN "delta_ISE" > 0 THEN "delta_ISE" END)', 6)} AS mean_degradation,
               COUNT(*) FILTER (WHERE "delta_ISE" < 0) AS n_improving, COUNT(*) FILTER (WHERE "delta_ISE" > 0) AS n_degrading
        FROM weekly_one GROUP BY week""",
    "ts_weekly": f"""
        SELECT DATE_TRUNC('week', date_calcul) AS date_calcul, MAX(n_menages) AS n_menages, MIN(score_min) AS score_min,
               MAX(score_max) AS score_max, {r('AVG(score_mean)', 6)} AS score_mean,
               {r('AVG(score_median)', 6)} AS score_median, {r('AVG(score_std)', 6)} AS score_std,
               {r('AVG(score_p10)', 6)} AS score_p10, {r('AVG(score_p25)', 6)} AS score_p25,
               {r('AVG(score_p75)', 6)} AS score_p75, {r('AVG(score_p90)', 6)} AS score_p90
        FROM series GROUP BY 1""",
    "history": f"""
        SELECT m.menage_ano, m.date_calcul, m.score_id_ano, m.score_final AS score_final_corrige, m.score_calcule,
               m.score_corrige, m.was_corrected, m.type_demande AS canal, m.programme, m.eligible,
               {r('m.dist_threshold', 6)} AS dist_threshold, m."near_0.10" AS near_10pct, m.region, m.milieu,
               m.taille_menage, {r('p.score_apres - p.score_avant', 6)} AS delta_ise
        FROM master m LEFT JOIN paired p ON m.menage_ano = p.menage_ano AND m.date_calcul = p.date_calcul""",
}

_NEEDS = {
    "copies": ["score_rows"],
    "clean_copies": ["copies"],
    "scores": ["score_rows"],
    "named": ["scores", "programmes"],
    "limited": ["named"],
    "events_": ["limited"],
    "master": ["events_", "menage"],
    "dated": ["master"],
    "paired": ["dated"],
    "delta": ["paired"],
    "weekly_one": ["delta"],
    "flags": ["events_"],
    "stepped": ["events_"],
    "reentry": ["stepped"],
    "reentry_lines": ["reentry"],
    "reentry_sum": ["reentry", "reentry_lines"],
    "acts": ["scores"],
    "firsts": ["acts"],
    "seeded": ["acts", "firsts"],
    "lives": ["seeded"],
    "points": ["scores"],
    "alive": ["lives", "points"],
    "series": ["alive"],
    "alive_dims": ["alive", "menage"],
    "near_lives": ["events_"],
    "near_points": ["near_lives"],
    "near_alive": ["near_lives", "near_points"],
    "sizes": ["menage"],
    "traj": ["events_"],
    "changes": ["paired"],
    "traj_status": ["traj", "changes"],
    "flow_moves": ["flags"],
    "benef_flags": ["benef"],
    "benef_months": ["benef_flags"],
    "benef_stock": ["benef_months", "benef_flags"],
    "benef_moves": ["benef_flags"],
    "benef_flow": ["benef_stock", "benef_moves"],
    "prog_months": ["flags"],
    "prog_stock": ["prog_months", "flags"],
    "prog_moves": ["flow_moves"],
    "churn": ["prog_stock", "prog_moves"],
    "vol_weekly": ["weekly_one"],
    "abs_weekly": ["weekly_one"],
    "ts_weekly": ["series"],
    "history": ["master", "paired"],
}


def near_sql(bands: tuple[float, ...]) -> str:
    """Near-threshold measures for any bands."""
    cols = []
    for b in bands:
        s = f"{int(b * 100):03d}"
        for suffix, cond in (
            (s, f"ABS(dist) <= {b}::DOUBLE"),
            (f"{s}_neg", f"dist >= -({b}::DOUBLE) AND dist < 0"),
            (f"{s}_pos", f"dist > 0 AND dist <= {b}::DOUBLE"),
        ):
            cols += [
                f"COUNT(*) FILTER (WHERE {cond}) AS n_near_{suffix}",
                f"{r(f'AVG(score) FILTER (WHERE {cond})', 6)} AS mean_score_{suffix}",
                f"{r(f'MEDIAN(score) FILTER (WHERE {cond})', 6)} AS median_score_{suffix}",
            ]
    return f"SELECT week, programme, COUNT(*) AS n_total, {', '.join(cols)} FROM near_alive GROUP BY 1, 2"


CTES["near"] = near_sql((0.10, 0.25, 0.50))
_NEEDS["near"] = ["near_alive"]

_NEAR_COUNTS = [f"n_near_{s}{side}" for s in ("010", "025", "050") for side in ("", "_neg", "_pos")]
_DELTA = (
    "menage_ano, date_calcul, score_id_ano, programme, score_avant, score_apres, date_avant, "
    '"delta_ISE", abs_delta, days_between, side_avant, side_apres, status_change'
)
_SCORE_COLS = "menage_ano, score_id_ano, type_demande, score_corrige, score_calcule, date_calcul, score_final, was_corrected"


def _status(column: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {column} {cases} ELSE {column} END"


_CHANGE = {"gained": "A gagné l''éligibilité", "lost": "A perdu l''éligibilité", "stable": "Stable"}
_TRAJ = {
    "stable_eligible": "Stable — éligible",
    "stable_excluded": "Stable — exclu",
    "gained": "A gagné l''éligibilité",
    "lost": "A perdu l''éligibilité",
    "fluctuating": "Fluctuant",
}
_PROG = {
    "AMOT": "AMO Tadamon (AMOT)",
    "ASD": "ASD — Aide Sociale Directe",
    "AMOA": "AMOA — Aide au Logement",
}
_CHANNEL = {
    "mise à jour du dossier": "Mise à jour",
    "Inscription": "Inscription",
    "radiation": "Radiation",
    "révision de score": "Révision",
    "Préinscription": "Préinscription",
    "réclamation": "Réclamation",
}
_REPAIR = [("GuelmimOued Noun", "Guelmim-Oued Noun"), ("Feminin", "Féminin")]


def _repaired(text: str) -> str:
    for bad, good in _REPAIR:
        text = f"REPLACE({text}, '{bad}', '{good}')"
    return text


def _counts(column: str) -> tuple[str, str]:
    return "menage", f"SELECT {column}, COUNT(*) AS n_menages FROM menage GROUP BY 1"


def _adjusted(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    d = "delta_distribue"
    return f"""SELECT {lead}COUNT(*) AS n_total, COUNT({d}) AS n_valid,
        COUNT(*) FILTER (WHERE days_between <= 90) AS n_short_gap_excluded,
        {r(f'AVG({d})', 6)} AS mean, {r(f'MEDIAN({d})', 6)} AS median, {r(f'STDDEV({d})', 6)} AS std,
        {r(q(d, 0.1), 6)} AS p10, {r(q(d, 0.25), 6)} AS q1, {r(q(d, 0.75), 6)} AS q3, {r(q(d, 0.9), 6)} AS p90,
        {r(f'MIN({d})', 6)} AS min_val, {r(f'MAX({d})', 6)} AS max_val
        FROM delta {group}"""


def _adjusted_by(column: str) -> str:
    d = "delta_distribue"
    return f"""SELECT {column}, COUNT(*) AS n_valid, {r(f'AVG({d})', 6)} AS mean, {r(f'STDDEV({d})', 6)} AS std,
        {r(f'MEDIAN({d})', 6)} AS median FROM delta WHERE {d} IS NOT NULL AND {column} IS NOT NULL GROUP BY 1"""


def _ts_by(column: str, extra: str = "") -> str:
    return f"""SELECT DATE_TRUNC('week', date_calcul) AS date_calcul, {column}, COUNT(DISTINCT menage_ano) AS n_menages,
        {r('AVG(score_final)', 6)} AS score_mean, {r('MEDIAN(score_final)', 6)} AS score_median,
        {r('STDDEV(score_final)', 6)} AS score_std
        FROM master WHERE {column} IS NOT NULL {extra} GROUP BY 1, 2"""


def _churn_parts(keys: str, where: str) -> str:
    return f"""SELECT {keys}, entries, exits, stock, {r('(entries + exits) / stock', 4)} AS churn FROM (
        SELECT {keys}, COUNT(*) FILTER (WHERE status_change = 'gained') AS entries,
               COUNT(*) FILTER (WHERE status_change = 'lost') AS exits,
               (COUNT(*) FILTER (WHERE side_avant = 'eligible') + COUNT(*) FILTER (WHERE side_apres = 'eligible')) / 2.0::DOUBLE AS stock
        FROM delta {where} GROUP BY {keys}) WHERE stock > 0"""


def _pivot(agg: str) -> str:
    cols = []
    for t in PRIORITY_TYPES.values():  # the types present in the given tables
        if agg == "last":
            cell = f"ARG_MAX(score_final, (date_calcul, programme, score_id_ano)) FILTER (WHERE type_demande = '{t}')"
        else:
            cell = r(f"AVG(score_final) FILTER (WHERE type_demande = '{t}')", 6)
        cols.append(f'{cell} AS "score_{t}"')
    return f"SELECT menage_ano, programme, {', '.join(cols)} FROM events_ GROUP BY 1, 2"


def _mode(column: str) -> str:
    return f"""SELECT '{column}' AS attribut, ARG_MIN(k, (-n, k)) AS categorie, MAX(n) AS n_menages,
        {r('MAX(n) * 100.0::DOUBLE / SUM(n)', 4)} AS pct FROM (SELECT {column} AS k, COUNT(*) AS n FROM menage GROUP BY 1)"""


_QC_LINES = """
    SELECT metric, label_fr, CAST("before" AS BIGINT) AS before, CAST("after" AS BIGINT) AS after,
           CAST(dropped AS BIGINT) AS dropped, ROUND(dropped * 100.0::DOUBLE / "before", 4) AS pct_dropped,
           CASE metric WHEN 'scores_raw_rows' THEN 'Volume brut de score.csv comparé au dataset final après nettoyage.'
             WHEN 'scores_duplicate_rows' THEN 'Lignes retirées au nettoyage (doublons et autres exclusions avant dataset final).'
             WHEN 'menage_raw_rows' THEN 'Volume brut de menage.csv comparé au dataset ménage nettoyé.'
             WHEN 'menage_duplicate_ids' THEN 'Conservation de la première occurrence par menage_ano.'
             WHEN 'menage_no_score' THEN 'Ménages présents dans le référentiel sans événement score.'
             WHEN 'menage_non_classifie' THEN 'Ménages non appariés aux listes programme AMOT/ASD/AMOA.'
             WHEN 'scores_aberrant' THEN 'Scores avec score_final > 15.0 exclus.'
           END AS note FROM (
    SELECT 'scores_raw_rows' AS metric, 'Lignes brutes score chargées' AS label_fr, raw AS "before", kept AS "after", raw - kept AS dropped FROM c
    UNION ALL SELECT 'scores_duplicate_rows', 'Doublons exacts (scores)', raw, kept, raw - kept FROM c
    UNION ALL SELECT 'scores_aberrant', 'Scores aberrants (> max)', raw, raw - over, over FROM c
    UNION ALL SELECT 'menage_raw_rows', 'Lignes brutes ménage chargées', raw_h, h, raw_h - h FROM c
    UNION ALL SELECT 'menage_duplicate_ids', 'Doublons ID ménage', raw_h, h, raw_h - h FROM c
    UNION ALL SELECT 'menage_no_score', 'Ménages sans score associé', h, h - lonely, lonely FROM c
    UNION ALL SELECT 'menage_non_classifie', 'Ménages non classifiés', seen, seen - nc, nc FROM c)"""

_DENSE = """
    ev AS (SELECT user_id AS h, ts, event_id, CASE WHEN event_type <> 'error' THEN SQRT(ABS(value)) END AS score,
                  event_type AS kind FROM events),
    f AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY h ORDER BY ts, event_id) AS k,
                                MIN(ts) OVER () AS t0 FROM ev)
          WHERE k = 1 AND kind <> 'view' AND ts > t0),
    s AS (SELECT ev.h, ev.ts, ev.event_id, ev.score FROM ev LEFT JOIN f ON ev.h = f.h AND ev.ts = f.ts WHERE f.h IS NULL
          UNION ALL SELECT h, t0, event_id, score FROM f),
    l AS (SELECT *, LEAD(ts) OVER (PARTITION BY h ORDER BY ts, event_id) AS nxt FROM s),
    p AS (SELECT UNNEST(GENERATE_SERIES(DATE_TRUNC('day', MIN(ts)), DATE_TRUNC('day', MAX(ts)), INTERVAL 1 DAY)) AS point FROM events),
    a AS (SELECT p.point, l.score FROM l JOIN p ON p.point >= l.ts AND (l.nxt IS NULL OR p.point < l.nxt) WHERE l.score IS NOT NULL)"""

# name -> (CTEs needed, statement)
_QUERIES: dict[str, tuple[str, str]] = {
    "load_csv_coerced": (
        "score_rows",
        """SELECT menage_ano, score_id_ano, ' ' || type_demande AS type_demande, score_corrige,
        CASE WHEN score_id_ano % 13 <> 0 THEN score_calcule END AS score_calcule,
        CASE WHEN score_id_ano % 17 <> 0 THEN date_calcul END AS date_calcul FROM score_rows""",
    ),
    "coerce_types": (
        "",
        """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderkey END AS VARCHAR) AS n,
        CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderkey::DOUBLE WHEN o_orderkey % 4 = 2 THEN o_orderkey + 0.5::DOUBLE END AS x,
        CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS b,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders""",
    ),
    "load_csv_quoted": ("benef", """SELECT * REPLACE ('dit "' || motif || '", puis non' AS motif) FROM benef"""),
    "load_csv_mixed_headers": (
        "score_rows",
        "SELECT * REPLACE (CASE WHEN score_id_ano % 2 = 0 THEN score_corrige END AS score_corrige) FROM score_rows",
    ),
    "load_csv_utf8": (
        "",
        r"SELECT doc_id, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS digest FROM documents",
    ),
    "load_csv_line_breaks": ("", "SELECT doc_id, md5(text) AS digest FROM documents"),
    "parquet_scores": ("score_rows", "SELECT * FROM score_rows"),
    "job_snapshots": (
        "menage programmes benef master delta churn",
        """SELECT 'raw_menage' AS fichier, COUNT(*) AS lignes FROM menage
        UNION ALL SELECT 'raw_programmes', COUNT(*) FROM programmes
        UNION ALL SELECT 'raw_beneficiaire', COUNT(*) FROM benef
        UNION ALL SELECT 'master_events', COUNT(*) FROM master
        UNION ALL SELECT 'delta_frame', COUNT(*) FROM delta
        UNION ALL SELECT 'churn_timeline', COUNT(*) FROM churn""",
    ),
    "load_csv_stray_quotes": (
        "benef",
        """SELECT menage_ano, partner_id, date_insert, CASE menage_ano % 4 WHEN 0 THEN 'dit "' || motif || '"'
        WHEN 1 THEN motif || '"' WHEN 2 THEN '5" de "' || motif ELSE motif END AS motif, CAST(NULL AS BOOLEAN) AS actif FROM benef""",
    ),
    "load_csv_missing_words": (
        "benef",
        "SELECT * REPLACE (CASE WHEN menage_ano % 3 <> 0 THEN motif END AS motif) FROM benef",
    ),
    "load_households": (
        "menage",
        """SELECT menage_ano, milieu, region_id, region, province_id, province, commune_id, commune, type_menage,
        taille_menage, etat_matrimonial_cm, sexe_id, date_naissance_cm,
        CASE WHEN menage_ano % 7 IN (0, 2, 4) THEN 'Homme' ELSE 'Femme' END AS genre_cm FROM menage""",
    ),
    "load_scores": (
        "clean_copies",
        f"""SELECT {_SCORE_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY score_id_ano ORDER BY line_no) AS k
        FROM clean_copies) WHERE k = 1""",
    ),
    "score_postprocess": ("scores", "SELECT * FROM scores"),
    "merge_score_files": (
        "clean_copies",
        f"""SELECT {_SCORE_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY score_id_ano
        ORDER BY date_calcul DESC, score_final DESC) AS k FROM clean_copies) WHERE k = 1""",
    ),
    "load_programme": ("programmes", "SELECT * FROM programmes WHERE programme = 'AMOT'"),
    "union_programmes": ("programmes", "SELECT * FROM programmes"),
    "load_beneficiaries": ("benef", "SELECT * FROM benef"),
    "frame_map_load": (
        "menage",
        "SELECT milieu, COUNT(*) AS n_events FROM orders JOIN menage ON o_custkey = menage_ano GROUP BY 1",
    ),
    "snapshot_roundtrip": (
        "master",
        f"""SELECT programme, milieu, COUNT(*) FILTER (WHERE eligible) AS eligible, COUNT(*) AS total,
        {r('COUNT(*) FILTER (WHERE eligible) * 1.0::DOUBLE / COUNT(*) * 100', 1)} AS pct_eligible FROM master GROUP BY 1, 2""",
    ),
    "dedup_keep_first": (
        "clean_copies",
        """SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY score_id_ano ORDER BY line_no) AS k
        FROM clean_copies) WHERE k = 1""",
    ),
    "dedup_subset": (
        "clean_copies",
        """SELECT * EXCLUDE (k, score_id_ano) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY menage_ano, date_calcul,
        type_demande, score_corrige, score_calcule ORDER BY line_no) AS k FROM clean_copies) WHERE k = 1""",
    ),
    "dedup_keep_latest": (
        "clean_copies",
        f"""SELECT {_SCORE_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY score_id_ano
        ORDER BY date_calcul DESC, score_final DESC) AS k FROM clean_copies) WHERE k = 1""",
    ),
    "repair_text": (
        "",
        f"""SELECT doc_id, CAST(LENGTH({_repaired('text')}) AS BIGINT) AS n_chars, MD5({_repaired('text')}) AS digest
        FROM documents""",
    ),
    "master_events": ("master", "SELECT * FROM master"),
    "household_timeline": (
        "events_",
        """SELECT menage_ano, programme, COUNT(score_final) AS n_events,
        ARG_MAX(score_final, (date_calcul, score_id_ano)) AS score_latest,
        ARG_MIN(score_final, (date_calcul, score_id_ano)) AS score_first,
        MIN(score_final) AS score_best, MAX(score_final) AS score_worst, MIN(date_calcul) AS date_first,
        MAX(date_calcul) AS date_last, BOOL_OR(eligible) AS ever_eligible,
        ARG_MAX(eligible, (date_calcul, score_id_ano)) AS currently_eligible,
        ARG_MIN(eligible, (date_calcul, score_id_ano)) AS first_eligible,
        DATESUB('day', MIN(date_calcul), MAX(date_calcul)) AS days_active FROM events_ GROUP BY 1, 2""",
    ),
    "score_deltas": (
        "delta",
        f"SELECT {_DELTA}, {r('delta_distribue', 6)} AS delta_distribue FROM delta",
    ),
    "programme_frame": ("master", "SELECT * FROM master WHERE programme = 'AMOT'"),
    "events_with_benef": (
        "events_ benef",
        """SELECT e.menage_ano, date_calcul, score_id_ano, programme, score_final, eligible,
        partner_id AS beneficiaire_partner_id, motif AS beneficiaire_motif, date_insert AS beneficiaire_date_insert,
        actif AS beneficiaire_actif FROM events_ e LEFT JOIN benef b ON e.menage_ano = b.menage_ano
        WHERE date_insert IS NULL OR date_insert <= date_calcul""",
    ),
    "pivot_scores": ("events_", _pivot("last")),
    "pivot_scores_mean": ("events_", _pivot("mean")),
    "volatility_summary": (
        "delta",
        f"""SELECT programme, region, COUNT(*) AS n, {r('AVG("delta_ISE")', 6)} AS mean_delta,
        {r('STDDEV("delta_ISE")', 6)} AS sigma_delta, {r(q('"delta_ISE"', 0.25), 6)} AS p25,
        {r('MEDIAN("delta_ISE")', 6)} AS median, {r(q('"delta_ISE"', 0.75), 6)} AS p75,
        {r(q('abs_delta', 0.9), 6)} AS p90_abs FROM delta WHERE region IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 3""",
    ),
    "eligibility_churn": (
        "delta",
        f"""SELECT programme, milieu, n_transitions, n_entrees, n_sorties, stock_moyen,
        CASE WHEN stock_moyen > 0 THEN {r('(n_entrees + n_sorties) / stock_moyen', 6)} END AS churn_eligibilite FROM (
        SELECT programme, milieu, COUNT(*) AS n_transitions, COUNT(*) FILTER (WHERE status_change = 'gained') AS n_entrees,
        COUNT(*) FILTER (WHERE status_change = 'lost') AS n_sorties,
        (COUNT(*) FILTER (WHERE side_avant = 'eligible') + COUNT(*) FILTER (WHERE side_apres = 'eligible')) / 2.0::DOUBLE AS stock_moyen
        FROM delta WHERE milieu IS NOT NULL GROUP BY 1, 2)""",
    ),
    "household_trajectory": ("traj_status", "SELECT * FROM traj_status"),
    "score_timeseries": ("series", "SELECT * FROM series"),
    "score_timeseries_parts": ("series", "SELECT * FROM series"),
    "timeseries_seed": (
        "",
        "",
    ),
    "score_timeseries_dims": (
        "alive_dims",
        f"""SELECT point AS date_calcul, CASE WHEN dim = 'milieu' THEN member END AS milieu,
        CASE WHEN dim = 'region' THEN member END AS region, CASE WHEN dim = 'genre_cm' THEN member END AS genre_cm,
        COUNT(*) AS n_menages, {r('AVG(score)', 6)} AS score_mean, {r('MEDIAN(score)', 6)} AS score_median,
        CASE WHEN dim = 'all' THEN {r('STDDEV_POP(score)', 6)} ELSE {r('STDDEV_SAMP(score)', 6)} END AS score_std,
        {r('MIN(score)', 6)} AS score_min, {r('MAX(score)', 6)} AS score_max,
        {r(q('score', 0.1), 6)} AS score_p10, {r(q('score', 0.25), 6)} AS score_p25,
        {r(q('score', 0.75), 6)} AS score_p75, {r(q('score', 0.9), 6)} AS score_p90
        FROM alive_dims WHERE dim = 'all' OR member IS NOT NULL GROUP BY point, dim, member
        HAVING dim = 'all' OR COUNT(*) >= 2""",
    ),
    "monthly_flows": (
        "events_",
        """SELECT month AS date, COUNT(*) FILTER (WHERE flag) AS unique_menages_eligible,
        COUNT(*) FILTER (WHERE NOT flag) AS unique_menages_not_eligible,
        COUNT(*) FILTER (WHERE flag AND NOT was) AS menages_became_eligible,
        COUNT(*) FILTER (WHERE NOT flag AND was) AS menages_became_ineligible,
        COUNT(*) FILTER (WHERE flag <> was) AS n_transitions
        FROM (SELECT *, COALESCE(LAG(flag) OVER (PARTITION BY menage_ano ORDER BY month), FALSE) AS was FROM (
              SELECT menage_ano, DATE_TRUNC('month', date_calcul) AS month,
                     ARG_MAX(eligible, (date_calcul, programme, score_id_ano)) AS flag FROM events_ GROUP BY 1, 2))
        GROUP BY 1""",
    ),
    "beneficiary_flows": ("benef_flow", "SELECT * FROM benef_flow"),
    "churn_timeline": (
        "churn",
        f"""SELECT date, programme, pool_start, pool_end, entries, exits,
        {r('exits / NULLIF(pool_start, 0)::DOUBLE', 6)} AS churn_rate,
        {r('entries / NULLIF(pool_start, 0)::DOUBLE', 6)} AS acquisition_rate,
        {r('(entries - exits) / NULLIF(pool_start, 0)::DOUBLE', 6)} AS net_rate FROM churn""",
    ),
    "reentry_detail": ("reentry", "SELECT * FROM reentry"),
    "reentry_summary": ("reentry_sum", "SELECT * FROM reentry_sum"),
    "near_threshold_ts": ("near", "SELECT * FROM near"),
    "near_threshold_custom": ("near_alive", near_sql((0.05, 0.20, 1.0))),
    "qc_no_score": (
        "scores",
        """SELECT menage_ano FROM (SELECT c_custkey AS menage_ano FROM customer
             UNION ALL SELECT CAST(s_suppkey + 1000000000 AS BIGINT) FROM supplier)
           WHERE menage_ano NOT IN (SELECT menage_ano FROM scores)""",
    ),
    "programme_rows": ("programmes", "SELECT programme, COUNT(*) AS n_rows FROM programmes GROUP BY 1"),
    "volume_kpis": (
        "scores delta",
        """SELECT (SELECT COUNT(*) FROM scores) AS n_score_events, (SELECT COUNT(*) FROM customer) AS n_menages,
        (SELECT COUNT(*) FROM delta) AS n_transitions, (SELECT COUNT(DISTINCT menage_ano) FROM scores) AS n_menages_uniq""",
    ),
    "qc_dupes": (
        "copies",
        """SELECT (SELECT COUNT(*) - COUNT(DISTINCT score_id_ano) FROM copies) AS qc_score_dupes,
        (SELECT COUNT(*) FROM customer WHERE c_custkey % 25 = 0) AS qc_menage_dupes""",
    ),
    "score_period": (
        "scores",
        """SELECT MIN(date_calcul) AS date_min, MAX(date_calcul) AS date_max,
        DATESUB('day', MIN(date_calcul), MAX(date_calcul)) AS jours FROM scores""",
    ),
    "qc_aberrant": (
        "events_",
        """SELECT GREATEST((SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM events_), 0) AS qc_aberrant_scores""",
    ),
    "qc_blank_fields": (
        "menage",
        """SELECT COUNT(*) FILTER (WHERE region IS NULL OR TRIM(region) = '') AS qc_null_region,
        COUNT(*) FILTER (WHERE milieu IS NULL OR TRIM(milieu) = '') AS qc_null_milieu FROM menage""",
    ),
    "radiated_households": (
        "traj_status",
        "SELECT COUNT(*) AS n_radiated FROM traj_status WHERE est_radie AND statut_actuel = 'radiation'",
    ),
    "trajectory_status": (
        "traj_status",
        f"""SELECT statut_actuel AS code, COUNT(*) AS n_menages, {_status('statut_actuel', _TRAJ)} AS statut
        FROM traj_status GROUP BY 1""",
    ),
    "households_by_programme": (
        "events_",
        f"""SELECT programme, COUNT(DISTINCT menage_ano) AS n_menages, {_status('programme', _PROG)} AS nom_complet
        FROM events_ WHERE programme <> 'NON CLASSIFIE' GROUP BY 1""",
    ),
    "unclassified_households": (
        "events_",
        "SELECT COUNT(DISTINCT menage_ano) AS n_non_classifie FROM events_ WHERE programme = 'NON CLASSIFIE'",
    ),
    "demog_milieu": _counts("milieu"),
    "demog_genre": _counts("genre_cm"),
    "demog_matrimonial": _counts("etat_matrimonial_cm"),
    "demog_region": _counts("region"),
    "demog_type": _counts("type_menage"),
    "household_size": ("sizes", "SELECT * FROM sizes"),
    "top_provinces": (
        "menage",
        "SELECT province, COUNT(*) AS n_menages FROM menage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "demog_mode_share": (
        "menage",
        " UNION ALL ".join(_mode(c) for c in ("milieu", "genre_cm", "type_menage")),
    ),
    "mean_household_size": (
        "menage",
        f"SELECT {r('SUM(taille_menage)::DOUBLE / COUNT(taille_menage)', 4)} AS taille_moyenne FROM menage",
    ),
    "region_coverage": (
        "menage",
        f"""SELECT rang, region, n_menages, {r('cumul / total::DOUBLE * 100', 4)} AS pct_cumul FROM (
        SELECT region, n_menages, ROW_NUMBER() OVER w AS rang, CAST(SUM(n_menages) OVER w AS BIGINT) AS cumul,
               CAST(SUM(n_menages) OVER () AS BIGINT) AS total
        FROM (SELECT region, COUNT(*) AS n_menages FROM menage GROUP BY 1)
        WINDOW w AS (ORDER BY n_menages DESC, region NULLS LAST ROWS UNBOUNDED PRECEDING))
        WHERE (cumul - n_menages) / total::DOUBLE < 0.70""",
    ),
    "score_stats": (
        "events_",
        f"""SELECT programme, COUNT(*) AS n_events, {r('AVG(score_final)', 4)} AS moyenne,
        {r('MEDIAN(score_final)', 4)} AS mediane, {r('STDDEV(score_final)', 4)} AS ecart_type,
        {r('MIN(score_final)', 4)} AS min, {r('MAX(score_final)', 4)} AS max FROM events_ GROUP BY 1""",
    ),
    "score_hist": (
        "events_",
        "SELECT programme, ROUND(score_final * 20) / 20 AS bin, COUNT(*) AS n FROM events_ GROUP BY 1, 2",
    ),
    "near_counts": (
        "events_",
        """SELECT COUNT(*) FILTER (WHERE "near_0.10") AS n_near_10, COUNT(*) FILTER (WHERE "near_0.25") AS n_near_25 FROM events_""",
    ),
    "eligibility_global": (
        "events_",
        f"""SELECT COUNT(*) FILTER (WHERE eligible) AS n_eligible, COUNT(*) FILTER (WHERE NOT eligible) AS n_not_eligible,
        {r('COUNT(*) FILTER (WHERE eligible) / COUNT(*)::DOUBLE * 100', 1)} AS pct_eligible FROM events_""",
    ),
    "elig_by_programme": (
        "events_",
        f"""SELECT programme, COUNT(*) FILTER (WHERE eligible) AS eligible, COUNT(*) AS total,
        {r('COUNT(*) FILTER (WHERE eligible) / COUNT(*)::DOUBLE * 100', 1)} AS pct_eligible FROM events_ GROUP BY 1""",
    ),
    "elig_by_region": (
        "master",
        f"""SELECT region, {r('COUNT(*) FILTER (WHERE eligible) / COUNT(*)::DOUBLE * 100', 1)} AS pct_eligible
        FROM master WHERE region IS NOT NULL GROUP BY 1""",
    ),
    "elig_by_milieu": (
        "master",
        f"""SELECT programme, milieu, {r('COUNT(*) FILTER (WHERE eligible) / COUNT(*)::DOUBLE * 100', 1)} AS pct_eligible
        FROM master WHERE milieu IS NOT NULL GROUP BY 1, 2""",
    ),
    "request_types": ("events_", "SELECT type_demande, COUNT(*) AS n_events FROM events_ GROUP BY 1"),
    "delta_global": (
        "delta",
        f"""SELECT {r('AVG("delta_ISE")', 4)} AS mean, {r('STDDEV("delta_ISE")', 4)} AS std,
        {r(q('abs_delta', 0.9), 4)} AS p90, {r(q('abs_delta', 0.99), 4)} AS p99 FROM delta""",
    ),
    "volatility_programme": (
        "delta",
        f"""SELECT programme, COUNT(*) AS n, {r('AVG("delta_ISE")', 4)} AS mean_delta,
        {r('STDDEV("delta_ISE")', 4)} AS sigma_delta, {r(q('abs_delta', 0.9), 4)} AS p90 FROM delta GROUP BY 1""",
    ),
    "volatility_region": (
        "delta",
        f"""SELECT programme, region, {r('AVG("delta_ISE")', 4)} AS mean_delta,
        {r('STDDEV("delta_ISE")', 4)} AS sigma_delta FROM delta WHERE region IS NOT NULL GROUP BY 1, 2""",
    ),
    "volatility_heatmap": (
        "delta",
        "SELECT region, "
        + ", ".join(
            f"""{r(f'''AVG("delta_ISE") FILTER (WHERE programme = '{p}')''', 4)} AS "{p}" """
            for p in ("AMOT", "ASD", "AMOA", "NON CLASSIFIE")
        )
        + " FROM delta WHERE region IS NOT NULL GROUP BY 1",
    ),
    "delta_box": (
        "delta",
        f"""SELECT programme, {r(q('"delta_ISE"', 0.1), 4)} AS p10, {r(q('"delta_ISE"', 0.25), 4)} AS q1,
        {r('MEDIAN("delta_ISE")', 4)} AS median, {r(q('"delta_ISE"', 0.75), 4)} AS q3,
        {r(q('"delta_ISE"', 0.9), 4)} AS p90, {r('AVG("delta_ISE")', 4)} AS mean FROM delta GROUP BY 1""",
    ),
    "adj_delta_global": ("delta", _adjusted("")),
    "adj_delta_programme": (
        "delta",
        f"SELECT * EXCLUDE (n_short_gap_excluded, min_val, max_val) FROM ({_adjusted('programme')})",
    ),
    "adj_delta_milieu": ("delta", _adjusted_by("milieu")),
    "adj_delta_genre": ("delta", _adjusted_by("genre_cm")),
    "gap_buckets": (
        "delta",
        """SELECT CASE WHEN days_between <= 30 THEN '1–30 j (exclu)' WHEN days_between <= 60 THEN '31–60 j (exclu)'
        WHEN days_between <= 90 THEN '61–90 j (exclu)' WHEN days_between <= 180 THEN '91–180 j' ELSE '> 180 j' END AS bucket,
        COUNT(*) AS n, MIN(days_between) AS shortest FROM delta GROUP BY 1""",
    ),
    "delta_sample": (
        "delta",
        f"""SELECT menage_ano, score_id_ano, days_between, "delta_ISE", {r('delta_distribue', 6)} AS delta_distribue, programme
        FROM delta WHERE delta_distribue IS NOT NULL
        ORDER BY MD5(menage_ano || '-' || score_id_ano || '-' || programme), menage_ano, score_id_ano LIMIT 5000""",
    ),
    "adj_delta_monthly": (
        "delta",
        f"""SELECT DATE_TRUNC('month', date_apres) AS month, programme, {r('AVG(delta_distribue)', 6)} AS mean_dd,
        {r('MEDIAN(delta_distribue)', 6)} AS median_dd, {r('STDDEV(delta_distribue)', 6)} AS std_dd, COUNT(*) AS n
        FROM delta WHERE delta_distribue IS NOT NULL GROUP BY 1, 2""",
    ),
    "adj_delta_coverage": (
        "delta",
        f"""SELECT n_total, n_valid, n_short_gap_excluded, {r('n_valid / n_total::DOUBLE * 100', 4)} AS pct_valid
        FROM ({_adjusted('')})""",
    ),
    "status_counts": (
        "delta",
        f"""SELECT status_change AS code, COUNT(*) AS n_transitions, {_status('status_change', _CHANGE)} AS statut
        FROM delta GROUP BY 1""",
    ),
    "status_by_region": (
        "delta",
        f"""SELECT region, status_change, COUNT(*) AS n_transitions, {_status('status_change', _CHANGE)} AS statut
        FROM delta WHERE status_change <> 'stable' AND region IS NOT NULL GROUP BY 1, 2""",
    ),
    "churn_programme": ("delta", _churn_parts("programme", "")),
    "churn_region": (
        "delta",
        _churn_parts("programme, region", "WHERE programme IN ('AMOT', 'ASD') AND region IS NOT NULL"),
    ),
    "weekly_volatility": ("vol_weekly", "SELECT * FROM vol_weekly"),
    "weekly_abs_delta": ("abs_weekly", "SELECT * FROM abs_weekly"),
    "weekly_joined": (
        "vol_weekly abs_weekly",
        "SELECT v.*, a.* EXCLUDE (week, n_menages) FROM vol_weekly v LEFT JOIN abs_weekly a ON v.week = a.week",
    ),
    "weekly_vol_kpis": (
        "vol_weekly abs_weekly",
        f"""SELECT {r('AVG(sigma_delta)', 4)} AS overall_sigma, {r('MAX(sigma_delta)', 4)} AS peak_sigma,
        STRFTIME(ARG_MAX(v.week, (sigma_delta, -EPOCH(v.week))) FILTER (WHERE sigma_delta IS NOT NULL), '%d/%m/%Y') AS peak_week,
        {r('AVG(mean_abs_delta)', 4)} AS overall_abs, CAST(SUM(v.n_menages) AS BIGINT) AS total_menages, COUNT(*) AS n_weeks
        FROM vol_weekly v LEFT JOIN abs_weekly a ON v.week = a.week
        WHERE v.week BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""",
    ),
    "score_ts_weekly": ("ts_weekly", "SELECT * FROM ts_weekly"),
    "score_ts_region": ("master", _ts_by("region")),
    "score_ts_milieu": ("master", _ts_by("milieu")),
    "score_ts_segment": ("master", _ts_by("milieu", "AND milieu IN ('Urbain')")),
    "score_ts_genre": ("master", _ts_by("genre_cm")),
    "score_trend": (
        "ts_weekly",
        f"""SELECT trend, CASE WHEN trend < 0 THEN 'good' ELSE 'warn' END AS classe FROM (
        SELECT {r('ARG_MAX(score_mean, date_calcul) - ARG_MIN(score_mean, date_calcul)', 6)} AS trend FROM ts_weekly)""",
    ),
    "score_band": (
        "ts_weekly",
        f"""SELECT date_calcul, score_mean, {r('score_mean - score_std', 6)} AS band_low,
        {r('score_mean + score_std', 6)} AS band_high FROM ts_weekly""",
    ),
    "near_latest": (
        "near",
        "SELECT n.* FROM near n JOIN (SELECT programme, MAX(week) AS week FROM near GROUP BY 1) l USING (programme, week)",
    ),
    "near_share": (
        "near",
        f"SELECT week, programme, n_total, {', '.join(_NEAR_COUNTS)}, "
        + ", ".join(f"{r(f'{c} / n_total::DOUBLE * 100', 2)} AS pct_{c}" for c in _NEAR_COUNTS)
        + " FROM near",
    ),
    "beneficiary_stats": (
        "benef",
        """SELECT COUNT(*) AS n_total, COUNT(DISTINCT menage_ano) AS n_uniq, COUNT(*) FILTER (WHERE actif) AS n_actif FROM benef""",
    ),
    "beneficiary_kpis": (
        "benef_flow",
        """SELECT programme, MAX(unique_menages_eligible) AS max_eligible, MAX(unique_menages_not_eligible) AS max_not_eligible,
        STRFTIME(ARG_MAX(date, (unique_menages_eligible, -EPOCH(date))), '%Y-%m') AS mois_max_eligible,
        STRFTIME(ARG_MAX(date, (unique_menages_not_eligible, -EPOCH(date))), '%Y-%m') AS mois_max_not_eligible,
        CAST(SUM(menages_became_eligible) AS BIGINT) AS became_eligible,
        CAST(SUM(menages_became_ineligible) AS BIGINT) AS became_ineligible FROM benef_flow GROUP BY 1""",
    ),
    "reentry_stats": (
        "reentry",
        f"""SELECT programme, COUNT(*) AS total_menages, COUNT(*) FILTER (WHERE n_reentries > 0) AS n_avec_reentree,
        {r('COUNT(*) FILTER (WHERE n_reentries > 0) / COUNT(*)::DOUBLE * 100', 1)} AS pct_avec_reentree,
        MAX(n_reentries) AS max_reentrees,
        {r('AVG(n_reentries) FILTER (WHERE n_reentries > 0)', 2)} AS avg_reentrees_parmi_churners FROM reentry GROUP BY 1""",
    ),
    "reentry_buckets": (
        "reentry_sum",
        f"""SELECT programme, label, ordre, CAST(SUM(n_menages) AS BIGINT) AS n_menages, {r('SUM(pct_menages)', 2)} AS pct_menages
        FROM (SELECT *, CASE n_reentries WHEN 'toujours éligible' THEN -3 WHEN 'jamais éligible' THEN -2
              WHEN 'perdu sans retour' THEN -1 ELSE LEAST(TRY_CAST(n_reentries AS INTEGER), 5) END AS ordre,
              CASE WHEN TRY_CAST(n_reentries AS INTEGER) >= 5 THEN '5+' ELSE n_reentries END AS label FROM reentry_sum)
        GROUP BY 1, 2, 3""",
    ),
    "churn_table": (
        "churn",
        f"""SELECT STRFTIME(date, '%Y-%m') AS mois, programme, pool_start, pool_end, entries, exits,
        {r('exits / NULLIF(pool_start, 0)::DOUBLE * 100', 2)} AS churn_rate_pct,
        {r('entries / NULLIF(pool_start, 0)::DOUBLE * 100', 2)} AS acquisition_rate_pct,
        {r('(entries - exits) / NULLIF(pool_start, 0)::DOUBLE * 100', 2)} AS net_rate_pct
        FROM churn WHERE programme IN ('AMOT', 'ASD')""",
    ),
    "coverage_ratios": (
        "programmes events_",
        f"""SELECT p.programme, n_rows, n AS n_menages, {r('n / n_rows::DOUBLE * 100', 4)} AS pct_match
        FROM (SELECT programme, COUNT(*) AS n_rows FROM programmes GROUP BY 1) p
        LEFT JOIN (SELECT programme, COUNT(DISTINCT menage_ano) AS n FROM events_ GROUP BY 1) e ON p.programme = e.programme""",
    ),
    "records_per_beneficiary": (
        "benef",
        f"""SELECT COUNT(*) AS n_total, COUNT(DISTINCT menage_ano) AS n_uniq,
        {r('COUNT(*) / COUNT(DISTINCT menage_ano)::DOUBLE', 1)} AS avg_records FROM benef""",
    ),
    "household_history": ("history", "SELECT * FROM history"),
    "household_profile": (
        "menage",
        """SELECT menage_ano, region, province, commune, milieu, genre_cm, type_menage, taille_menage,
        etat_matrimonial_cm, date_naissance_cm FROM menage""",
    ),
    "household_latest": (
        "events_",
        """SELECT menage_ano, programme, ARG_MAX(score_final, (date_calcul, score_id_ano)) AS score_final_corrige,
        ARG_MAX(eligible, (date_calcul, score_id_ano)) AS eligible FROM events_ GROUP BY 1, 2""",
    ),
    "household_drift": (
        "events_",
        f"""SELECT menage_ano, drift, CASE WHEN drift < 0 THEN 'Amélioration' WHEN drift > 0 THEN 'Dégradation'
        ELSE 'Stable' END AS tendance FROM (SELECT menage_ano,
        {r('''ARG_MAX(score_final, (date_calcul, programme, score_id_ano))
              - ARG_MIN(score_final, (date_calcul, programme, score_id_ano))''', 4)} AS drift FROM events_ GROUP BY 1)""",
    ),
    "household_events_labelled": (
        "history",
        f"""SELECT menage_ano, score_id_ano, STRFTIME(date_calcul, '%d/%m/%Y') AS date, programme,
        {_status('canal', _CHANNEL)} AS canal, score_final_corrige, score_calcule, delta_ise,
        CASE WHEN eligible THEN 'Oui' ELSE 'Non' END AS eligible, dist_threshold,
        CASE WHEN was_corrected THEN 'Oui' ELSE 'Non' END AS was_corrected FROM history""",
    ),
    "calculations_chain": (
        "events_",
        f"""SELECT programme, COUNT(*) AS n_menages, {r('AVG(s)', 4)} AS score_moyen FROM (
        SELECT programme, menage_ano, ARG_MAX(score_final, (date_calcul, score_id_ano)) AS s FROM events_ GROUP BY 1, 2)
        GROUP BY 1""",
    ),
    "kpi_callable": ("events_", "SELECT type_demande, COUNT(*) AS n_events FROM events_ GROUP BY 1"),
    "kpi_sql": (
        "events_",
        """SELECT programme, COUNT(*) AS n_events, COUNT(DISTINCT menage_ano) AS n_menages FROM events_
        WHERE score_final <= 12 GROUP BY 1""",
    ),
}


def _chain(names: list[str]) -> list[str]:
    """CTE names in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _with(needs: str, body: str, extra: str = "") -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in _chain(needs.split())]
    parts += [extra] if extra else []
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def statements() -> dict[str, str]:
    """SQL per query name."""
    out = {name: _with(needs, body) for name, (needs, body) in _QUERIES.items() if body}
    out["timeseries_seed"] = _with(
        "seeded",
        """SELECT menage_ano, eff AS start, nxt AS stop, score FROM (
             SELECT *, LEAD(eff) OVER (PARTITION BY menage_ano ORDER BY eff) AS nxt FROM (
               SELECT menage_ano, eff, ARG_MAX(pack, (date_calcul, score_id_ano)).s AS score FROM (
                 SELECT *, {'s': score} AS pack, CASE WHEN DATE_TRUNC('week', date_calcul) = date_calcul THEN date_calcul
                        ELSE DATE_TRUNC('week', date_calcul) + INTERVAL 7 DAY END AS eff FROM seeded)
               GROUP BY 1, 2))
           WHERE score IS NOT NULL AND eff <= (SELECT DATE_TRUNC('week', MAX(date_calcul)) FROM seeded)""",
    )
    out["score_timeseries_daily"] = _with(
        "",
        f"""SELECT point AS date_calcul, CAST(NULL AS VARCHAR) AS milieu, CAST(NULL AS VARCHAR) AS region,
            CAST(NULL AS VARCHAR) AS genre_cm, COUNT(*) AS n_menages, {r('AVG(score)', 6)} AS score_mean,
            {r('MEDIAN(score)', 6)} AS score_median, {r('STDDEV_POP(score)', 6)} AS score_std,
            {r('MIN(score)', 6)} AS score_min, {r('MAX(score)', 6)} AS score_max,
            {r(q('score', 0.1), 6)} AS score_p10, {r(q('score', 0.25), 6)} AS score_p25,
            {r(q('score', 0.75), 6)} AS score_p75, {r(q('score', 0.9), 6)} AS score_p90 FROM a GROUP BY point""",
        _DENSE,
    )
    out["qc_summary"] = _with(
        "clean_copies programmes",
        _QC_LINES,
        """kept AS (SELECT DISTINCT score_id_ano FROM clean_copies),
        kept_h AS (SELECT DISTINCT k.menage_ano FROM (SELECT menage_ano, score_id_ano, ROW_NUMBER() OVER (
                PARTITION BY score_id_ano ORDER BY line_no) AS k FROM clean_copies) k WHERE k.k = 1),
        c AS (SELECT (SELECT COUNT(*) FROM copies) AS raw, (SELECT COUNT(*) FROM kept) AS kept,
                (SELECT COUNT(*) FROM copies WHERE COALESCE(score_corrige, score_calcule) > 15) AS over,
                (SELECT COUNT(*) FROM customer) AS h,
                (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM customer WHERE c_custkey % 25 = 0) AS raw_h,
                (SELECT COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT menage_ano FROM kept_h)) AS lonely,
                (SELECT COUNT(*) FROM kept_h) AS seen,
                (SELECT COUNT(*) FROM kept_h WHERE menage_ano NOT IN (SELECT menage_ano FROM programmes)) AS nc)""",
    )
    out["snapshot_inventory"] = _with(
        "menage scores programmes events_ delta",
        """SELECT fichier, CASE fichier WHEN 'raw_menage' THEN 'Données démographiques des ménages'
            WHEN 'raw_scores' THEN 'Événements de score (après nettoyage)'
            WHEN 'master_events' THEN 'Événements enrichis (score + ménage + programme)'
            WHEN 'delta_frame' THEN 'Variations de score entre événements consécutifs (ΔISE)'
            WHEN 'menage_timeline' THEN 'Résumé par ménage et par programme'
            WHEN 'menage_trajectory' THEN 'Trajectoire complète de chaque ménage'
            WHEN 'raw_programmes' THEN 'Listes d''affiliation aux programmes'
            ELSE 'Événements du programme ' || REPLACE(fichier, 'programme_', '') END AS description, lignes FROM (
          SELECT 'raw_menage' AS fichier, COUNT(*) AS lignes FROM menage
          UNION ALL SELECT 'raw_scores', COUNT(*) FROM scores
          UNION ALL SELECT 'raw_programmes', COUNT(*) FROM programmes
          UNION ALL SELECT 'master_events', COUNT(*) FROM events_
          UNION ALL SELECT 'delta_frame', COUNT(*) FROM delta
          UNION ALL SELECT 'menage_timeline', COUNT(*) FROM (SELECT DISTINCT menage_ano, programme FROM events_)
          UNION ALL SELECT 'menage_trajectory', COUNT(DISTINCT menage_ano) FROM events_
          UNION ALL SELECT 'programme_AMOT', COUNT(*) FROM events_ WHERE programme = 'AMOT'
          UNION ALL SELECT 'programme_ASD', COUNT(*) FROM events_ WHERE programme = 'ASD'
          UNION ALL SELECT 'programme_AMOA', COUNT(*) FROM events_ WHERE programme = 'AMOA')""",
    )
    return out
