"""DuckDB SQL for the library's other queries."""

from tidewheel.plans.feature_sql import BASE, queries, t_two_sided

WILD = """WITH w AS (SELECT user_id AS entity_id, event_id AS seq, ts, value AS d, 100 + 25 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rr FROM events)"""
ENT = """WITH per AS (SELECT o_custkey AS entity_id, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_final,
    avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-07-01') AS price_before, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS price_after,
    coalesce(date_diff('day', min(o_orderdate)::DATE, (min(o_orderdate) FILTER (o_orderstatus = 'F'))::DATE), date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)) AS time FROM orders GROUP BY o_custkey),
  x AS (SELECT c_custkey AS entity_id, c_acctbal AS balance, c_mktsegment AS segment, n_orders, n_final, price_before, price_after, time, (coalesce(n_final, 0) > 0)::INT AS event FROM customer LEFT JOIN per ON per.entity_id = c_custkey)"""
UNITS = BASE + """, ids AS (SELECT DISTINCT entity_id FROM e), u AS (SELECT entity_id, floor(t)::INT AS unit, sum(d) AS b FROM e GROUP BY ALL),
  cut AS (SELECT quantile_cont(b, 1/3.0) AS lo, quantile_cont(b, 2/3.0) AS hi FROM u WHERE b > 0),
  s AS (SELECT entity_id, unit, (coalesce(b, 0) >= lo)::INT + (coalesce(b, 0) >= hi)::INT AS state FROM (SELECT entity_id, g::INT AS unit FROM ids, range(0, 30) r(g)) LEFT JOIN u USING (entity_id, unit), cut)"""
PTS = """WITH p AS (SELECT vec_id AS entity_id, label AS cluster, embedding::DOUBLE[] AS f FROM embeddings),
  l AS (SELECT entity_id, cluster, unnest(f) AS v, unnest(range(1, 65)) AS pos FROM p), ce AS (SELECT cluster, pos, avg(v) AS m, count(*) AS n, var_pop(v) AS vv FROM l GROUP BY ALL)"""


def _r(select: str, keys: str = "", digits: int = 6) -> str:
    """Round all but the keys."""
    except_ = f"EXCLUDE ({keys})" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}round(COLUMNS(* {except_})::DOUBLE, {digits}) + 0.0 FROM ({select}) q"


def _long(x: str, columns: tuple[str, ...], keep: str = "entity_id") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS v FROM {x}" for c in columns)


RATE = "SELECT entity_id, g::INT AS pos, g * 3.0 AS time, coalesce(s, 0) / 3.0 AS value FROM (SELECT entity_id, g FROM (SELECT DISTINCT entity_id FROM e WHERE t <= 30), range(0, 10) r(g)) LEFT JOIN (SELECT entity_id, least(floor(t / 3), 9) AS g, sum(d) AS s FROM e WHERE t <= 30 GROUP BY ALL) USING (entity_id, g)"
RANKS = "rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2"

#: Closed forms for four degrees of freedom, as there are five segments: the tails of chi-square and of F(4, d).
CHI4 = "exp(-statistic / 2) * (1 + statistic / 2)"
F4 = "power({d} / ({d} + 4 * {f}), {d} / 2) * (1 + {d} / 2 * (1 - {d} / ({d} + 4 * {f})))"

SQL: dict[str, str] = {
    "clean_report": WILD + ", k AS (SELECT *, CASE WHEN d < 0 THEN 'n' WHEN d = 0 THEN 'z' WHEN d < 2 THEN 's' WHEN d > 10080 THEN 'l' WHEN ts IS NULL THEN 't' WHEN rr < 200 OR rr > 2000 THEN 'r' END AS why FROM w) "
    + _r("SELECT count(*) AS n_original, count(*) FILTER (why IS NULL) AS n_kept, count(*) FILTER (why = 'n') AS n_negative, count(*) FILTER (why = 'z') AS n_zero, count(*) FILTER (why = 's') AS n_too_short, count(*) FILTER (why = 'l') AS n_too_long, count(*) FILTER (why = 't') AS n_no_start, count(*) FILTER (why = 'r') AS n_rate, 0 AS n_overlap, 100.0 * count(*) FILTER (why IS NULL) / count(*) AS retention_pct, count(DISTINCT entity_id) FILTER (why IS NOT NULL) AS n_entities_affected FROM k"),
    "clean_without_overlaps": WILD + ", k AS (SELECT * FROM w WHERE d > 0 AND d <= 10080 AND rr BETWEEN 200 AND 2000), o AS (SELECT *, epoch_us(lag(ts) OVER p) + round(lag(d) OVER p * 60e6)::BIGINT > epoch_us(ts) AS bad FROM k WINDOW p AS (PARTITION BY entity_id ORDER BY ts, seq)) "
    + _r("SELECT entity_id, count(*) AS n, sum(d) AS total FROM o WHERE NOT coalesce(bad, false) GROUP BY entity_id", "entity_id"),
    "validity_by_entity": WILD + ", k AS (SELECT *, d > 10 AND d <= 240 AND ts IS NOT NULL AND (rr IS NULL OR rr BETWEEN 200 AND 2000) AS ok FROM w) "
    + _r("SELECT entity_id, count(*) AS n_events, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid, sum(d) AS total_duration, avg(d) AS mean_duration, max(d) AS max_duration, 100.0 * count(*) FILTER (ok) / count(*) AS pct_valid FROM k GROUP BY entity_id", "entity_id"),
    "window_counts": BASE + _r("SELECT CASE WHEN t < 7 THEN '0-7d' WHEN t < 14 THEN '7-14d' WHEN t < 21 THEN '14-21d' WHEN t < 30 THEN '21-30d' ELSE 'other' END AS \"window\", count(*) AS n, sum(d) AS total FROM e GROUP BY 1", '"window"', 4),
    "duration_bins": BASE + "SELECT CASE WHEN d > 0 THEN (d > 0)::INT + (d > 2)::INT + (d > 6)::INT + (d > 60)::INT + (d > 1440)::INT + (d > 10080)::INT END AS bin, count(*) AS n FROM e GROUP BY 1",
    "follow_up": BASE + _r("SELECT entity_id, min(t) AS first_day, max(t) AS last_day, count(*) AS n_events, max(t) - min(t) AS span_days, max(t) AS follow_up_days FROM e GROUP BY entity_id", "entity_id"),
    "daily_burden": BASE + _r("SELECT entity_id, floor(t)::INT AS day, sum(d) AS value FROM e GROUP BY ALL", "entity_id, day"),
    "cumulative_burden": BASE + _r("SELECT entity_id, seq, cum AS cum_minutes, cum / 60 AS cum_hours, cum / 1440 AS cum_days FROM e", "entity_id, seq", 9),
    "entity_join": ENT + ", b AS (SELECT user_id AS entity_id, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1) " + _r("SELECT b.*, balance, n_orders, n_final FROM b LEFT JOIN x USING (entity_id)", "entity_id"),
    "id_overlap": "WITH m AS (SELECT id, max(a) AS a, max(b) AS b, max(c) AS c FROM (SELECT doc_id AS id, 1 AS a, 0 AS b, 0 AS c FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT user_id, 0, 0, 1 FROM events) GROUP BY id) SELECT sum(a)::BIGINT AS n_documents, sum(b)::BIGINT AS n_labels, sum(c)::BIGINT AS n_events, count(*) FILTER (a + b = 2) AS n_documents_and_labels, count(*) FILTER (a + c = 2) AS n_documents_and_events, count(*) FILTER (b + c = 2) AS n_labels_and_events, count(*) FILTER (a = 1 AND b + c = 0) AS n_only_documents, count(*) FILTER (b = 1 AND a + c = 0) AS n_only_labels, count(*) FILTER (c = 1 AND a + b = 0) AS n_only_events, count(*) FILTER (a + b + c = 3) AS n_all, count(*) AS n_any FROM m",
    "cohort_attrition": ENT + ", v AS (SELECT user_id AS entity_id, count(*) AS n FROM events GROUP BY 1) SELECT 'all' AS step, count(*) AS n FROM v UNION ALL SELECT 'enough_events', count(*) FROM v WHERE n >= 60 UNION ALL SELECT 'known_outcome', count(*) FROM v JOIN x USING (entity_id) WHERE n >= 60 AND n_final IS NOT NULL",
    "missing_columns": ENT + " ".join(["", *[_r(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS pct_missing FROM x" for c in ("entity_id", "balance", "segment", "n_orders", "n_final", "price_before", "price_after", "time", "event")), '"column"')]]),
    "describe_entities": ENT + ", l AS (" + _long("x", ("balance", "n_orders", "price_before", "price_after")) + ") " + _r("SELECT feature, count(v) AS n, count(*) - count(v) AS n_missing, 100.0 * (count(*) - count(v)) / count(*) AS pct_missing, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, quantile_cont(v, 0.25) AS p25, median(v) AS median, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM l GROUP BY feature", "feature", 4),
    "segment_frequencies": ENT + _r("SELECT segment AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM x GROUP BY segment", "value"),
    "segment_crosstab": ENT + "SELECT segment, event, count(*) AS n FROM x GROUP BY ALL",
    "price_changes": ENT + _r("SELECT entity_id, price_after - price_before AS change FROM x WHERE price_after - price_before IS NOT NULL", "entity_id", 4),
    "scaled_entities": ENT + ", l AS (" + _long("x", ("balance", "n_orders", "price_before", "price_after")) + "), f AS (SELECT entity_id, l.feature, coalesce(v, m) AS v FROM l JOIN (SELECT feature, median(v) AS m FROM l GROUP BY feature) USING (feature)), k AS (SELECT entity_id, feature, greatest(least(v, hi), lo) AS v FROM f JOIN (SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM f GROUP BY feature) USING (feature)), z AS (SELECT entity_id, feature, (v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature) AS v FROM k) "
    + _r("SELECT entity_id, max(v) FILTER (feature = 'balance') AS balance, max(v) FILTER (feature = 'n_orders') AS n_orders, max(v) FILTER (feature = 'price_before') AS price_before, max(v) FILTER (feature = 'price_after') AS price_after FROM z GROUP BY entity_id", "entity_id"),
    "segment_profile": ENT + ", l AS (" + _long("x", ("balance", "n_orders"), "segment") + "), m AS (SELECT segment, feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM l GROUP BY ALL) " + _r("SELECT *, (mean - avg(mean) OVER w) / stddev_samp(mean) OVER w AS z, (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) AS scaled FROM m WINDOW w AS (PARTITION BY feature)", "segment, feature"),
    "series_rate": BASE + _r(RATE, "entity_id, pos"),
    "series_zscore": BASE + ", sr AS (" + RATE + ") " + _r("SELECT entity_id, pos, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM sr WINDOW w AS (PARTITION BY entity_id)", "entity_id, pos"),
    "series_distances": BASE + ", sr AS (" + RATE + ") " + _r("SELECT x.entity_id AS a, y.entity_id AS b, sqrt(sum(power(x.value - y.value, 2))) AS distance FROM sr x JOIN sr y ON x.pos = y.pos AND x.entity_id < y.entity_id GROUP BY ALL", "a, b"),
    "series_count": BASE + _r("SELECT i.entity_id, g::INT AS pos, g * 3.0 AS time, count(e.t) AS value FROM (SELECT DISTINCT entity_id FROM e WHERE t <= 30) i CROSS JOIN range(0, 11) r(g) LEFT JOIN e ON e.entity_id = i.entity_id AND e.t <= 30 AND ceil(e.t / 3.0) <= g GROUP BY ALL", "entity_id, pos"),
    "series_cumulative": BASE + ", kn AS (SELECT entity_id, t AS x, max(cum) AS y FROM e WHERE t <= 30 GROUP BY ALL UNION ALL SELECT DISTINCT entity_id, 0.0, 0.0 FROM e WHERE t <= 30 UNION ALL SELECT entity_id, 30.0, sum(d) FROM e WHERE t <= 30 GROUP BY entity_id), g AS (SELECT DISTINCT entity_id, g::INT AS pos, g * 30.0 / 9 AS x FROM e, range(0, 10) r(g) WHERE t <= 30), b AS (SELECT g.entity_id, pos, g.x, max(kn.x) FILTER (kn.x <= g.x) AS xa, max(kn.y) FILTER (kn.x <= g.x) AS ya, min(kn.x) FILTER (kn.x >= g.x) AS xb, min(kn.y) FILTER (kn.x >= g.x) AS yb FROM g JOIN kn USING (entity_id) GROUP BY ALL) "
    + _r("SELECT entity_id, pos, x AS time, CASE WHEN xb > xa THEN ya + (yb - ya) * (x - xa) / (xb - xa) ELSE ya END AS value FROM b", "entity_id, pos"),
    "day_curves": ENT.replace("WITH per", BASE.strip() + ", per", 1) + ", dt AS (SELECT i.entity_id, g::INT AS pos, coalesce(sum(e.d), 0) AS value FROM (SELECT DISTINCT entity_id FROM e WHERE t <= 30) i CROSS JOIN range(0, 31) r(g) LEFT JOIN e ON e.entity_id = i.entity_id AND e.t <= g GROUP BY ALL) "
    + _r("SELECT segment, pos, count(*) AS n, avg(value) AS mean, avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)) AS low, avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)) AS high FROM dt JOIN x USING (entity_id) GROUP BY ALL", "segment, pos"),
    "state_sequences": UNITS + "SELECT entity_id, unit, state FROM s",
    "state_transitions": UNITS + ", tr AS (SELECT state, lead(state) OVER (PARTITION BY entity_id ORDER BY unit) AS nx FROM s), c AS (SELECT a::INT AS state, b::INT AS next, count(tr.state) AS n FROM range(0, 3) r(a) CROSS JOIN range(0, 3) q(b) LEFT JOIN tr ON tr.state = a AND tr.nx = b GROUP BY ALL) " + _r("SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END AS p FROM c WINDOW w AS (PARTITION BY state)", "state, next"),
    "state_features": UNITS + ", a AS (SELECT *, lag(state) OVER o AS before, row_number() OVER o - row_number() OVER (PARTITION BY entity_id, state ORDER BY unit) AS isl FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY unit)), ru AS (SELECT entity_id, avg(k) AS mean_run, max(k) AS max_run, count(*) AS n_runs FROM (SELECT entity_id, state, isl, count(*) AS k FROM a GROUP BY ALL) GROUP BY entity_id), c AS (SELECT entity_id, count(*) FILTER (state = 0) / 30 AS p0, count(*) FILTER (state = 1) / 30 AS p1, count(*) FILTER (state = 2) / 30 AS p2, arg_max(state, unit) AS final_state, count(*) FILTER (state <> before) AS n_transitions, count(*) FILTER (state > before) AS n_increases, count(*) FILTER (state < before) AS n_decreases, min(unit) FILTER (state = 2) AS first_high_unit FROM a GROUP BY entity_id), h AS (SELECT *, abs(CASE WHEN p0 > 0 THEN p0 * log2(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * log2(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * log2(p2) ELSE 0 END) AS entropy FROM c) "
    + _r("SELECT entity_id, p0 AS pct_state_0, p1 AS pct_state_1, p2 AS pct_state_2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS dominant_state, greatest(p0, p1, p2) AS pct_dominant_state, final_state, n_transitions, n_transitions / 29 AS transition_rate, n_increases, n_decreases, first_high_unit, first_high_unit IS NOT NULL AS reached_high_state, entropy, entropy / log2(3) AS entropy_normalized, mean_run, max_run, n_runs FROM h JOIN ru USING (entity_id)", "entity_id"),
    "cluster_silhouettes": PTS + ", d AS (SELECT x.entity_id, x.cluster, y.cluster AS other, avg(list_distance(x.f, y.f)) AS m FROM p x JOIN p y ON x.entity_id <> y.entity_id GROUP BY ALL), ab AS (SELECT entity_id, cluster, max(m) FILTER (other = cluster) AS a, min(m) FILTER (other <> cluster) AS b FROM d GROUP BY ALL) " + _r("SELECT entity_id, cluster, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM ab", "entity_id, cluster"),
    "cluster_validity": PTS + ", wb AS (SELECT sum(w) AS w, sum(b) AS b, max(n) AS n, max(k) AS k FROM (SELECT pos, sum(n * vv) AS w, sum(n * m * m) - power(sum(n * m), 2) / sum(n) AS b, sum(n) AS n, count(*) AS k FROM ce GROUP BY pos)), ca AS (SELECT cluster, list(m ORDER BY pos) AS c FROM ce GROUP BY cluster), sp AS (SELECT p.cluster, any_value(c) AS c, avg(list_distance(f, c)) AS s FROM p JOIN ca USING (cluster) GROUP BY p.cluster) "
    + _r("SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz, (SELECT avg(r) FROM (SELECT x.cluster, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sp x JOIN sp y ON x.cluster <> y.cluster GROUP BY x.cluster)) AS davies_bouldin FROM wb"),
    "cluster_representatives": PTS + ", ca AS (SELECT cluster, list(m ORDER BY pos) AS c FROM ce GROUP BY cluster), d AS (SELECT cluster, entity_id, list_distance(f, c) AS distance FROM p JOIN ca USING (cluster)), k AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY distance, entity_id))::INT AS rank FROM d) " + _r("SELECT cluster, rank, entity_id, distance FROM k WHERE rank <= 3", "cluster, rank, entity_id"),
    "label_agreement": "WITH c AS (SELECT label AS a, label % 3 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS pr, sum(n * ln(n)) AS e FROM c), r AS (SELECT sum(k * (k - 1) / 2) AS p, sum(k * ln(k)) AS e FROM (SELECT sum(n) AS k FROM c GROUP BY a)), q AS (SELECT sum(k * (k - 1) / 2) AS p, sum(k * ln(k)) AS e FROM (SELECT sum(n) AS k FROM c GROUP BY b)) " + _r("SELECT (s.pr - r.p * q.p / (s.n * (s.n - 1) / 2)) / ((r.p + q.p) / 2 - r.p * q.p / (s.n * (s.n - 1) / 2)) AS ari, (ln(s.n) + (s.e - r.e - q.e) / s.n) / ((ln(s.n) - r.e / s.n + ln(s.n) - q.e / s.n) / 2) AS nmi FROM s, r, q"),
    "test_chi_square": ENT + ", c AS (SELECT segment, event, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT r.segment, k.event, r.n AS rn, k.n AS kn, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER () AS t FROM (SELECT segment, count(*) AS n FROM x GROUP BY 1) r CROSS JOIN (SELECT event, count(*) AS n FROM x GROUP BY 1) k LEFT JOIN c ON c.segment = r.segment AND c.event = k.event) "
    + _r("SELECT *, " + CHI4 + " AS p_value FROM (SELECT sum(power(n - rn * kn / t, 2) / (rn * kn / t)) AS statistic, (count(DISTINCT segment) - 1) * (count(DISTINCT event) - 1) AS dof, max(t) AS n FROM g)"),
    "test_anova": ENT + ", g AS (SELECT segment, count(balance) AS n, avg(balance) AS m, var_pop(balance) AS v FROM x GROUP BY 1) " + _r("SELECT *, " + F4.format(f="statistic", d="dof2") + " AS p_value FROM (SELECT ((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS statistic, count(*) - 1 AS dof1, sum(n) - count(*) AS dof2 FROM g)"),
    "test_kruskal": ENT + ", r AS (SELECT segment, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2 AS k, count(*) OVER (PARTITION BY n_orders) AS t, count(*) OVER () AS n FROM x WHERE n_orders IS NOT NULL), g AS (SELECT segment, sum(k) AS s, count(*) AS c, sum(t * t - 1)::DOUBLE AS tie, any_value(n)::DOUBLE AS n FROM r GROUP BY 1) "
    + _r("SELECT *, " + CHI4 + " AS p_value FROM (SELECT (12 / (max(n) * (max(n) + 1)) * sum(s * s / c) - 3 * (max(n) + 1)) / (1 - sum(tie) / (power(max(n), 3) - max(n))) AS statistic, count(*) - 1 AS dof FROM g)"),
    "outcome_spearman": ENT + ", l AS (SELECT * FROM (" + _long("x", ("balance", "n_orders", "price_before"), "time AS y") + ") WHERE v IS NOT NULL AND y IS NOT NULL), r AS (SELECT feature, " + RANKS.format(c="v") + " AS rx, " + RANKS.format(c="y") + " AS ry FROM l) " + _r("SELECT *, " + t_two_sided("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)", 4000) + " AS p_value FROM (SELECT feature, corr(rx, ry) AS r, count(*) AS n FROM r GROUP BY feature)", "feature"),
    "outcome_table": ENT + _r("SELECT segment, 'event' AS outcome, 'binary' AS kind, count(event) AS n, sum(event) AS events, avg(event) AS rate, NULL AS mean, NULL AS sd, NULL AS median FROM x GROUP BY segment UNION ALL SELECT segment, 'n_orders', 'continuous', count(n_orders), NULL, NULL, avg(n_orders), stddev_samp(n_orders), median(n_orders) FROM x GROUP BY segment", "segment, outcome, kind"),
}
SQL["feature_correlations"] = "WITH f AS (" + queries()["features_all"] + "), l AS (SELECT entity_id, name, v FROM (UNPIVOT (SELECT * EXCLUDE (has_plateau) FROM f) ON COLUMNS(* EXCLUDE (entity_id)) INTO NAME name VALUE v)), k AS (SELECT a.name AS a, b.name AS b, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS r, count(*) AS n FROM l a JOIN l b ON a.entity_id = b.entity_id AND a.name < b.name GROUP BY ALL) " + _r("SELECT a, b, r, n FROM k WHERE r IS NOT NULL AND abs(r) >= 0", "a, b", 4)
_KM = ENT + ", t AS (SELECT segment, time, sum(event) AS deaths, count(*) AS k FROM x WHERE time IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY segment ORDER BY time DESC) AS at_risk FROM t), km AS (SELECT segment, time, at_risk, deaths, product(1 - deaths / at_risk) OVER (PARTITION BY segment ORDER BY time) AS survival FROM r) "
SQL["survival_curves"] = _KM + _r("SELECT * FROM km", "segment")
SQL["survival_horizons"] = _KM + _r("SELECT x.segment, count(*) AS n, sum(event) AS events, avg(event) AS rate, " + ", ".join(f"(SELECT coalesce(arg_max(survival, km.time) FILTER (km.time <= {h}), 1) FROM km WHERE km.segment = x.segment) AS survival_{h}" for h in (90, 365, 730)) + " FROM x WHERE time IS NOT NULL GROUP BY x.segment", "segment")

_SEG = ("balance", "n_orders", "price_before", "price_after", "time")
_FS = ", l AS (" + _long("x", _SEG, "segment") + "), g AS (SELECT feature, segment, count(v) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL), fs AS (SELECT feature, ((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f_score, sum(n) - count(*) AS d FROM g GROUP BY feature)"
_KR = ", kl AS (SELECT * FROM l WHERE v IS NOT NULL), kr AS (SELECT feature, segment, " + RANKS.format(c="v") + " AS k, count(*) OVER (PARTITION BY feature, v) AS t, count(*) OVER (PARTITION BY feature)::DOUBLE AS n FROM kl), kg AS (SELECT feature, segment, sum(k) AS s, count(*) AS c, sum(t * t - 1)::DOUBLE AS tie, any_value(n) AS n FROM kr GROUP BY ALL), ks AS (SELECT feature, (12 / (max(n) * (max(n) + 1)) * sum(s * s / c) - 3 * (max(n) + 1)) / (1 - sum(tie) / (power(max(n), 3) - max(n))) AS statistic FROM kg GROUP BY feature)"
_DEAR = "100.0 * count(*) FILTER (price_{} > 150000) / count(*)"
_CELL = lambda e, by: ", ".join(f"{e.format(w=w)} AS {n}" for n, w in [("overall", "true"), *[('"P' + g + '"', f"{by} = '{g}'") for g in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]])
_MEAN = "printf('%.1f (%.1f)', avg({c}) FILTER ({{w}}), stddev_samp({c}) FILTER ({{w}}))"
_P3 = "CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_value"
SQL |= {
    "dataset_summary": "SELECT 'customer' AS dataset, (SELECT count(*) FROM customer) AS n_rows, (SELECT count(*) FROM (DESCRIBE customer))::INT AS n_columns, NULL::VARCHAR AS error UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM (DESCRIBE events))::INT, NULL UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM (DESCRIBE orders))::INT, NULL",
    "normalised_times": BASE + _r("SELECT entity_id, seq, t / 30 AS normalised_time FROM e", "entity_id, seq", 9),
    "invalid_events": WILD + ", k AS (SELECT entity_id, seq, coalesce(d > 10 AND d <= 240, false) AS valid_duration, ts IS NOT NULL AS valid_timestamp, rr IS NULL OR rr BETWEEN 200 AND 2000 AS valid_rr FROM w) SELECT * FROM k WHERE NOT (valid_duration AND valid_timestamp AND valid_rr)",
    "missing_ids": "SELECT DISTINCT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "recoded": "SELECT c_custkey AS entity_id, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, (c_mktsegment = 'FURNITURE')::INT AS is_furniture FROM customer",
    "plausible_values": ENT + _r("SELECT entity_id, CASE WHEN balance BETWEEN 0 AND 5000 THEN balance END AS balance, CASE WHEN n_orders BETWEEN 5 AND 15 THEN n_orders END AS n_orders FROM x", "entity_id"),
    "winsorised": ENT + ", q AS (SELECT quantile_cont(balance, 0.05) AS a, quantile_cont(balance, 0.95) AS b, quantile_cont(price_before, 0.05) AS c, quantile_cont(price_before, 0.95) AS d FROM x) " + _r("SELECT entity_id, greatest(least(balance, b), a) AS balance, CASE WHEN price_before IS NOT NULL THEN greatest(least(price_before, d), c) END AS price_before FROM x, q", "entity_id", 4),
    "indexed_values": ENT + _r("SELECT entity_id, CASE WHEN n_orders <> 0 THEN balance / n_orders END AS balance_per_order FROM x", "entity_id"),
    "segment_events": ENT + _r("SELECT segment, count(*) AS n, count(*) FILTER (n_final >= 1) AS n_events, 100.0 * count(*) FILTER (n_final >= 1) / count(*) AS rate_pct FROM x GROUP BY segment", "segment"),
    "segment_changes": ENT + _r("SELECT segment, count(*) AS n, avg(price_after - price_before) AS mean_change, stddev_samp(price_after - price_before) AS sd, 100.0 * avg((price_after - price_before > 0)::INT) AS pct_improved FROM x WHERE price_after - price_before IS NOT NULL GROUP BY segment", "segment", 4),
    "segment_prevalences": ENT + _r("SELECT 'dear' AS label, segment, grouping(segment) = 1 AS overall, " + _DEAR.format("before") + " AS before_pct, " + _DEAR.format("after") + " AS after_pct, " + _DEAR.format("after") + " - " + _DEAR.format("before") + " AS change FROM x GROUP BY ROLLUP (segment)", "label, segment, overall"),
    "segment_summary": ENT.replace("WITH per", BASE.strip() + ", per", 1) + ", b AS (SELECT entity_id, count(*) AS n_events, sum(d) AS total FROM e GROUP BY entity_id) " + _r("SELECT x.segment, count(*) AS n, avg(total) AS mean_total, avg(n_events) AS mean_events, avg(balance) AS mean_balance FROM x LEFT JOIN b USING (entity_id) GROUP BY x.segment", "segment"),
    "selected_features": ENT + ", l AS (" + _long("x", _SEG[:4]) + ") SELECT feature FROM l GROUP BY feature HAVING var_samp(v) / (power(avg(v), 2) + 1e-10) > 0.01",
    "series_minmax": BASE + ", sr AS (" + RATE + ") " + _r("SELECT entity_id, pos, CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END AS value FROM sr WINDOW w AS (PARTITION BY entity_id)", "entity_id, pos"),
    "series_endpoint": BASE + ", sr AS (SELECT i.entity_id, g::INT AS pos, count(e.t)::DOUBLE AS value FROM (SELECT DISTINCT entity_id FROM e WHERE t <= 30) i CROSS JOIN range(0, 11) r(g) LEFT JOIN e ON e.entity_id = i.entity_id AND e.t <= 30 AND ceil(e.t / 3.0) <= g GROUP BY ALL) " + _r("SELECT entity_id, pos, CASE WHEN arg_max(value, pos) OVER w > 0 THEN value / arg_max(value, pos) OVER w ELSE value END AS value FROM sr WINDOW w AS (PARTITION BY entity_id)", "entity_id, pos"),
    "own_trajectories": BASE + ", kn AS (SELECT entity_id, t AS x, arg_max(cum, seq) AS y FROM e GROUP BY ALL UNION ALL SELECT entity_id, 0.0, 0.0 FROM e GROUP BY entity_id HAVING min(t) > 0), g AS (SELECT entity_id, r.g::INT AS pos, r.g * least(max(t), 365.0) / 9 AS x FROM e, range(0, 10) r(g) GROUP BY entity_id, r.g), b AS (SELECT g.entity_id, pos, g.x, max(kn.x) FILTER (kn.x <= g.x) AS xa, arg_max(kn.y, kn.x) FILTER (kn.x <= g.x) AS ya, min(kn.x) FILTER (kn.x >= g.x) AS xb, arg_min(kn.y, kn.x) FILTER (kn.x >= g.x) AS yb FROM g JOIN kn USING (entity_id) GROUP BY ALL) "
    + _r("SELECT entity_id, pos, x AS time, greatest(coalesce(CASE WHEN xb > xa THEN ya + (yb - ya) * (x - xa) / (xb - xa) ELSE ya END, 0), 0) AS value FROM b", "entity_id, pos"),
    "clinical_states": BASE + ", ids AS (SELECT DISTINCT entity_id FROM e), u AS (SELECT entity_id, floor(t)::INT AS unit, sum(d) AS b FROM e GROUP BY ALL) SELECT entity_id, unit, (coalesce(b, 0) >= 7.2)::INT + (coalesce(b, 0) >= 28.8)::INT AS state FROM (SELECT entity_id, g::INT AS unit FROM ids, range(0, 30) r(g)) LEFT JOIN u USING (entity_id, unit)",
    "cluster_summary": PTS + _r("SELECT cluster, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct, " + ", ".join(f"avg(f[{i}]) AS x{i}_mean, stddev_samp(f[{i}]) AS x{i}_std" for i in range(1, 65)) + " FROM p GROUP BY cluster", "cluster", 5),
    "segment_scores": ENT + _FS + _r("SELECT feature, f_score, " + F4.format(f="f_score", d="d") + " AS p_value FROM fs", "feature"),
    "segment_ranks": ENT + ", l AS (" + _long("x", ("balance", "n_orders", "price_before", "time"), "segment") + ")" + _KR + _r("SELECT feature, statistic AS h, " + CHI4 + " AS p_value FROM ks", "feature"),
    "segment_information": ENT + ", l AS (SELECT * FROM (" + _long("x", ("balance", "n_orders", "price_before"), "segment") + ") WHERE v IS NOT NULL), q AS (SELECT feature, [" + ", ".join(f"quantile_cont(v, {i} / 5.0)" for i in range(1, 5)) + "] AS p FROM l GROUP BY feature), b AS (SELECT feature, segment, len(list_filter(p, lambda c: c < v)) AS b FROM l JOIN q USING (feature)), k AS (SELECT feature, segment, b, count(*)::DOUBLE AS n FROM b GROUP BY ALL), w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, segment) AS ng, sum(n) OVER (PARTITION BY feature, b) AS nb FROM k) "
    + _r("SELECT feature, sum(n / t * ln(n * t / (ng * nb))) AS mi_score FROM w GROUP BY feature", "feature"),
    "segment_feature_table": ENT + ", md AS (SELECT median(price_before) AS pb, median(time) AS tm, median(balance) AS bl FROM x), full_ AS (SELECT segment, coalesce(balance, bl) AS balance, coalesce(price_before, pb) AS price_before, coalesce(time, tm) AS time FROM x, md), fl AS (" + _long("full_", ("balance", "price_before", "time"), "segment") + "), fg AS (SELECT feature, segment, count(v) AS n, avg(v) AS m, var_pop(v) AS s FROM fl GROUP BY ALL), fs AS (SELECT feature, ((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM fg GROUP BY feature), l AS ("
    + _long("x", ("balance", "price_before", "time"), "segment") + ")" + _KR + _r("SELECT feature, CASE feature WHEN 'balance' THEN 'account balance' WHEN 'time' THEN 'days' ELSE 'mean price before' END AS description, " + CHI4 + " AS p_value, f / max(f) OVER () AS importance FROM ks JOIN fs USING (feature)", "feature, description"),
    "linear_model": ENT + ", y AS (SELECT price_before AS y, balance AS a, n_orders::DOUBLE AS b FROM x WHERE price_before IS NOT NULL AND balance IS NOT NULL AND n_orders IS NOT NULL), s AS (SELECT covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(y) AS vy FROM y), k AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s), r AS (SELECT y - (my + ca * (a - ma) + cb * (b - mb)) AS e FROM y, k) "
    + _r("SELECT 'balance' AS term, ca AS value FROM k UNION ALL SELECT 'n_orders', cb FROM k UNION ALL SELECT 'intercept', my - ca * ma - cb * mb FROM k UNION ALL SELECT 'r2', 1 - (SELECT avg(e * e) FROM r) / vy FROM k UNION ALL SELECT 'rmse', sqrt(avg(e * e)) FROM r UNION ALL SELECT 'mae', avg(abs(e)) FROM r", "term", 4),
    "segment_odds": ENT + ", c AS (SELECT segment, count(*) FILTER (n_orders >= 11)::DOUBLE AS a, count(*) FILTER (coalesce(n_orders, 0) < 11)::DOUBLE AS b FROM x GROUP BY segment), o AS (SELECT c.segment, ln(c.a / c.b) - ln(r.a / r.b) AS l, sqrt(1 / c.a + 1 / c.b + 1 / r.a + 1 / r.b) AS s FROM c, (SELECT * FROM c ORDER BY segment LIMIT 1) r WHERE c.segment <> r.segment) "
    + _r("SELECT 'segment_' || segment AS term, exp(l) AS odds_ratio, exp(l - 1.96 * s) AS low, exp(l + 1.96 * s) AS high FROM o UNION ALL SELECT 'reference', 1, 1, 1", "term", 4),
    "log_rank": ENT + ", a AS (SELECT time, event, (segment = 'BUILDING')::INT AS g FROM x WHERE time IS NOT NULL), t AS (SELECT DISTINCT time FROM a WHERE event = 1), k AS (SELECT t.time, count(*) FILTER (a.time >= t.time)::DOUBLE AS n, count(*) FILTER (a.time >= t.time AND g = 1)::DOUBLE AS n1, count(*) FILTER (a.time = t.time AND event = 1)::DOUBLE AS d, count(*) FILTER (a.time = t.time AND event = 1 AND g = 1)::DOUBLE AS d1 FROM t, a GROUP BY t.time) "
    + _r("SELECT power(sum(d1 - d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS statistic, 1 AS dof FROM k"),
    "survival_medians": _KM + _r("SELECT segment, min(time) FILTER (survival <= 0.5 + 1e-9) AS median FROM km GROUP BY segment", "segment"),
    "segment_table": ENT + ", l AS (" + _long("x", ("balance", "n_orders"), "segment") + ")" + _KR + ", cc AS (SELECT segment, event, count(*) AS n FROM x GROUP BY ALL), cg AS (SELECT r.n AS rn, k.n AS kn, coalesce(cc.n, 0) AS n, sum(coalesce(cc.n, 0)) OVER () AS t FROM (SELECT segment, count(*) AS n FROM x GROUP BY 1) r CROSS JOIN (SELECT event, count(*) AS n FROM x GROUP BY 1) k LEFT JOIN cc ON cc.segment = r.segment AND cc.event = k.event), pc AS (SELECT sum(power(n - rn * kn / t, 2) / (rn * kn / t)) AS statistic FROM cg), ps AS (SELECT feature, "
    + CHI4 + " AS p FROM ks UNION ALL SELECT 'event', " + CHI4 + " FROM pc) SELECT z.* EXCLUDE (feature), " + _P3 + " FROM (SELECT 'balance' AS feature, 'Balance' AS label, count(balance) AS n, " + _CELL(_MEAN.format(c="balance"), "segment") + " FROM x UNION ALL SELECT 'n_orders', 'Orders', count(n_orders), " + _CELL(_MEAN.format(c="n_orders"), "segment") + " FROM x UNION ALL SELECT 'event', 'Final order', count(event), " + _CELL("printf('%.1f%%', 100 * avg(event) FILTER ({w}))", "segment") + " FROM x) z JOIN ps USING (feature)",
}
