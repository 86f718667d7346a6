"""DuckDB SQL of the queries in ``studies``."""

from tidewheel.plans import feature_sql
from tidewheel.plans.feature_sql import BASE, t_two_sided
from tidewheel.plans.library_sql import _KM, _KR, CHI4, ENT, PTS, RATE, SQL as OTHER, _long, _r

_FIT = OTHER["linear_model"].split(", r AS (")[0]


def _z_two_sided(z: str, steps: int = 400) -> str:
    """The two-sided p-value of a normal z, by Simpson's rule over its density from 0 to |z|."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, {steps + 1}), lambda k: ({weight}) * exp(-power(abs({z}) * k / {steps}, 2) / 2))) * abs({z}) / {3 * steps})"


def _digamma(n: str) -> str:
    return f"CASE WHEN {n} < 16 THEN coalesce(list_sum(list_transform(range(1, {n}), lambda j: 1.0 / j)), 0) - 0.5772156649015329 ELSE ln({n}) - 1 / (2.0 * {n}) - 1 / (12 * power({n}, 2)) + 1 / (120 * power({n}, 4)) - 1 / (252 * power({n}, 6)) END"


def _concordance(risk: str) -> str:
    pairs = "a.event = 1 AND (a.time < b.time OR (a.time = b.time AND b.event = 0))"
    return f"SELECT '{risk}' AS risk, count(*) FILTER (a.{risk} > b.{risk}) AS concordant, count(*) FILTER (a.{risk} = b.{risk}) AS tied, count(*) AS pairs, (count(*) FILTER (a.{risk} > b.{risk}) + count(*) FILTER (a.{risk} = b.{risk}) / 2) / count(*) AS concordance FROM y a JOIN y b ON {pairs} WHERE a.{risk} IS NOT NULL AND b.{risk} IS NOT NULL"


def _series(distance: str) -> str:
    sums = "SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n, sum(x.value) AS sx, sum(y.value) AS sy, sum(x.value * x.value) AS xx, sum(y.value * y.value) AS yy, sum(x.value * y.value) AS xy FROM sr x JOIN sr y ON x.pos = y.pos AND x.entity_id < y.entity_id GROUP BY ALL"
    return BASE + ", sr AS (" + RATE + ") " + _r(f"SELECT a, b, {distance} AS distance FROM ({sums})", "a, b")


_KIND = "SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, count(*) AS n_columns, count(*) FILTER (column_type = 'VARCHAR') AS n_texts FROM (DESCRIBE {n})"

SQL: dict[str, str] = {
    "shapley_linear": _FIT + ", z AS (SELECT entity_id, balance AS a, n_orders::DOUBLE AS b FROM x WHERE price_before IS NOT NULL AND balance IS NOT NULL AND n_orders IS NOT NULL), m AS (SELECT z.*, ca * (a - ma) AS pa, cb * (b - mb) AS pb, my + ca * (a - ma) + cb * (b - mb) AS prediction FROM z, k) "
    + _r("SELECT entity_id, 'balance' AS feature, prediction, pa AS phi FROM m UNION ALL SELECT entity_id, 'n_orders', prediction, pb FROM m", "entity_id, feature", 3),
    "score_report": ENT + ", s AS (SELECT event, (balance + 1000) / 11000 AS score FROM x), p AS (SELECT sum((a.score > b.score)::INT + (a.score = b.score)::INT / 2) / count(*) AS auc FROM s a JOIN s b ON a.event = 1 AND b.event = 0), k AS (SELECT count(*) AS n, sum(event) AS n_events, count(*) FILTER (event = 0 AND score <= 0.5) AS tn, count(*) FILTER (event = 0 AND score > 0.5) AS fp, count(*) FILTER (event = 1 AND score <= 0.5) AS fn, count(*) FILTER (event = 1 AND score > 0.5) AS tp FROM s) "
    + _r("SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM p, k"),
    "neighbour_information": ENT + ", l AS (SELECT segment AS g, feature, v FROM (" + _long("(SELECT segment, round(balance * 100)::BIGINT AS cents, n_orders, time FROM x)", ("cents", "n_orders", "time"), "segment") + ") WHERE v IS NOT NULL), q AS (SELECT row_number() OVER () AS id, *, count(*) OVER (PARTITION BY feature, g) AS n FROM l), o AS (SELECT * FROM q WHERE n > 1), c AS (SELECT a.id, a.feature, a.v, a.n, list_sort(list(abs(a.v - b.v))) AS ds FROM o a JOIN o b ON a.feature = b.feature AND a.g = b.g AND a.id <> b.id GROUP BY a.id, a.feature, a.v, a.n), d AS (SELECT id, feature, v, n, least(3, n - 1) AS k, ds[least(3, n - 1)] AS r FROM c), "
    f"m AS (SELECT d.id, d.feature, d.n, d.k, count(*) FILTER (abs(o.v - d.v) < d.r OR o.v = d.v) AS m FROM d JOIN o ON o.feature = d.feature GROUP BY d.id, d.feature, d.n, d.k), t AS (SELECT feature, count(*) AS c_, avg({_digamma('k')}) AS pk, avg({_digamma('n')}) AS pn, avg({_digamma('m')}) AS pm FROM m GROUP BY feature) "
    + _r(f"SELECT feature, greatest(0, {_digamma('c_')} + pk - pn - pm) AS mi_score FROM t", "feature"),
    "concordance_index": ENT + ", y AS (SELECT * FROM x WHERE time IS NOT NULL) " + _r(_concordance("n_orders") + " UNION ALL " + _concordance("balance"), "risk", 9),
    "survival_limits": _KM + ", v AS (SELECT *, sum(CASE WHEN at_risk > deaths THEN deaths / (at_risk * (at_risk - deaths)) ELSE 0 END) OVER (PARTITION BY segment ORDER BY time) AS v, max(at_risk) OVER (PARTITION BY segment) AS size FROM km), u AS (SELECT *, survival > 0 AND survival < 1 AS inside, sqrt(v) / abs(ln(CASE WHEN survival > 0 AND survival < 1 THEN survival END)) AS se FROM v WHERE size >= 2) "
    + _r("SELECT segment, time, at_risk, deaths, survival, CASE WHEN inside THEN power(survival, exp(1.959963984540054 * se)) ELSE survival END AS low, CASE WHEN inside THEN power(survival, exp(-1.959963984540054 * se)) ELSE survival END AS high FROM u", "segment, time"),
    "survival_prepared": ENT + _r("SELECT entity_id, least(time, 100) AS time, CASE WHEN time > 100 THEN 0 ELSE event END AS event FROM x WHERE time IS NOT NULL", "entity_id"),
    "outcome_pearson": ENT + ", l AS (SELECT * FROM (" + _long("x", ("balance", "n_orders", "price_before"), "time AS y") + ") WHERE v IS NOT NULL AND y IS NOT NULL) " + _r("SELECT *, " + t_two_sided("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)", 4000) + " AS p_value FROM (SELECT feature, corr(v, y) AS r, count(*) AS n FROM l GROUP BY feature)", "feature"),
    "test_yates": ENT + ", c AS (SELECT segment = 'BUILDING' AS s, event, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT r.n * k.n / t.n AS e, coalesce(c.n, 0) AS o, t.n AS t FROM (SELECT s, sum(n) AS n FROM c GROUP BY s) r CROSS JOIN (SELECT event, sum(n) AS n FROM c GROUP BY event) k CROSS JOIN (SELECT sum(n) AS n FROM c) t LEFT JOIN c ON c.s = r.s AND c.event = k.event) "
    + _r("SELECT sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS statistic, 1 AS dof, max(t) AS n FROM g"),
    "chosen_tests": ENT + ", l AS (" + _long("x", ("balance", "n_orders"), "segment") + ")" + _KR + ", c AS (SELECT segment, event, count(*) AS n FROM x GROUP BY ALL), cg AS (SELECT r.n * k.n / t.n AS e, coalesce(c.n, 0) AS o FROM (SELECT segment, sum(n) AS n FROM c GROUP BY 1) r CROSS JOIN (SELECT event, sum(n) AS n FROM c GROUP BY 1) k CROSS JOIN (SELECT sum(n) AS n FROM c) t LEFT JOIN c ON c.segment = r.segment AND c.event = k.event), u AS (SELECT feature AS outcome, 'kruskal' AS test, statistic FROM ks UNION ALL SELECT 'event', 'chi2', sum(power(o - e, 2) / e) FROM cg), p AS (SELECT *, " + CHI4 + " AS p FROM u) "
    "SELECT outcome, test, round(statistic, 6) + 0.0 AS statistic, round(p, 6) + 0.0 AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS shown FROM p",
    "segment_odds_tested": OTHER["segment_odds"].split(" SELECT term,")[0] + " " + _r("SELECT 'segment_' || segment AS term, exp(l) AS odds_ratio, exp(l - 1.96 * s) AS low, exp(l + 1.96 * s) AS high, " + _z_two_sided("(l / s)") + " AS p_value FROM o", "term", 4),
    "nearest_neighbours": PTS.split(",\n")[0] + ", d AS (SELECT a.entity_id, b.entity_id AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.f[i] - b.f[i], 2)))) AS d FROM p a JOIN p b ON a.entity_id <> b.entity_id), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, other) AS rank FROM d) " + _r("SELECT entity_id, other, rank, d FROM n WHERE rank <= 5", "entity_id, other, rank"),
    "series_cosine": _series("CASE WHEN xx * yy > 0 THEN 1 - xy / sqrt(xx * yy) END"),
    "series_correlation": _series("CASE WHEN n * xx - sx * sx > 1e-9 AND n * yy - sy * sy > 1e-9 THEN 1 - (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) END"),
    "weekly_counts": BASE + _r("SELECT i.entity_id, g::INT AS pos, count(e.t) AS value FROM (SELECT DISTINCT entity_id FROM e WHERE t <= 35) i CROSS JOIN range(0, 5) r(g) LEFT JOIN e ON e.entity_id = i.entity_id AND e.t <= 35 AND ceil(e.t / (35.0 / 4)) <= g GROUP BY ALL", "entity_id, pos"),
    "percentile_states": BASE + ", ids AS (SELECT DISTINCT entity_id FROM e), u AS (SELECT entity_id, floor(t)::INT AS unit, sum(d) AS b FROM e GROUP BY ALL), cut AS (SELECT quantile_cont(b, 0.33) AS lo, quantile_cont(b, 0.67) AS hi FROM u WHERE b > 0), n AS (SELECT greatest(1, ceil(max(t)))::INT AS n FROM e), s AS (SELECT entity_id, unit, (coalesce(b, 0) >= lo)::INT + (coalesce(b, 0) >= hi)::INT AS state FROM (SELECT entity_id, unnest(range(0, n))::INT AS unit FROM ids, n) LEFT JOIN u USING (entity_id, unit), cut) SELECT *, ['Low', 'Medium', 'High'][state + 1] AS label FROM s",
    "correlated_features": "WITH f AS (" + feature_sql.queries()["features_burden"] + "), l AS (SELECT entity_id, name, v FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (entity_id)) INTO NAME name VALUE v)), k AS (SELECT a.name AS a, b.name AS b, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS r, count(*) AS n FROM l a JOIN l b ON a.entity_id = b.entity_id AND a.name < b.name GROUP BY ALL) "
    + _r("SELECT a, b, r, n FROM k WHERE abs(r) >= 0.8", "a, b", 5),
    "complete_entities": ENT + _r("SELECT entity_id, n_orders, price_before, price_after FROM x WHERE n_orders IS NOT NULL AND price_before IS NOT NULL AND price_after IS NOT NULL", "entity_id", 4),
    "numeric_totals": ENT + _r(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", sum({x})::DOUBLE AS total FROM x" for x in ("balance", "n_orders", "n_final", "price_before", "price_after", "time", "event")), '"column"', 2),
    "nation_names": "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "loaded_tables": " UNION ALL ".join(_KIND.format(n=n) for n in ("region", "nation", "supplier", "part")),
    "csv_round_trip": "SELECT * FROM supplier",
    "body_surfaces": _r("SELECT p_partkey, 0.007184 * power(p_size + 100.0, 0.725) * power(p_retailprice / 20, 0.425) AS surface, p_retailprice - p_size AS recovery FROM part", "p_partkey"),
    "phenotype_names": "WITH b AS (" + feature_sql.queries()["features_burden"] + "), e AS (" + feature_sql.queries()["features_episode"] + "), m AS (SELECT (entity_id % 3)::INT AS phenotype, avg(af_burden_percent) AS b, avg(n_episodes) AS n, avg(mean_episode_duration) AS d FROM b JOIN e USING (entity_id) GROUP BY 1) SELECT phenotype, printf('P%d: %.1f%% burden - %.0f episodes - %.0f min', phenotype, b, n, d) AS name FROM m",
}
