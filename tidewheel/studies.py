"""More registered queries: models and their explanations, neighbours and clusters, survival, tests, sources.  Their SQL is in ``plans.study_sql``."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import features as X
from tidewheel.operators import hierarchy as G
from tidewheel.operators import importance as P
from tidewheel.operators import integration as I
from tidewheel.operators import models as M
from tidewheel.operators import neighbours as N
from tidewheel.operators import report as R
from tidewheel.operators import series as T
from tidewheel.operators import shapes as C
from tidewheel.operators import shapley as S
from tidewheel.operators import stats as H
from tidewheel.operators import survival as K
from tidewheel.operators.shared import free, new_path, save
from tidewheel.plans.feature_sql import WINDOWS
from tidewheel.queries import Query, _rates, _vectors, entities, history, points, rounded, span
from tidewheel.sources import Catalog, Source, read_csv, write_csv

FOUR = ["balance", "n_orders", "price_before", "price_after"]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(entity_id, feature, phi) of an array of values for each row."""
    name = F.element_at(F.array(*[F.lit(x) for x in columns]), F.col("pos") + 1)
    return df.select("entity_id", "prediction", F.posexplode("phi").alias("pos", "phi")).select("entity_id", name.alias("feature"), "prediction", "phi")


# Models


def shapley_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column adds to each row's prediction, of a fitted linear model of the mean price."""
    e = entities(spark, sf_dir).where("price_before IS NOT NULL")
    fit = M.linear(e, ["balance", "n_orders"], "price_before")
    return rounded(_long(S.linear_values(e, fit["coefficients"], fit["intercept"]), ["balance", "n_orders"]), ("entity_id", "feature"), 3)


def _forest(spark, sf_dir):
    own = save(entities(spark, sf_dir).select("entity_id", "event", *FOUR), "entities")
    # Both tables are written once: statistics, the forest's passes and the values read them.
    data = save(M.assemble(I.preprocess(own, FOUR).join(own.select("entity_id", "event"), "entity_id"), FOUR, ("entity_id", "event")), "vectors")
    free(own)
    return data, RandomForestClassifier(featuresCol="v", labelCol="event", numTrees=20, seed=M.SEED).fit(data)


def shapley_forest(spark, sf_dir):
    """What each column adds to each row's probability, of a forest."""
    data, fit = _forest(spark, sf_dir)
    return _long(S.forest_values(data, S.forest_of(fit, spark), len(FOUR)), FOUR)


def shapley_importance(spark, sf_dir):
    data, fit = _forest(spark, sf_dir)
    return S.mean_abs(S.forest_values(data, S.forest_of(fit, spark), len(FOUR)), FOUR)


def score_report(spark, sf_dir):
    """AUC, confusion and rates of a given score: the balance on a scale of 0 to 1."""
    e = entities(spark, sf_dir).select("event", ((F.col("balance") + 1000) / 11000).alias("score"))
    return rounded(M.binary_report(e, "event"), ())


def permutation_importance(spark, sf_dir):
    e = entities(spark, sf_dir)
    fit = M.classify(e, ["balance", "n_orders"], "event")
    found = M.permutation_importance(fit["model"], e, ["balance", "n_orders"], "event", 3)
    return spark.createDataFrame(sorted(found.items()), "feature string, importance_mean double")


def neighbour_information(spark, sf_dir):
    """Mutual information of segment and columns of whole numbers by three neighbours."""
    e = entities(spark, sf_dir).select("segment", F.round(F.col("balance") * 100).cast("long").alias("cents"), "n_orders", "time")
    return rounded(P.neighbour_information(e, "segment", ["cents", "n_orders", "time"]), ("feature",))


# Survival


def _timed(spark, sf_dir):
    return entities(spark, sf_dir).where("time IS NOT NULL")


def concordance_index(spark, sf_dir):
    """Concordance of two risks with the times, exact: concordant, tied and comparable pairs."""
    e = _timed(spark, sf_dir)
    rows = [K.concordance_table(e, x).select(F.lit(x).alias("risk"), "*") for x in ("n_orders", "balance")]
    return rounded(rows[0].unionByName(rows[1]), ("risk",), 9)


def survival_limits(spark, sf_dir):
    """Kaplan-Meier curves with 95 % limits."""
    return rounded(K.kaplan_meier(_timed(spark, sf_dir), "segment"), ("segment", "time"))


def survival_prepared(spark, sf_dir):
    """Times and events after censoring at 100 days."""
    got = K.prepare(entities(spark, sf_dir).withColumnRenamed("time", "days"), F.when(F.col("event") == 1, 1), "days", 100)
    return rounded(got.select("entity_id", "time", "event"))


def cox_by_group(spark, sf_dir):
    found = K.cox_by_group(_timed(spark, sf_dir), "segment", ["balance"], with_concordance=False)
    return spark.createDataFrame([(x, found["hazard_ratios"][x], found["low"][x], found["high"][x], found["p_values"][x]) for x in found["coefficients"]], "covariate string, hazard_ratio double, low double, high double, p_value double")


# Tests


def outcome_pearson(spark, sf_dir):
    return rounded(H.outcome_correlations(entities(spark, sf_dir), ["balance", "n_orders", "price_before"], "time").drop("significant"), ("feature",))


def test_yates(spark, sf_dir):
    """Chi-square of a table of two by two."""
    e = entities(spark, sf_dir).withColumn("building", F.col("segment") == "BUILDING")
    return rounded(H.chi_square(e, "building", "event").drop("p_value"), ())


def chosen_tests(spark, sf_dir):
    """The test that suits each outcome, its statistic and stars."""
    e = entities(spark, sf_dir)
    rows = [H.compare(e, x, "segment").select(F.lit(x).alias("outcome"), "test", "statistic", "p_value") for x in ("balance", "n_orders", "event")]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("outcome", "test", (F.round("statistic", 6) + 0.0).alias("statistic"), (F.round("p_value", 6) + 0.0).alias("p_value"), H.stars(F.col("p_value")).alias("stars"), H.format_p(F.col("p_value")).alias("shown"))


def segment_odds_tested(spark, sf_dir):
    """Odds ratios of segments with their p-values."""
    e = entities(spark, sf_dir).withColumn("many", (F.coalesce("n_orders", F.lit(0)) >= 11).cast("int"))
    return rounded(M.odds_ratios(e, "many", "segment").where("term <> 'reference'"), ("term",), 4)


# Neighbours and clusters


def nearest_neighbours(spark, sf_dir):
    """The five nearest other points of every point."""
    own = N.indexed(points(spark, sf_dir))
    ids = own.select("i", "entity_id")
    near = N.neighbours(own, 5).join(ids, "i").join(ids.withColumnsRenamed({"i": "j", "entity_id": "other"}), "j")
    return rounded(near.select("entity_id", "other", "rank", "d"), ("entity_id", "other", "rank"))


def density_clusters(spark, sf_dir):
    return G.density_clusters(points(spark, sf_dir), 5)


def hierarchy_ward(spark, sf_dir):
    """Eight clusters of all points by Ward's linkage."""
    return G.agglomerative(points(spark, sf_dir), 8, "ward")[0]


def shape_clusters(spark, sf_dir):
    return C.kshape(_rates(spark, sf_dir), 4, 2)[0]


def warped_clusters(spark, sf_dir):
    return C.warp_kmeans(_rates(spark, sf_dir), 4, most=5)[0]


def spectral_clusters(spark, sf_dir):
    return C.spectral(points(spark, sf_dir), 8)[0]


def k_sweep(spark, sf_dir):
    return M.sweep(_vectors(spark, sf_dir), range(2, 5), 2)


def mixture_bic(spark, sf_dir):
    return spark.createDataFrame(M.gaussian_bic(_vectors(spark, sf_dir), range(2, 5)), "k int, bic double")


def cluster_stability(spark, sf_dir):
    return spark.createDataFrame(sorted(M.stability(_vectors(spark, sf_dir), 3, 5).items()), "measure string, value double")


# Series


def _pairs(metric):
    def query(spark, sf_dir):
        return rounded(T.distances(_rates(spark, sf_dir), metric), ("a", "b"))

    query.__doc__ = f"The {metric} distance of every pair of series."
    query.__name__ = f"series_{metric}"
    return query


def weekly_counts(spark, sf_dir):
    """Events so far on a weekly grid."""
    h = history(spark, sf_dir)
    return rounded(T.dataset(h, "episode_count", "weekly", 7 * 5).drop("time"), ("entity_id", "pos"))


def percentile_states(spark, sf_dir):
    """Daily states by the 33rd and 67th percentile of positive burdens, with their names."""
    h = history(spark, sf_dir)
    units = T.unit_burden(h, "daily")
    found = T.states(units, T.thresholds(units, method="percentile", resolution="daily"), span(h))
    return found.select("entity_id", "unit", "state", T.state_label(F.col("state"), 3).alias("label"))


# Features, tables, names


def correlated_features(spark, sf_dir):
    """Pairs of burden features with |r| of 0.8 or more, over all pairs."""
    f = rounded(X.extract(history(spark, sf_dir), ("burden",), WINDOWS))  # without the noise of constant columns
    return rounded(I.correlations(f, sorted(I.numeric_columns(f, ("entity_id",)))), ("a", "b"), 5)


def complete_entities(spark, sf_dir):
    e = I.complete_cases(entities(spark, sf_dir), ["n_orders", "price_before", "price_after"])
    return rounded(e.select("entity_id", "n_orders", "price_before", "price_after"), digits=4)


def numeric_totals(spark, sf_dir):
    """The sum of every numeric column but the id."""
    e = entities(spark, sf_dir)
    columns = I.numeric_columns(e, ("entity_id",))
    return rounded(e.agg(*[F.sum(x).cast("double").alias(x) for x in columns]).unpivot([], columns, "column", "total"), ("column",), 2)


def nation_names(spark, sf_dir):
    """Customers with the name of their nation, looked up in a small table."""
    c = Catalog(spark, {n: Source(f"{sf_dir}/{n}.parquet") for n in ("customer", "nation")})
    return I.looked_up(c.load("customer", False), "c_nationkey", c.load("nation", False), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


def loaded_tables(spark, sf_dir):
    """Rows, columns and kinds of the columns of all tables of a catalog."""
    names = ("region", "nation", "supplier", "part")
    catalog = Catalog(spark, {n: Source(f"{sf_dir}/{n}.parquet") for n in names} | {"validation": Source(None)})
    rows = [(n, df.count(), len(df.columns), sum(t == "string" for _, t in df.dtypes)) for n, df in catalog.load_all().items()]
    catalog.clear()
    return spark.createDataFrame(rows, "name string, n_rows long, n_columns int, n_texts int")


def csv_round_trip(spark, sf_dir):
    """Suppliers written to CSV and read again with inferred types."""
    path = new_path(spark, "suppliers.csv")
    write_csv(spark.read.parquet(f"{sf_dir}/supplier.parquet"), path)
    return read_csv(spark, path)


def body_surfaces(spark, sf_dir):
    """The surface formula over the sizes and prices of parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rounded(p.select("p_partkey", I.body_surface(F.col("p_size") + 100.0, F.col("p_retailprice") / 20).alias("surface"), (F.col("p_retailprice") - F.col("p_size")).alias("recovery")), ("p_partkey",))


def phenotype_names(spark, sf_dir):
    """The name of each of three groups, from its entities' features."""
    f = X.extract(history(spark, sf_dir), ("burden", "episode"), WINDOWS)
    return R.phenotype_names(f.withColumn("phenotype", F.pmod("entity_id", F.lit(3)).cast("int")))


NAMED = (
    shapley_linear, shapley_forest, shapley_importance, score_report, permutation_importance, neighbour_information, concordance_index, survival_limits, survival_prepared, cox_by_group, outcome_pearson, test_yates, chosen_tests, segment_odds_tested,
    nearest_neighbours, density_clusters, hierarchy_ward, shape_clusters, warped_clusters, spectral_clusters, k_sweep, mixture_bic, cluster_stability, _pairs("cosine"), _pairs("correlation"),
    weekly_counts, percentile_states, correlated_features, complete_entities, numeric_totals, nation_names, loaded_tables, csv_round_trip, body_surfaces, phenotype_names,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in NAMED}
