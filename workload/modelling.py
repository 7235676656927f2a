"""Classifiers: the prior and naive Bayes against SQL, the iterative ones by rows."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blotter.models.bayes import CategoricalBayes
from blotter.models.mllib import MultinomialLogistic
from blotter.models.prior import ClassPrior
from blotter.operators import features
from blotter.operators.encoding import ColumnEncoder
from blotter.plans import assemble, config as presets, finals
from blotter.session import cached, scratch_path
from blotter.sources import fixtures
from workload.base import development, frozen, modeling, modeling_sql, query, r, rounded, with_sql
from workload.transforms import (
    BAYES_LEVELS,
    BAYES_NUMBERS,
    EARLY,
    LIMIT,
    TS,
    bayes_codes_sql,
    bayes_encoder,
    bayes_rows,
)

CLASSES = fixtures.CLASSES
K = len(CLASSES)


def spread(df, *keys):
    """Key columns and one column per class probability."""
    return rounded(df.select(*keys, *[F.col("probability")[i].alias(f"p{i}") for i in range(K)]))


_PRIORS = ", ".join(
    r(f"(SELECT count(*) FILTER (WHERE target = '{c}') / CAST(count(*) AS DOUBLE) FROM modeling WHERE {TS} < {LIMIT})", f"p{i}")
    for i, c in enumerate(CLASSES)
)


@query("m01_class_prior", with_sql(modeling_sql(), f"SELECT incident_id, {_PRIORS} FROM modeling WHERE {TS} >= {LIMIT}"))
def m01(spark, sf):
    train = assemble.with_label(development(spark, sf).select("target"), CLASSES)
    return spread(ClassPrior().fit(train).transform(frozen(spark, sf)), "incident_id")


def bayes_sql(final="SELECT * FROM shares"):
    """Log joint per row and class, then the softmax."""
    columns = BAYES_NUMBERS + BAYES_LEVELS
    long = " UNION ALL ".join(f"SELECT incident_id, target, {TS}, '{c}' AS feature, {c} AS code FROM codes" for c in columns)
    cells = ", ".join(r(f"sum(CASE WHEN class = '{c}' THEN e / s END)", f"p{i}") for i, c in enumerate(CLASSES))
    return with_sql(
        f"""{bayes_codes_sql()},
long AS MATERIALIZED ({long}),
fit AS (SELECT * FROM long WHERE {TS} < {LIMIT}),
sizes AS (SELECT feature, max(code) + 1 AS n_codes FROM fit GROUP BY feature),
classes AS (SELECT target AS class, count(*) AS n_class FROM codes WHERE {TS} < {LIMIT} GROUP BY target),
hits AS (SELECT feature, code, target AS class, count(*) AS n FROM fit GROUP BY 1, 2, 3),
terms AS (
 SELECT l.incident_id, c.class, sum(ln(coalesce(h.n, 0) + 0.5::DOUBLE) - ln(c.n_class + 0.5::DOUBLE * s.n_codes)) AS ll
 FROM long l JOIN sizes s USING (feature) CROSS JOIN classes c
 LEFT JOIN hits h ON h.feature = l.feature AND h.code = l.code AND h.class = c.class
 WHERE l.{TS} >= {LIMIT} GROUP BY 1, 2),
joint AS (SELECT incident_id, t.class, ll + ln(n_class) - ln((SELECT sum(n_class) FROM classes)) AS j
 FROM terms t JOIN classes c ON c.class = t.class),
expo AS (SELECT incident_id, class, exp(j - max(j) OVER (PARTITION BY incident_id)) AS e FROM joint),
parts AS (SELECT *, sum(e) OVER (PARTITION BY incident_id) AS s FROM expo),
shares AS (SELECT incident_id, {cells} FROM parts GROUP BY incident_id)""",
        final,
    )


def bayes_model(spark, sf):
    rows = bayes_rows(spark, sf)
    train = assemble.with_label(rows.filter(EARLY), CLASSES)
    stages = [bayes_encoder(), CategoricalBayes(BAYES_NUMBERS + BAYES_LEVELS)]
    with cached(train) as train:
        return Pipeline(stages=stages).fit(train), rows


@query("m03_naive_bayes", bayes_sql())
def m03(spark, sf):
    model, rows = bayes_model(spark, sf)
    return spread(model.transform(rows.filter(~F.expr(EARLY))), "incident_id")


@query("s10_saved_model", bayes_sql())
def s10(spark, sf):
    from pyspark.ml import PipelineModel

    model, rows = bayes_model(spark, sf)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    return spread(PipelineModel.load(path).transform(rows.filter(~F.expr(EARLY))), "incident_id")


SMALL = ("incident_hour", "incident_minute", "incident_day_of_week_num", "longitude", "latitude", "is_intersection")


def small_rows(spark, sf):
    """A few numeric predictors with the key, target and time."""
    return modeling(spark, sf).select("incident_id", "target", TS, *SMALL, "pd_district")


def fitted(spark, sf, estimator, encoder=None):
    """Fit encoder and estimator on the development rows, score the frozen rows."""
    rows = small_rows(spark, sf)
    skip = ("incident_id", "target", "label", TS)
    encoder = encoder or ColumnEncoder("passthrough", "ordinal", skip=skip, sparse=False)
    with cached(assemble.with_label(rows.filter(EARLY), CLASSES)) as train:
        model = Pipeline(stages=[encoder, estimator]).fit(train)
    return model, assemble.score(model, rows.filter(~F.expr(EARLY)))


@query("m02_logistic")
def m02(spark, sf):
    skip = ("incident_id", "target", "label", TS)
    encoder = ColumnEncoder("standard", "onehot", skip=skip)
    _, scored = fitted(spark, sf, MultinomialLogistic(c=0.1, max_iter=50, class_weight="balanced"), encoder)
    return spread(scored, "incident_id")


@query("m02_logistic_embeddings")
def m02_embeddings(spark, sf):
    """Fitted on four fifths of the vectors, predicting all."""
    rows = fixtures.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    model = MultinomialLogistic(c=1.0, max_iter=30).fit(rows.filter("vec_id % 5 > 0"))
    return model.transform(rows).select("vec_id", "label", "prediction")


def preset_fit(spark, sf, config):
    """A preset whole: its features, its transform and its model, fitted on the development rows, scored on the frozen ones."""
    rows = features.from_config(modeling(spark, sf), config, keep=("incident_id", "target", TS))
    with cached(assemble.with_label(rows.filter(EARLY).drop(TS), CLASSES)) as train:
        model = assemble.full_pipeline(config).fit(train)
    return spread(assemble.score(model, rows.filter(~F.expr(EARLY)).drop(TS)), "incident_id")


@query("m04_random_forest")
def m04(spark, sf):
    return preset_fit(spark, sf, presets.random_forest_baseline())


@query("m05_extra_trees")
def m05(spark, sf):
    return preset_fit(spark, sf, presets.tree_baseline("extra_trees"))


@query("m06_hist_boosting")
def m06(spark, sf):
    return preset_fit(spark, sf, presets.tree_baseline("hist_gradient_boosting"))


@query("m07_softmax_boosting")
def m07(spark, sf):
    return preset_fit(spark, sf, presets.xgboost_baseline())


SMALL_FOREST = presets.random_forest_baseline().but(
    experiment_name="small_forest", geo_mode="raw_distances", n_geo_clusters=8, forest_n_estimators=5, forest_max_depth=6
)


@query("m08_full_fit_and_score")
def m08(spark, sf):
    return preset_fit(spark, sf, SMALL_FOREST)


@query("m10_final_fit")
def m10(spark, sf):
    """Fit on all rows, save, load, and give the three likeliest categories per row."""
    data = modeling(spark, sf)
    final = finals.train_final(SMALL_FOREST, data)
    path = scratch_path(spark, "final")
    final.save(path)
    rows = features.from_config(data, SMALL_FOREST, keep=("incident_id",))
    return rounded(finals.FinalModel.load(path).top_categories(rows, k=3))


@query("m11_frozen_scoring")
def m11(spark, sf):
    found = finals.evaluate_frozen(SMALL_FOREST, modeling(spark, sf), fixtures.TEST_START)
    return rounded(found.tables()["frozen_test_metrics"])


_META = (
    "SELECT 'small_forest' AS model_name, count(*) AS training_rows, CAST(30 AS BIGINT) AS raw_feature_columns, "
    "count(DISTINCT target) AS class_count, list(DISTINCT target ORDER BY target) AS classes FROM modeling"
)


@query("s11_model_metadata", with_sql(modeling_sql(), _META))
def s11(spark, sf):
    record = finals.metadata_row(modeling(spark, sf), SMALL_FOREST)
    names = ("model_name", "training_rows", "raw_feature_columns", "class_count", "classes")
    kinds = "model_name string, training_rows bigint, raw_feature_columns bigint, class_count bigint, classes array<string>"
    return spark.createDataFrame([tuple(record[n] for n in names)], kinds)
