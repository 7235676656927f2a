"""Importances and attributions."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blotter.models.forest import Forest
from blotter.operators import attribution
from blotter.plans import explanation
from blotter.sources import fixtures
from workload.base import d, modeling, modeling_query, modeling_sql, query, r, rounded, with_sql
from workload.frames import HASH
from workload.modelling import CLASSES, K, SMALL_FOREST, fitted, small_rows


@query(
    "x02_reproducible_sample",
    modeling_query(f"SELECT incident_id, target FROM modeling ORDER BY {HASH}, incident_id LIMIT 2000"),
)
def x02(spark, sf):
    return attribution.reproducible_sample(modeling(spark, sf).select("incident_id", "target"), "incident_id")


# Fixed weights of a linear model with three classes.
LINEAR = ("incident_hour", "longitude", "latitude", "is_intersection")
WEIGHTS = [[(1 + j * 3 + k * 5) % 7 / 10 - 0.3 for j in range(len(LINEAR))] for k in range(3)]
_MEANS = "means AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in LINEAR) + " FROM modeling)"
_DRAWN = f"drawn AS (SELECT * FROM modeling ORDER BY {HASH}, incident_id LIMIT 2000)"
_PHI = " UNION ALL ".join(
    f"SELECT incident_id, '{c}' AS feature, {k} AS class_id, {r(f'{d(WEIGHTS[k][j])} * ({c} - (SELECT {c} FROM means))', 'phi')} FROM drawn"
    for k in range(3)
    for j, c in enumerate(LINEAR)
)


@query("x03_linear_contributions", with_sql(f"{modeling_sql()},\n{_MEANS},\n{_DRAWN}", _PHI))
def x03(spark, sf):
    rows = modeling(spark, sf).select("incident_id", *LINEAR)
    means = rows.agg(*[F.avg(c).alias(c) for c in LINEAR]).first().asDict()
    drawn = attribution.reproducible_sample(rows, "incident_id")
    return rounded(attribution.linear_contributions(drawn, "incident_id", list(LINEAR), WEIGHTS, means))


TURNS = 4
_PLACED = (
    f"placed AS (SELECT *, row_number() OVER (ORDER BY {HASH}, incident_id) - 1 AS place, count(*) OVER () AS n FROM drawn)"
)
_BACK = "paired AS (SELECT a.incident_id, " + ", ".join(f"a.{c} - b.{c} AS {c}" for c in LINEAR) + (
    f" FROM (SELECT *, unnest(range(1, {TURNS + 1})) AS turn FROM placed) a JOIN placed b ON b.place = (a.place + a.turn * 7919 % a.n) % a.n)"
)
_EXACT = " UNION ALL ".join(
    f"SELECT incident_id, 'f{j}' AS feature, {k} AS class_id, round(avg({d(WEIGHTS[k][j])} * {c}), 9) AS phi FROM paired GROUP BY incident_id"
    for k in range(3)
    for j, c in enumerate(LINEAR)
)


@query("x03_sampled_shapley_linear", with_sql(f"{modeling_sql()},\n{_DRAWN},\n{_PLACED},\n{_BACK}", _EXACT))
def x03_sampled_linear(spark, sf):
    """Sampled values of a linear scorer: the weight times the distance to the mean of the backgrounds."""
    drawn = attribution.reproducible_sample(modeling(spark, sf).select("incident_id", *LINEAR), "incident_id")
    sample = drawn.select("incident_id", F.array(*[F.col(c).cast("double") for c in LINEAR]).alias("x"))

    def scorer(df):
        x = vector_to_array("features")
        margins = [sum((x[j] * F.lit(w) for j, w in enumerate(row)), F.lit(0.0)) for row in WEIGHTS]
        return df.withColumn("probability", F.array(*margins)).drop("features")

    # Nine places: the exact values have seven, so no rounding lies on an edge.
    return rounded(attribution.sampled_shapley(sample, "incident_id", scorer, len(LINEAR), len(WEIGHTS), permutations=TURNS), 9)


@query("x03_sampled_shapley")
def x03_sampled(spark, sf):
    model, _ = fitted(spark, sf, Forest(trees=5, max_depth=5))
    encoder, forest = model.stages
    encoded = encoder.transform(small_rows(spark, sf))
    sample = attribution.reproducible_sample(
        encoded.select("incident_id", vector_to_array("features").alias("x")), "incident_id"
    )

    def scorer(df):
        return forest.transform(df).drop("features")

    phi = attribution.sampled_shapley(sample, "incident_id", scorer, encoder.width(), K, permutations=4, names=encoder.slot_names())
    return rounded(attribution.global_importance(phi))


@query("x08_explanation")
def x08(spark, sf):
    """Fit on all rows, then names, split counts and sampled attributions of one plan, side by side."""
    found = explanation.explain(SMALL_FOREST, modeling(spark, sf), permutations=2).tables()
    both = found["shap_global_importance"].join(found["tree_importance"], "feature", "left")
    return rounded(both)


_CELLS = " UNION ALL ".join(
    f"SELECT o_orderkey AS row_id, 'f{f}' AS feature, {c} AS class_id, "
    f"CAST((o_orderkey*{f + 3} + {17 * c}) % 101 - 50 AS DOUBLE) / {d(100)} AS phi FROM orders"
    for f in range(10)
    for c in range(7)
)


@query(
    "x05_global_importance",
    with_sql(
        f"phi AS ({_CELLS}), mean AS (SELECT feature, avg(abs(phi)) AS m FROM phi GROUP BY feature)",
        f"SELECT feature, {r('m', 'mean_absolute_shap')}, CAST(row_number() OVER (ORDER BY round(m, 10) DESC, feature) AS INTEGER) AS rank FROM mean",
    ),
)
def x05(spark, sf):
    return rounded(attribution.global_importance(fixtures.contributions(spark, sf)))


@query(
    "x06_class_distribution",
    with_sql(
        f"phi AS ({_CELLS})",
        f"SELECT feature, count(*) AS rows, {r('min(phi)', 'low')}, {r('max(phi)', 'high')}, {r('avg(abs(phi))', 'mean_abs')}, "
        f"{r('quantile_cont(phi, 0.25)', 'q25')}, {r('quantile_cont(phi, 0.5)', 'q50')}, {r('quantile_cont(phi, 0.75)', 'q75')} "
        "FROM phi WHERE class_id = 2 GROUP BY feature",
    ),
)
def x06(spark, sf):
    wanted = attribution.class_id_of("C2", CLASSES)
    one = attribution.class_slice(fixtures.contributions(spark, sf), wanted, K)
    return rounded(attribution.distribution(one))
