"""Fitted transforms: learned on the development period (or one year), applied to all rows."""

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from blotter.operators import encoding, features, quantiles
from blotter.operators.geo import MODES, GeoEncoder, GeoEncoderModel
from blotter.plans import assemble
from blotter.session import cached
from blotter.sources import fixtures
from workload.base import d, frame_sql, modeling, query, r, rounded, with_sql

TS = "incident_timestamp"
LIMIT = f"TIMESTAMP '{fixtures.TEST_START}'"
EARLY = f"{TS} < timestamp_ntz'{fixtures.TEST_START}'"
FIRST_YEAR = "1996-01-01"
NUMBERS = ("longitude", "latitude", "block_number", "datetime_numeric")
LEVELS = ("pd_district", "street_1", "street_pair")


def rows_with(spark, sf, columns):
    keep = ("incident_id", TS)
    wanted = features.feature_frame(modeling(spark, sf), keep=keep)
    return wanted.select(*keep, *columns)


def fitted_numbers(spark, sf, strategy, columns=NUMBERS, **options):
    rows = rows_with(spark, sf, columns)
    with cached(rows.filter(EARLY).select(*columns)) as train:
        params = encoding.fit_numeric(train, columns, strategy, **options)
    return rounded(rows.select("incident_id", *[encoding.numeric_expression(c, params[c]).alias(c) for c in columns]))


TRAIN = f"train AS (SELECT * FROM frame WHERE {TS} < {LIMIT})"
MEDIANS = "med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUMBERS) + " FROM train)"


def filled(c):
    return f"coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med))"


FILLED = "filled AS (SELECT " + ", ".join(f"{filled(c)} AS {c}" for c in NUMBERS) + " FROM train)"


def number_query(final, more=""):
    return with_sql(f"{frame_sql()},\n{TRAIN},\n{MEDIANS},\n{FILLED}{more}", final)


_IMPUTED = "SELECT incident_id, " + ", ".join(r(filled(c), c) for c in NUMBERS) + " FROM frame"


@query("t02_median_imputation", number_query(_IMPUTED))
def t02(spark, sf):
    return fitted_numbers(spark, sf, "passthrough")


@query("t05_passthrough", number_query(_IMPUTED))
def t05(spark, sf):
    encoder = encoding.ColumnEncoder("passthrough", "ordinal", skip=("incident_id", TS), output="columns")
    rows = rows_with(spark, sf, NUMBERS)
    with cached(rows.filter(EARLY)) as train:
        model = encoder.fit(train)
    return rounded(model.transform(rows).drop(TS))


_STANDARD = "SELECT incident_id, " + ", ".join(
    r(f"({filled(c)} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled)", c) for c in NUMBERS
) + " FROM frame"


@query("t03_standard_scaling", number_query(_STANDARD))
def t03(spark, sf):
    return fitted_numbers(spark, sf, "standard")


_ROBUST = "SELECT incident_id, " + ", ".join(
    r(
        f"({filled(c)} - (SELECT median({c}) FROM filled)) / "
        f"(SELECT CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) "
        f"THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END FROM filled)",
        c,
    )
    for c in NUMBERS
) + " FROM frame"


@query("t04_robust_scaling", number_query(_ROBUST))
def t04(spark, sf):
    return fitted_numbers(spark, sf, "robust")


def edges_sql(columns, bins=10):
    """Bin edges per feature: means of both neighbours where the rank falls on a step."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM filled" for c in columns)
    probs = ", ".join(f"({i}, {d(i / bins)})" for i in range(bins + 1))
    return f""",
ord AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn,
  count(*) OVER (PARTITION BY feature) AS n FROM ({long}) u),
probs(i, p) AS (VALUES {probs}),
quant AS (SELECT feature, i, avg(value) AS edge FROM ord JOIN probs
  ON rn = least(floor(n*p), n-1) OR (n*p = floor(n*p) AND rn = greatest(floor(n*p)-1, 0)) GROUP BY 1, 2),
kept AS (SELECT feature, i, edge FROM (SELECT *, edge - lag(edge) OVER (PARTITION BY feature ORDER BY i) AS gap FROM quant) q
  WHERE gap IS NULL OR gap > 1e-8),
inner_edges AS (SELECT feature, edge FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY i) AS a,
  row_number() OVER (PARTITION BY feature ORDER BY i DESC) AS z FROM kept) k WHERE a > 1 AND z > 1)"""


def binned(c):
    return (
        f"CAST((SELECT count(*) FROM inner_edges e WHERE e.feature = '{c}' AND e.edge <= {filled(c)}) AS INTEGER) AS {c}"
    )


@query(
    "t06_quantile_bins",
    number_query("SELECT incident_id, " + ", ".join(binned(c) for c in NUMBERS) + " FROM frame", edges_sql(NUMBERS)),
)
def t06(spark, sf):
    return fitted_numbers(spark, sf, "binned")


@query(
    "t06_exact_quantiles",
    with_sql(
        f"{frame_sql()},\n{TRAIN}",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont(CAST({c} AS DOUBLE), {p})', 'value')} FROM train"
            for c in NUMBERS
            for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
        ),
    ),
)
def t06_quantiles(spark, sf):
    # Narrowing brackets, the way columns with very many distinct values are handled.
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    with cached(rows_with(spark, sf, NUMBERS).filter(EARLY).select(*NUMBERS)) as rows:
        found = quantiles.exact_quantiles(rows, NUMBERS, probs, few_values=0)
    table = [(c, p, v) for c, values in found.items() for p, v in zip(probs, values)]
    return rounded(spark.createDataFrame(table, "feature string, prob double, value double"))


@query(
    "t07_constant_imputation",
    with_sql(frame_sql(), "SELECT incident_id, coalesce(street_2, 'UNKNOWN') AS street_2 FROM frame"),
)
def t07(spark, sf):
    return modeling(spark, sf).select("incident_id", F.coalesce("street_2", F.lit(encoding.MISSING)).alias("street_2"))


def fitted_levels(spark, sf, kind, **options):
    """Encoder fitted on the first year only, so that later rows bring unseen levels."""
    rows = rows_with(spark, sf, LEVELS)
    encoder = encoding.ColumnEncoder("passthrough", kind, skip=("incident_id", TS), output="columns", **options)
    return encoder.fit(rows.filter(f"{TS} < timestamp_ntz'{FIRST_YEAR}'")), rows


def level_query(value, default, suffix=""):
    ctes = [frame_sql(), f"first AS (SELECT * FROM frame WHERE {TS} < TIMESTAMP '{FIRST_YEAR}')"]
    for c in LEVELS:
        ctes.append(
            f"l_{c} AS (SELECT {c} AS level, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code, "
            f"count(*) / CAST((SELECT count(*) FROM first) AS DOUBLE) AS share FROM first GROUP BY {c})"
        )
    cells = ", ".join(value.format(c=c, default=default) + f" AS {c}{suffix}" for c in LEVELS)
    joins = " ".join(f"LEFT JOIN l_{c} ON frame.{c} = l_{c}.level" for c in LEVELS)
    return with_sql(",\n".join(ctes), f"SELECT incident_id, {cells} FROM frame {joins}")


@query("t08_one_hot_slots", level_query("l_{c}.code", "", "_slot"))
def t08(spark, sf):
    model, rows = fitted_levels(spark, sf, "onehot")
    hot = model.one_hot(rows)
    place = lambda c: F.array_position(vector_to_array(f"{c}__hot"), F.lit(1.0)).cast("int")
    return hot.select("incident_id", *[(F.nullif(place(c), F.lit(0)) - 1).alias(f"{c}_slot") for c in LEVELS])


@query("t09_ordinal", level_query("coalesce(l_{c}.code, {default})", "-1"))
def t09(spark, sf):
    model, rows = fitted_levels(spark, sf, "ordinal")
    return model.transform(rows).drop(TS)


@query("t10_frequency", level_query("round(coalesce(l_{c}.share, {default}), 6)", "0"))
def t10(spark, sf):
    model, rows = fitted_levels(spark, sf, "frequency")
    return rounded(model.transform(rows).drop(TS))


@query("t11_add_constant", level_query("coalesce(l_{c}.code, {default}) + 1", "-1"))
def t11(spark, sf):
    model, rows = fitted_levels(spark, sf, "ordinal", shift=1)
    return model.transform(rows).drop(TS)


@query("t12_geo_fit")
def t12(spark, sf):
    """Fitted clusters: size and mean distance to the center."""
    rows = modeling(spark, sf).select("incident_id", TS, "longitude", "latitude")
    model = GeoEncoder("all", n_clusters=40).fit(rows.filter(EARLY))
    spread = F.least(*[F.col(f"geo_distance_{i}") for i in range(len(model.centers))])
    return rounded(model.transform(rows).groupBy("geo_cluster").agg(F.count("*").alias("n"), F.avg(spread).alias("spread")))


PLANTED = 12


@query(
    "t12_planted_clusters",
    f"SELECT CAST(o_orderkey % {PLANTED} AS VARCHAR) AS geo_cluster, count(*) AS n FROM orders GROUP BY 1",
)
def t12_planted(spark, sf):
    """Clusters far apart are found whole, numbered from west to east."""
    k = F.col("o_orderkey")
    jitter = lambda prime: (k % prime) / F.lit(1000.0)
    rows = fixtures.spread_table(spark, sf, "orders", "o_orderkey").select(
        (F.lit(10.0) * (k % PLANTED) + jitter(101)).alias("longitude"), (F.lit(7.0) * (k % PLANTED % 5) + jitter(97)).alias("latitude")
    )
    model = GeoEncoder("cluster", n_clusters=PLANTED).fit(rows)
    return model.transform(rows).groupBy("geo_cluster").agg(F.count("*").alias("n"))


CENTERS = fixtures.centers()


def fixed(mode):
    return GeoEncoderModel(mode, {"longitude": -122.45, "latitude": 37.76}, CENTERS)


def _squared(i):
    x, y = CENTERS[i]
    return f"((longitude - {d(x)})*(longitude - {d(x)}) + (latitude - {d(y)})*(latitude - {d(y)}))"


_SQUARES = ", ".join(f"{_squared(i)} AS s{i}" for i in range(8))
_LEAST = "least(" + ", ".join(f"s{i}" for i in range(8)) + ")"
_NEAREST = "CASE " + " ".join(f"WHEN s{i} = {_LEAST} THEN '{i}'" for i in range(8)) + " END AS geo_cluster"
_DISTANCES = ", ".join(r(f"sqrt(s{i})", f"geo_distance_{i}") for i in range(8))


def geo_query(columns):
    return with_sql(f"{frame_sql()},\nsquared AS (SELECT *, {_SQUARES} FROM frame)", f"SELECT incident_id, {columns} FROM squared")


def geo_rows(spark, sf, mode):
    return fixed(mode).transform(modeling(spark, sf).select("incident_id", "longitude", "latitude"))


@query("t13_geo_cluster", geo_query(_NEAREST))
def t13(spark, sf):
    return geo_rows(spark, sf, "cluster")


@query("t14_geo_distances", geo_query(_DISTANCES))
def t14(spark, sf):
    return rounded(geo_rows(spark, sf, "distances"))


_RAW = f"{r('longitude', 'longitude')}, {r('latitude', 'latitude')}"
_BY_MODE = {
    "raw": _RAW,
    "cluster": _NEAREST,
    "distances": _DISTANCES,
    "raw_cluster": f"{_RAW}, {_NEAREST}",
    "raw_distances": f"{_RAW}, {_DISTANCES}",
    "all": f"{_RAW}, {_NEAREST}, {_DISTANCES}",
    "none": "",
}


def _geo_mode(mode):
    columns = _BY_MODE[mode]
    sql = geo_query(columns) if columns else with_sql(frame_sql(), "SELECT incident_id FROM frame")

    @query(f"t15_geo_mode_{mode}", sql)
    def run(spark, sf):
        return rounded(geo_rows(spark, sf, mode))


for _mode in MODES:
    _geo_mode(_mode)


def vectors(spark, sf, stages):
    """Assembled vectors: width, sum and number of non-zero slots per row."""
    rows = features.feature_frame(modeling(spark, sf), keep=("incident_id",))
    before = F.col("datetime_numeric") < 978307200  # the frozen boundary as epoch seconds
    with cached(rows.filter(before)) as train:
        for stage in stages:
            model = stage.fit(train)
            train, rows = model.transform(train), model.transform(rows)
    values = vector_to_array("features")
    filled_slots = F.size(F.filter(values, lambda v: v != 0))
    return rounded(
        rows.select(
            "incident_id",
            F.size(values).alias("slots"),
            filled_slots.alias("filled"),
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
        )
    )


@query("t18_assembled_frequency")
def t18(spark, sf):
    return vectors(spark, sf, assemble.logistic_transform("frequency", "robust", "all", 8))


@query("t19_logistic_transform")
def t19(spark, sf):
    return vectors(spark, sf, assemble.logistic_transform(geo_mode="raw_distances"))


@query("t20_tree_transform")
def t20(spark, sf):
    return vectors(spark, sf, assemble.tree_transform())


TREE_NUMBERS = (
    "incident_year incident_month incident_day incident_hour incident_minute incident_day_of_week_num "
    "incident_day_of_year incident_week_of_year is_weekend longitude latitude block_number is_intersection "
    "datetime_numeric has_block_number"
).split()
TREE_LEVELS = ("pd_district", "street_1", "street_2", "street_pair", "district_hour", "district_day", "district_intersection")


def codes_sql(columns, shift=0, train="train"):
    """Level tables and the coded expression per categorical column."""
    tables = ",\n".join(
        f"l_{c} AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM "
        f"(SELECT DISTINCT coalesce({c}, 'UNKNOWN') AS level FROM {train}) u)"
        for c in columns
    )
    cells = ", ".join(f"CAST(coalesce(l_{c}.code, -1) + {shift} AS INTEGER) AS {c}" for c in columns)
    joins = " ".join(f"LEFT JOIN l_{c} ON coalesce(frame.{c}, 'UNKNOWN') = l_{c}.level" for c in columns)
    return tables, cells, joins


_T, _C, _J = codes_sql(TREE_LEVELS)
_TREE_MEDIANS = "med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in TREE_NUMBERS) + " FROM train)"


@query(
    "t20_tree_columns",
    with_sql(
        f"{frame_sql()},\n{TRAIN},\n{_TREE_MEDIANS},\n{_T}",
        "SELECT incident_id, " + ", ".join(r(filled(c), c) for c in TREE_NUMBERS) + f", {_C} FROM frame {_J}",
    ),
)
def t20_columns(spark, sf):
    rows = rows_with(spark, sf, TREE_NUMBERS + list(TREE_LEVELS))
    encoder = encoding.ColumnEncoder("passthrough", "ordinal", skip=("incident_id", TS), output="columns")
    with cached(rows.filter(EARLY)) as train:
        model = encoder.fit(train)
    return rounded(model.transform(rows).drop(TS))


# Naive Bayes codes: binned numbers, and levels moved up by one.
BAYES_NUMBERS = ("longitude", "latitude", "block_number", "datetime_numeric")
BAYES_LEVELS = ("pd_district", "street_1", "street_2", "district_hour")
_BT, _BC, _BJ = codes_sql(BAYES_LEVELS, 1)


def bayes_codes_sql():
    """CTEs up to ``codes``: one row per incident with all coded columns."""
    cells = ", ".join(binned(c) for c in BAYES_NUMBERS)
    return (
        f"{frame_sql()},\n{TRAIN},\n{MEDIANS},\n{FILLED}{edges_sql(BAYES_NUMBERS)},\n{_BT},\n"
        f"codes AS (SELECT incident_id, target, {TS}, {cells}, {_BC} FROM frame {_BJ})"
    )


def bayes_encoder():
    return encoding.ColumnEncoder(
        "binned", "ordinal", skip=("incident_id", "target", "label", TS), output="columns", shift=1, sparse=False
    )


def bayes_rows(spark, sf):
    keep = ("incident_id", "target", TS)
    rows = features.feature_frame(modeling(spark, sf), keep=keep)
    return rows.select(*keep, *BAYES_NUMBERS, *BAYES_LEVELS)


@query("t21_bayes_codes", with_sql(bayes_codes_sql(), f"SELECT * EXCLUDE (target, {TS}) FROM codes"))
def t21(spark, sf):
    rows = bayes_rows(spark, sf)
    with cached(rows.filter(EARLY)) as train:
        model = bayes_encoder().fit(train)
    return model.transform(rows).drop("target", TS)


@query(
    "t23_label_index",
    with_sql(
        frame_sql(),
        "SELECT incident_id, target, CAST(dense_rank() OVER (ORDER BY target) - 1 AS DOUBLE) AS label FROM frame",
    ),
)
def t23(spark, sf):
    from blotter.operators.splits import class_list

    rows = modeling(spark, sf).select("incident_id", "target")
    return assemble.with_label(rows, class_list(rows))
