"""Metrics, confusion and calibration over the predictions fixture."""

from pyspark.sql import functions as F

from blotter.functions import probability as prob
from blotter.operators import metrics
from blotter.sources import fixtures
from workload.base import (
    CLASS_COUNTS_SQL,
    d,
    predictions_sql,
    query,
    r,
    rounded,
    scored_query,
    scored_sql,
    with_sql,
)

K = 7
ALL = list(range(K))


def pred(spark, sf, zero_every=None):
    return fixtures.predictions(spark, sf, zero_every)


def wide(df):
    """Probabilities as one column per class."""
    return rounded(df.select("row_id", *[F.col("probability")[i].alias(f"p{i}") for i in range(K)]))


_SHARES = ", ".join(r(f"p{i}/s", f"p{i}") for i in range(6)) + f", {d(0)} AS p6"


@query(
    "e01_align_probabilities",
    with_sql(predictions_sql(), f"SELECT row_id, {_SHARES} FROM (SELECT *, p0+p1+p2+p3+p4+p5 AS s FROM pred) t"),
)
def e01(spark, sf):
    # The model knows six of the seven classes, in its own order.
    known = [5, 0, 1, 2, 3, 4]
    partial = pred(spark, sf).withColumn("probability", F.array(*[F.col("probability")[c] for c in known]))
    return wide(prob.align(partial, known, ALL, "raise"))


_UNIFORM = ", ".join(r(f"CASE WHEN s > 0 THEN p{i}/s ELSE {d(1.0)}/7 END", f"p{i}") for i in range(K))


@query(
    "e02_align_uniform",
    with_sql(predictions_sql(500), f"SELECT row_id, {_UNIFORM} FROM (SELECT *, p0+p1+p2+p3+p4+p5+p6 AS s FROM pred) t"),
)
def e02(spark, sf):
    return wide(prob.align(pred(spark, sf, 500), ALL, ALL, "uniform"))


@query("e03_argmax", scored_query(f"SELECT row_id, predicted, {r('conf', 'confidence')} FROM scored"))
def e03(spark, sf):
    return rounded(
        pred(spark, sf).select("row_id", prob.predicted().alias("predicted"), prob.confidence().alias("confidence"))
    )


@query("e04_log_loss", scored_query(f"SELECT {r('avg(loss)', 'log_loss')} FROM scored"))
def e04(spark, sf):
    return rounded(metrics.log_loss(pred(spark, sf)))


@query(
    "e05_accuracy",
    scored_query(f"SELECT {r('avg(CAST(label = predicted AS INTEGER))', 'accuracy')} FROM scored"),
)
def e05(spark, sf):
    return rounded(metrics.accuracy(pred(spark, sf)))


@query("e06_top_3_accuracy", scored_query(f"SELECT {r('avg(top)', 'top_3_accuracy')} FROM scored"))
def e06(spark, sf):
    return rounded(metrics.top_k_accuracy(pred(spark, sf), K))


def class_query(final, more=""):
    return with_sql(predictions_sql() + "," + scored_sql() + "," + CLASS_COUNTS_SQL + more, final)


@query("e07_macro_f1", class_query(f"SELECT {r('avg(f1)', 'macro_f1')} FROM per"))
def e07(spark, sf):
    return rounded(metrics.macro_f1(pred(spark, sf), K))


_FOUR = (
    f"(SELECT {r('avg(loss)', 'log_loss')} FROM scored) t1, "
    f"(SELECT {r('avg(CAST(label = predicted AS INTEGER))', 'accuracy')}, {r('avg(top)', 'top_3_accuracy')}, "
    f"count(*) AS test_rows FROM scored) t2, (SELECT {r('avg(f1)', 'macro_f1')} FROM per) t3"
)


@query(
    "e08_evaluate_predictions",
    class_query(f"SELECT log_loss, accuracy, top_3_accuracy, macro_f1 FROM {_FOUR}"),
)
def e08(spark, sf):
    return rounded(metrics.overall(pred(spark, sf), K).drop("test_rows"))


@query(
    "e09_overall_metrics",
    class_query(f"SELECT 'fixture' AS experiment_name, log_loss, accuracy, top_3_accuracy, macro_f1, test_rows FROM {_FOUR}"),
)
def e09(spark, sf):
    return rounded(metrics.overall(pred(spark, sf), K).withColumn("experiment_name", F.lit("fixture")))


# Nine class names: two never occur, neither as truth nor as prediction.
NAMES = fixtures.CLASSES + ["C7", "C8"]
_TABLE = """,
names AS (SELECT i AS class_id, 'C' || i AS name FROM range(9) t(i)),
full_table AS (
 SELECT name AS crime_category,
  CASE WHEN coalesce(guessed,0) > 0 THEN tp/guessed ELSE 0 END AS precision,
  CASE WHEN coalesce(support,0) > 0 THEN tp/support ELSE 0 END AS recall,
  coalesce(f1, 0) AS f1_score, CAST(coalesce(support, 0) AS BIGINT) AS support
 FROM names LEFT JOIN per USING (class_id))"""
_CELLS = (
    f"crime_category, {r('CAST(precision AS DOUBLE)', 'precision')}, {r('CAST(recall AS DOUBLE)', 'recall')}, "
    f"{r('CAST(f1_score AS DOUBLE)', 'f1_score')}, support"
)


def per_class(spark, sf):
    return metrics.per_class(nine(spark, sf), NAMES)


def nine(spark, sf):
    """The predictions with two more classes that always have probability 0."""
    return pred(spark, sf).withColumn("probability", F.concat("probability", F.array(F.lit(0.0), F.lit(0.0))))


@query("e10_per_class", class_query(f"SELECT {_CELLS} FROM full_table", _TABLE))
def e10(spark, sf):
    return rounded(per_class(spark, sf).drop("f1_rank"))


@query(
    "e11_f1_rank",
    class_query(
        "SELECT crime_category, CAST(rank() OVER (ORDER BY f1_score DESC) AS INTEGER) AS f1_rank FROM full_table", _TABLE
    ),
)
def e11(spark, sf):
    return metrics.ranked(per_class(spark, sf)).select("crime_category", "f1_rank")


_GRID = """,
cells AS (
 SELECT a.i AS label, b.i AS predicted, count(s.row_id) AS n
 FROM {rows} a CROSS JOIN {rows} b LEFT JOIN scored s ON s.label = a.i AND s.predicted = b.i GROUP BY 1, 2)"""
_CELL = (
    "SELECT CAST(label AS INTEGER) AS label, CAST(predicted AS INTEGER) AS predicted, n, "
    + r("CAST(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n / sum(n) OVER (PARTITION BY label) ELSE 0 END AS DOUBLE)", "share")
    + " FROM cells"
)


@query("e12_confusion_matrix", class_query(_CELL, _GRID.format(rows="range(9)").replace("a CROSS", "a(i) CROSS").replace("b LEFT", "b(i) LEFT")))
def e12(spark, sf):
    return rounded(metrics.confusion(nine(spark, sf), 9))


# With seven classes the five most frequent play the part of the fifteen.
_TOP5 = """,
top5 AS (SELECT label AS i FROM scored GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)"""


@query("e13_top_class_confusion", class_query(_CELL, _TOP5 + _GRID.format(rows="top5")))
def e13(spark, sf):
    return rounded(metrics.top_confusion(pred(spark, sf), K, top=5))


@query(
    "e14_leaderboard",
    class_query(
        f"SELECT {_CELLS} FROM (SELECT * FROM full_table WHERE support >= 100 ORDER BY f1_score DESC, support DESC, crime_category LIMIT 20) t",
        _TABLE,
    ),
)
def e14(spark, sf):
    return rounded(metrics.leaderboard(per_class(spark, sf)).drop("f1_rank"))


@query(
    "e14_laggards",
    class_query(
        f"SELECT {_CELLS} FROM (SELECT * FROM full_table WHERE support >= 100 ORDER BY f1_score, support, crime_category DESC LIMIT 3) t",
        _TABLE,
    ),
)
def e14_worst(spark, sf):
    return rounded(metrics.laggards(per_class(spark, sf), worst=3).drop("f1_rank"))


EDGES = metrics.edges(10)
_BIN = " + ".join(f"CAST(conf > {d(e)} AS INTEGER)" for e in EDGES[1:-1])
_BORDERS = ", ".join(f"({i}, {d(a)}, {d(b)})" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
_BINS = f""",
borders(b, lo, hi) AS (VALUES {_BORDERS}),
calib AS (
 SELECT b + 1 AS bin, lo AS bin_lower, hi AS bin_upper, count(c.row_id) AS row_count, avg(conf) AS mean_confidence,
  avg(CAST(label = predicted AS INTEGER)) AS observed_accuracy,
  avg(CAST(label = predicted AS INTEGER)) - avg(conf) AS calibration_gap
 FROM borders LEFT JOIN (SELECT *, {_BIN} AS bin_id FROM scored) c ON c.bin_id = b GROUP BY 1, 2, 3)"""


@query(
    "e15_calibration_bins",
    class_query(
        f"SELECT CAST(bin AS INTEGER) AS bin, {r('bin_lower', 'bin_lower')}, {r('bin_upper', 'bin_upper')}, row_count, "
        f"{r('mean_confidence', 'mean_confidence')}, {r('observed_accuracy', 'observed_accuracy')}, "
        f"{r('calibration_gap', 'calibration_gap')} FROM calib",
        _BINS,
    ),
)
def e15(spark, sf):
    return rounded(metrics.calibration_table(pred(spark, sf), K))


_ECE = "sum(row_count * abs(calibration_gap)) / sum(row_count)"


@query("e16_calibration_error", class_query(f"SELECT {r(_ECE, 'expected_calibration_error')} FROM calib", _BINS))
def e16(spark, sf):
    return rounded(metrics.calibration_error(metrics.calibration_table(pred(spark, sf), K)))


@query("e17_brier_score", scored_query(f"SELECT {r('avg(brier)', 'multiclass_brier_score')} FROM scored"))
def e17(spark, sf):
    return rounded(metrics.brier_score(pred(spark, sf), K))


_SUMMARY = (
    f"SELECT expected_calibration_error, multiclass_brier_score, mean_confidence, observed_accuracy, confidence_bias, test_rows "
    f"FROM (SELECT {r(_ECE, 'expected_calibration_error')} FROM calib) a, "
    f"(SELECT {r('avg(brier)', 'multiclass_brier_score')}, {r('avg(conf)', 'mean_confidence')}, "
    f"{r('avg(CAST(label = predicted AS INTEGER))', 'observed_accuracy')}, "
    f"{r('avg(conf) - avg(CAST(label = predicted AS INTEGER))', 'confidence_bias')}, count(*) AS test_rows FROM scored) b"
)


@query("e18_calibration_summary", class_query(_SUMMARY, _BINS))
def e18(spark, sf):
    return rounded(metrics.calibration_summary(pred(spark, sf), K))


@query(
    "e19_reliability",
    class_query(
        f"SELECT CAST(bin AS INTEGER) AS bin, {r('mean_confidence', 'mean_confidence')}, "
        f"{r('observed_accuracy', 'observed_accuracy')} FROM calib WHERE row_count > 0",
        _BINS,
    ),
)
def e19(spark, sf):
    return rounded(metrics.reliability(metrics.calibration_table(pred(spark, sf), K)))


_SLOT = " + ".join(f"CAST(conf >= {d(e)} AS INTEGER)" for e in metrics.edges(20)[1:-1])


@query(
    "e20_confidence_histogram",
    scored_query(
        f"SELECT CAST(i AS INTEGER) AS slot, count(s.row_id) AS n FROM range(20) t(i) LEFT JOIN "
        f"(SELECT row_id, {_SLOT} AS slot FROM scored) s ON s.slot = i GROUP BY 1"
    ),
)
def e20(spark, sf):
    return metrics.confidence_histogram(pred(spark, sf))


@query(
    "e21_top_labels",
    scored_query("SELECT label, count(*) AS n FROM scored GROUP BY label ORDER BY n DESC, label LIMIT 15"),
)
def e21(spark, sf):
    return metrics.label_frequency(pred(spark, sf))
