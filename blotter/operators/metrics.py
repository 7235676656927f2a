"""Multiclass metrics over a predictions table.

Input rows hold ``label`` (class index) and ``probability`` (array in class
order). One scan builds a ledger with at most K x K rows - count and summed
losses per (label, predicted) - and every metric here is read off the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blotter.functions import probability as prob


def ledger(predictions: DataFrame, n: int, k: int = 3, group=()) -> DataFrame:
    """Counts and loss sums per true and predicted class (and ``group`` columns)."""
    scored = predictions.select(
        *group,
        F.col("label").cast("int").alias("label"),
        prob.predicted().alias("predicted"),
        prob.neg_log().alias("loss"),
        prob.in_top_k(n, k).alias("top"),
    )
    return scored.groupBy(*group, "label", "predicted").agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("top").alias("top")
    )


def _by_class(book: DataFrame, group=()) -> DataFrame:
    """True positives, support and predicted count per class from the ledger."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")

    def entry(klass, tp, support, guessed):
        return F.struct(
            klass.cast("int").alias("class_id"), tp.alias("tp"), support.alias("support"), guessed.alias("guessed")
        )

    sides = F.array(
        entry(F.col("label"), hit, F.col("n"), none),
        entry(F.col("predicted"), none, none, F.col("n")),
    )
    return (
        book.select(*group, F.explode(sides).alias("s"))
        .select(*group, "s.*")
        .groupBy(*group, "class_id")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1(tp: Column, support: Column, guessed: Column) -> Column:
    return _ratio(2 * tp, support + guessed)


def overall(predictions: DataFrame, n: int, k: int = 3, group=()) -> DataFrame:
    """Log loss, accuracy, top-k accuracy, macro F1 and row count.

    Macro F1 averages over the classes seen as truth or as prediction.
    """
    book = ledger(predictions, n, k, group)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    # Each ledger row feeds the totals once and the class counts of two classes.
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("class_id"), hit.cast("bigint").alias("tp"), F.col("n").alias("support"),
            none.alias("guessed"), F.col("loss").alias("loss"), F.col("top").alias("top"),
        ),
        F.struct(
            F.col("predicted").alias("class_id"), none.alias("tp"), none.alias("support"),
            F.col("n").alias("guessed"), F.lit(0.0).alias("loss"), none.alias("top"),
        ),
    )
    per_class = (
        book.select(*group, F.explode(sides).alias("s"))
        .select(*group, "s.*")
        .groupBy(*group, "class_id")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "guessed", "loss", "top")])
    )
    rows = F.sum("support")
    return per_class.groupBy(*group).agg(
        (F.sum("loss") / rows).alias("log_loss"),
        (F.sum("tp") / rows).alias("accuracy"),
        (F.sum("top") / rows).alias("top_3_accuracy"),
        F.avg(f1(F.col("tp"), F.col("support"), F.col("guessed"))).alias("macro_f1"),
        rows.alias("test_rows"),
    )


def log_loss(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg(prob.neg_log()).alias("log_loss"))


def accuracy(predictions: DataFrame) -> DataFrame:
    right = prob.predicted() == F.col("label")
    return predictions.agg(F.avg(right.cast("double")).alias("accuracy"))


def top_k_accuracy(predictions: DataFrame, n: int, k: int = 3) -> DataFrame:
    hit = prob.in_top_k(n, k)
    return predictions.agg(F.avg(hit.cast("double")).alias("top_3_accuracy"))


def macro_f1(predictions: DataFrame, n: int) -> DataFrame:
    per_class = _by_class(ledger(predictions, n))
    return per_class.agg(F.avg(f1(F.col("tp"), F.col("support"), F.col("guessed"))).alias("macro_f1"))


def _class_rows(spark, n: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class_id"))


def per_class(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall, F1, support and F1 rank of *every* class."""
    n = len(classes)
    zero = _class_rows(predictions.sparkSession, n).select(
        "class_id", *[F.lit(0).cast("bigint").alias(c) for c in ("tp", "support", "guessed")]
    )
    counts = (
        _by_class(ledger(predictions, n))
        .unionByName(zero)
        .groupBy("class_id")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "guessed")])
    )
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("class_id") + 1)
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    table = counts.select(
        name.alias("crime_category"),
        _ratio(tp, guessed).alias("precision"),
        _ratio(tp, support).alias("recall"),
        f1(tp, support, guessed).alias("f1_score"),
        support.alias("support"),
    )
    # One row per class: a window without partition is bounded by the class list.
    return table.withColumn("f1_rank", F.rank().over(Window.orderBy(F.desc("f1_score"))))


def ranked(per_class_table: DataFrame) -> DataFrame:
    return per_class_table.orderBy(F.desc("f1_score"), F.desc("support"), "crime_category")


def leaderboard(per_class_table: DataFrame, min_support: int = 100, best: int = 20) -> DataFrame:
    """The best classes among those with enough support."""
    return ranked(per_class_table.filter(F.col("support") >= min_support)).limit(best)


def laggards(per_class_table: DataFrame, min_support: int = 100, worst: int = 10) -> DataFrame:
    """The last rows of the ordered table of supported classes."""
    backwards = per_class_table.filter(F.col("support") >= min_support).orderBy(
        "f1_score", "support", F.desc("crime_category")
    )
    return backwards.limit(worst)


def confusion(predictions: DataFrame, n: int) -> DataFrame:
    """All K x K cells with counts and the share of the true class; empty rows are 0."""
    spark = predictions.sparkSession
    index = F.sequence(F.lit(0), F.lit(n - 1))
    grid = (
        spark.range(1)
        .select(F.explode(index).alias("label"))
        .select("label", F.explode(index).alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    )
    cells = (
        ledger(predictions, n)
        .select("label", "predicted", "n")
        .unionByName(grid)
        .groupBy("label", "predicted")
        .agg(F.sum("n").alias("n"))
    )
    row_total = F.sum("n").over(Window.partitionBy("label"))
    return cells.withColumn("share", _ratio(F.col("n"), row_total))


def label_frequency(predictions: DataFrame, top: int = 15) -> DataFrame:
    return (
        predictions.groupBy(F.col("label").cast("int").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(top)
    )


def top_confusion(predictions: DataFrame, n: int, top: int = 15) -> DataFrame:
    """Confusion among the most frequent true classes.

    Predictions outside them are dropped before normalising, so the diagonal is
    not recall. The ledger is ranked in place: it has at most K x K rows.
    """
    book = ledger(predictions, n).select("label", "predicted", "n")
    totals = Window.partitionBy("label")
    by_size = Window.orderBy(F.desc("total"), "label")
    placed = book.withColumn("total", F.sum("n").over(totals)).withColumn("place", F.dense_rank().over(by_size))
    rows = placed.filter(F.col("place") <= top)
    # The kept classes as one array: at most ``top`` entries.
    kept = F.collect_set("label").over(Window.partitionBy(F.lit(1)))
    inside = rows.withColumn("kept", kept).filter(F.array_contains("kept", F.col("predicted")))
    index = F.col("kept")
    grid = inside.select(F.explode(index).alias("label"), "kept").distinct().select(
        "label", F.explode("kept").alias("predicted"), F.lit(0).cast("bigint").alias("n")
    )
    cells = inside.select("label", "predicted", "n").unionByName(grid).groupBy("label", "predicted").agg(
        F.sum("n").alias("n")
    )
    return cells.withColumn("share", _ratio(F.col("n"), F.sum("n").over(totals)))


# --- calibration -----------------------------------------------------------


def edges(bins: int) -> list[float]:
    """Equal-width edges on [0, 1], computed as step times index."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_bin(bins: int, name: str = "confidence") -> Column:
    """Zero-based right-closed bin; the first one also takes 0."""
    inner = edges(bins)[1:-1]
    return F.expr(" + ".join(f"cast({name} > {prob.number(e)} as int)" for e in inner) or "0")


def _confidence_rows(predictions: DataFrame, n: int) -> DataFrame:
    return predictions.select(
        prob.confidence().alias("confidence"),
        (prob.predicted() == F.col("label")).cast("int").alias("correct"),
        prob.brier(n).alias("brier"),
    )


def _bin_sums(predictions: DataFrame, n: int, bins: int) -> DataFrame:
    rows = _confidence_rows(predictions, n)
    return rows.groupBy(calibration_bin(bins).alias("bin_id")).agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("confidence"),
        F.sum("correct").alias("correct"),
        F.sum("brier").alias("brier"),
    )


def calibration_table(predictions: DataFrame, n: int, bins: int = 10) -> DataFrame:
    """One row per bin; empty bins keep nulls."""
    borders = edges(bins)
    sums = _bin_sums(predictions, n, bins).drop("brier")
    empty = _class_rows(predictions.sparkSession, bins).select(
        F.col("class_id").alias("bin_id"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("bigint").alias("correct"),
    )
    full = sums.unionByName(empty).groupBy("bin_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "confidence", "correct")]
    )
    lower, upper = (F.array(*[F.lit(e) for e in part]) for part in (borders[:-1], borders[1:]))
    return full.select(
        (F.col("bin_id") + 1).alias("bin"),
        F.element_at(lower, F.col("bin_id") + 1).alias("bin_lower"),
        F.element_at(upper, F.col("bin_id") + 1).alias("bin_upper"),
        F.col("n").alias("row_count"),
        F.try_divide("confidence", "n").alias("mean_confidence"),
        F.try_divide("correct", "n").alias("observed_accuracy"),
        (F.try_divide("correct", "n") - F.try_divide("confidence", "n")).alias("calibration_gap"),
    )


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error from a calibration table."""
    return table.agg(
        (F.sum(F.col("row_count") * F.abs("calibration_gap")) / F.sum("row_count")).alias("expected_calibration_error")
    )


def reliability(table: DataFrame) -> DataFrame:
    return table.filter(F.col("row_count") > 0).select("bin", "mean_confidence", "observed_accuracy")


def brier_score(predictions: DataFrame, n: int) -> DataFrame:
    return predictions.agg(F.avg(prob.brier(n)).alias("multiclass_brier_score"))


def calibration_summary(predictions: DataFrame, n: int, bins: int = 10) -> DataFrame:
    """All calibration scalars from one scan and a table of ``bins`` rows."""
    rows = F.sum("n")
    gap = F.abs(F.col("correct") - F.col("confidence"))
    return _bin_sums(predictions, n, bins).agg(
        (F.sum(gap) / rows).alias("expected_calibration_error"),
        (F.sum("brier") / rows).alias("multiclass_brier_score"),
        (F.sum("confidence") / rows).alias("mean_confidence"),
        (F.sum("correct") / rows).alias("observed_accuracy"),
        ((F.sum("confidence") - F.sum("correct")) / rows).alias("confidence_bias"),
        rows.alias("test_rows"),
    )


def confidence_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    """Left-closed equal bins on [0, 1]; the last bin is closed on both sides."""
    slot = " + ".join(f"cast(confidence >= {prob.number(e)} as int)" for e in edges(bins)[1:-1])
    rows = predictions.select(prob.confidence().alias("confidence"))
    counts = rows.groupBy(F.expr(slot).alias("slot")).agg(F.count("*").alias("n"))
    empty = _class_rows(predictions.sparkSession, bins).select(
        F.col("class_id").alias("slot"), F.lit(0).cast("bigint").alias("n")
    )
    return counts.unionByName(empty).groupBy("slot").agg(F.sum("n").alias("n"))
