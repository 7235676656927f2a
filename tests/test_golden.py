"""Published result tables aggregated again."""

import pytest

from blotter.operators import metrics
from blotter.plans.experiments import summarise
from blotter.plans.suites import SUITES

# Published calibration bins (rows, mean confidence, observed accuracy).
BINS = [
    (0, None, None),
    (19918, 0.17249235949503242, 0.17321016166281755),
    (33893, 0.24566603522135727, 0.24943203611365178),
    (20405, 0.34642074231593983, 0.35584415584415585),
    (13834, 0.44675108790336104, 0.47079658811623537),
    (8206, 0.5451053928612964, 0.5778698513282964),
    (3825, 0.642263130394194, 0.6886274509803921),
    (1704, 0.742516793274655, 0.7799295774647887),
    (557, 0.8436803613359624, 0.8797127468581688),
    (8, 0.9131760905834003, 0.875),
]

# Published F1 scores above zero; 20 further classes were seen with F1 0, one never.
F1 = [
    0.5228573464105061, 0.40999000999001, 0.35137808255307923, 0.28893058161350843, 0.2593001261034048,
    0.23903697334479793, 0.18883787104701547, 0.14969434918741615, 0.08520804300218993, 0.02407318247472316,
    0.016841240501129597, 0.01680672268907563, 0.015964877270005985, 0.012903225806451613, 0.012524461839530333,
    0.007905138339920948, 0.005439709882139619, 0.004920049200492005,
]

# Published fold metrics (log loss, accuracy, top-3, macro F1, seconds, iterations).
FOLDS = {
    "xgboost_finalist": [
        (2.2908749626977274, 0.3091010072201624, 0.5663849652501538, 0.0905318789203801, 234.2268432500132, None),
        (2.2800122925064428, 0.3095593258145014, 0.5712592881738718, 0.0874960643729851, 255.00852329199552, None),
        (2.261028693159446, 0.3236383355818321, 0.5837764198608576, 0.0858514759996064, 267.57151458301814, None),
    ],
}


def test_calibration_error(spark):
    rows = [(n, None if a is None else a - c) for n, c, a in BINS]
    table = spark.createDataFrame(rows, "row_count bigint, calibration_gap double")
    assert metrics.calibration_error(table).first()[0] == pytest.approx(0.011697156413791565, abs=1e-12)


def test_macro_f1_leaves_out_classes_never_seen():
    assert sum(F1) / 38 == pytest.approx(0.06875294713829992, abs=1e-12)


def test_summary(spark):
    rows = [(name, "xgboost", *values) for name, folds in FOLDS.items() for values in folds]
    table = spark.createDataFrame(
        rows,
        "experiment_name string, model_name string, log_loss double, accuracy double, top_3_accuracy double, "
        "macro_f1 double, training_seconds double, model_iterations int",
    )
    got = summarise(table).first()
    assert got["log_loss_mean"] == pytest.approx(2.2773053161212053, abs=1e-12)
    assert got["log_loss_std"] == pytest.approx(0.0151061491519384, abs=1e-12)
    assert got["log_loss_min"] == pytest.approx(2.261028693159446)
    assert got["training_seconds_std"] == pytest.approx(16.840299293914775)
    assert got["model_iterations_mean"] is None
    one = summarise(table.limit(1)).first()
    assert one["log_loss_std"] is None


def test_suites():
    sizes = {name: len(suite()) for name, suite in SUITES.items()}
    assert sum(sizes.values()) == 63 and len(sizes) == 15
    for suite in SUITES.values():
        names = [c.experiment_name for c in suite()]
        assert len(set(names)) == len(names)
        for config in suite():
            config.validate()
