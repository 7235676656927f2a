"""Every table of the final report, exported as CSV and read again, against the SQL of its query."""

from blotter.session import scratch_path
from blotter.sources import results
from workload import assembled, diagnostics, explain, runs  # noqa: F401
from workload.base import QUERIES, SQL, query

#: Exported table, and the query whose rows it holds.
TABLES = {
    "frozen_test_metrics": "m11_frozen_prior",
    "calibration_bins": "e15_calibration_bins",
    "calibration_summary": "e18_calibration_summary",
    "confusion_matrix": "e12_confusion_matrix",
    "top_class_confusion": "e13_top_class_confusion",
    "leaderboard": "e14_leaderboard",
    "reliability": "e19_reliability",
    "confidence_histogram": "e20_confidence_histogram",
    "shap_global_importance": "x05_global_importance",
    "experiment_fold_results": "c04_prior_folds",
    "experiment_summary_results": "c05_summary",
}


def _export(name, source):
    @query(f"s09_{name}", SQL[source])
    def run(spark, sf):
        table = QUERIES[source](spark, sf)
        place = results.export_all({name: table}, scratch_path(spark, "dashboard"))[name]
        return spark.read.schema(table.schema).option("header", True).csv(place)


for _name, _source in TABLES.items():
    _export(_name, _source)
