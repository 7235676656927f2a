"""Exploratory volumes and run comparison."""

from pyspark.sql import functions as F

from blotter.operators import trends
from blotter.sources import fixtures
from workload.base import modeling, modeling_query, query, rounded

NUMBERS = dict(zip(trends.UNITS, ("a01", "a02", "a03", "a04", "a05")))
BY_CATEGORY = dict(zip(trends.UNITS, ("a06", "a07", "a08", "a09", "a10")))


def _volume(unit, column):
    @query(
        f"{NUMBERS[unit]}_volume_by_{unit}",
        modeling_query(f'SELECT {column} AS "{unit}", count(*) AS incidents FROM modeling GROUP BY 1'),
    )
    def whole(spark, sf):
        return trends.volume(modeling(spark, sf), unit)

    @query(
        f"{BY_CATEGORY[unit]}_category_by_{unit}",
        modeling_query(
            f'SELECT target AS category, {column} AS "{unit}", count(*) AS incidents FROM modeling GROUP BY 1, 2'
        ),
    )
    def split(spark, sf):
        return trends.volume_by_category(modeling(spark, sf), unit)


for _unit, _column in trends.UNITS.items():
    _volume(_unit, _column)

_ALL = " UNION ALL ".join(
    f"SELECT target AS category, '{u}' AS unit, {c} AS value, count(*) AS incidents FROM modeling GROUP BY 1, 3"
    for u, c in trends.UNITS.items()
)


@query("a06_to_a10_all_units", modeling_query(_ALL))
def all_units(spark, sf):
    return trends.all_volumes(modeling(spark, sf))


@query(
    "a11_density",
    modeling_query(
        "SELECT CAST(floor(longitude / CAST('0.01' AS DOUBLE)) AS BIGINT) AS cell_x, "
        "CAST(floor(latitude / CAST('0.01' AS DOUBLE)) AS BIGINT) AS cell_y, count(*) AS incidents "
        "FROM modeling GROUP BY 1, 2"
    ),
)
def a11(spark, sf):
    return trends.density(modeling(spark, sf))


@query(
    "a12_district_mix",
    modeling_query(
        "SELECT district, category, incidents, round(incidents / sum(incidents) OVER (PARTITION BY district), 6) AS share "
        "FROM (SELECT pd_district AS district, target AS category, count(*) AS incidents FROM modeling GROUP BY 1, 2) t"
    ),
)
def a12(spark, sf):
    return rounded(trends.district_mix(modeling(spark, sf)))




def _events(spark, sf):
    return fixtures.table(spark, sf, "events").select(
        F.col("event_type").alias("target"),
        F.hour("ts").alias("incident_hour"),
        (F.dayofweek("ts") - 1).alias("incident_day_of_week_num"),
    )


@query(
    "a01_events_by_hour",
    "SELECT CAST(extract(hour FROM ts) AS INTEGER) AS hour, count(*) AS incidents FROM events GROUP BY 1",
)
def a01_events(spark, sf):
    return trends.volume(_events(spark, sf), "hour")


@query(
    "a07_events_category_by_day",
    "SELECT event_type AS category, CAST(extract(dow FROM ts) AS INTEGER) AS day, count(*) AS incidents FROM events GROUP BY 1, 2",
)
def a07_events(spark, sf):
    return trends.volume_by_category(_events(spark, sf), "day")
