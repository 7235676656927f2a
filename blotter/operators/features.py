"""Row-wise features; none of them learns anything from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blotter import schema
from blotter.functions.calendar import cycle
from blotter.schema import require_columns


#: Predictor groups by name.
GROUPS = {
    "calendar": schema.CALENDAR,
    "spatial": schema.SPATIAL,
    "address": schema.ADDRESS,
    "time_trend": schema.TIME_TREND,
    "identifiers": schema.IDENTIFIERS,
}
PREDICTORS = ("calendar", "spatial", "address", "time_trend")


def group_columns(wanted=PREDICTORS, groups: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Columns of the wanted groups in order, each name once."""
    groups = GROUPS if groups is None else groups
    return list(dict.fromkeys(name for group in wanted for name in groups[group]))


def cyclical(df: DataFrame, periods: dict[str, int] | None = None, drop_original: bool = False) -> DataFrame:
    periods = schema.CYCLE_PERIODS if periods is None else periods
    require_columns(df, periods)
    wrong = [name for name, period in periods.items() if period <= 0]
    if wrong:
        raise ValueError(f"cycle periods must be positive: {wrong}")
    added = {}
    for name, period in periods.items():
        added[f"{name}_sin"], added[f"{name}_cos"] = cycle(F.col(name), period)
    df = df.withColumns(added)
    return df.drop(*periods) if drop_original else df


def _joined(left: str, right: str):
    # concat, not concat_ws: a null on either side makes the pair null
    return F.concat(F.col(left).cast("string"), F.lit("__"), F.col(right).cast("string"))


def interactions(
    df: DataFrame,
    district_hour: bool = True,
    district_day: bool = True,
    district_intersection: bool = True,
    coordinates: bool = False,
) -> DataFrame:
    pairs = {
        "district_hour": (district_hour, "incident_hour"),
        "district_day": (district_day, "incident_day_of_week_num"),
        "district_intersection": (district_intersection, "is_intersection"),
    }
    added = {}
    for name, (enabled, other) in pairs.items():
        if enabled:
            require_columns(df, ["pd_district", other])
            added[name] = _joined("pd_district", other)
    if coordinates:
        require_columns(df, ["longitude", "latitude"])
        added["longitude_latitude_interaction"] = F.col("longitude") * F.col("latitude")
    return df.withColumns(added) if added else df


def address_features(df: DataFrame, street_pair: bool = True, block_presence: bool = True) -> DataFrame:
    added = {}
    if street_pair:
        require_columns(df, ["street_1", "street_2"])
        added["street_pair"] = F.concat(
            F.coalesce("street_1", F.lit("UNKNOWN")),
            F.lit("__"),
            F.coalesce("street_2", F.lit("NO_SECOND_STREET")),
        )
    if block_presence:
        require_columns(df, ["block_number"])
        added["has_block_number"] = F.col("block_number").isNotNull().cast("tinyint")
    return df.withColumns(added) if added else df


def base_frame(
    df: DataFrame,
    groups: dict[str, tuple[str, ...]] | None = None,
    time_trend: bool = True,
    identifiers: bool = False,
    keep=(),
) -> DataFrame:
    used = [g for g, on in (("time_trend", time_trend), ("identifiers", identifiers)) if on]
    wanted = group_columns(["calendar", "spatial", "address", *used], groups)
    require_columns(df, wanted)
    extra = [c for c in keep if c in df.columns and c not in wanted]
    return df.select(*extra, *wanted)


def feature_frame(
    df: DataFrame,
    groups: dict[str, tuple[str, ...]] | None = None,
    time_trend: bool = True,
    identifiers: bool = False,
    add_cyclical: bool = True,
    drop_original_cyclical: bool = False,
    add_interactions: bool = True,
    add_address: bool = True,
    keep=(),
) -> DataFrame:
    """The deterministic predictors; ``keep`` carries key and target columns along.

    Interactions need the hour and weekday, so dropping the periodic originals
    comes after them.
    """
    frame = base_frame(df, groups, time_trend, identifiers, keep)
    if add_cyclical:
        frame = cyclical(frame)
    if add_interactions:
        frame = interactions(frame)
    if add_address:
        frame = address_features(frame)
    if add_cyclical and drop_original_cyclical:
        frame = frame.drop(*schema.CYCLE_PERIODS)
    return frame


def from_config(df: DataFrame, config, keep=()) -> DataFrame:
    config.validate()
    return feature_frame(
        df,
        time_trend=config.include_time_trend,
        add_cyclical=config.add_cyclical,
        drop_original_cyclical=config.drop_original_cyclical,
        add_interactions=config.add_interactions,
        add_address=config.add_address_engineering,
        keep=keep,
    )
