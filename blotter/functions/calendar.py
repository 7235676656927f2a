"""Calendar fields of a zone-less timestamp."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_of_week(ts: Column) -> Column:
    """Sunday is 0, Saturday is 6."""
    return (F.dayofweek(ts) - 1).cast("int")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as double, fraction kept, independent of the session zone."""
    whole = F.unix_date(ts.cast("date")).cast("double") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole + F.date_part(F.lit("SECOND"), ts).cast("double")


def weekend_flag(day_name: Column) -> Column:
    """Taken from the weekday *name*; any other text, or null, gives 0."""
    return F.when(day_name.isin("Saturday", "Sunday"), 1).otherwise(0).cast("int")


def calendar_columns(ts: Column, day_name: Column) -> dict[str, Column]:
    return {
        "incident_year": F.year(ts),
        "incident_month": F.month(ts),
        "incident_day": F.dayofmonth(ts),
        "incident_hour": F.hour(ts),
        "incident_minute": F.minute(ts),
        "incident_day_of_week_num": day_of_week(ts),
        "incident_day_of_year": F.dayofyear(ts),
        "incident_week_of_year": F.weekofyear(ts),
        "datetime_numeric": epoch_seconds(ts),
        "is_weekend": weekend_flag(day_name),
    }


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value; text that is no number gives null."""
    angle = F.lit(2 * 3.141592653589793) * value.try_cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
