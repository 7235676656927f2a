"""Address parsing.

Two readings exist. ``intended`` treats the patterns as the regular
expressions they were meant to be. ``observed`` reproduces what the doubled
backslashes do in plain SQL text: the patterns match no ordinary address.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODES = ("intended", "observed")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"address mode must be one of {MODES}, not {mode!r}")


def normalise(address: Column, mode: str = "intended") -> Column:
    """One space on either side of each slash, then blanks trimmed."""
    check_mode(mode)
    spacing = r"[\t\n\f\r ]*/[\t\n\f\r ]*" if mode == "intended" else r"\\s*/\\s*"
    return F.trim(F.regexp_replace(address, spacing, " / "))


def intersection_flag(address: Column) -> Column:
    return F.when(address.contains("/"), 1).otherwise(0).cast("int")


def block_number(address: Column) -> Column:
    """Leading digits as int; none, or too large a number, gives null."""
    digits = F.regexp_extract(address, "^([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def first_street(address: Column, mode: str = "intended") -> Column:
    check_mode(mode)
    space = r"[\t\n\f\r ]+" if mode == "intended" else r"\\s+"
    prefix = rf"(?i)^[0-9]+{space}Block of{space}"
    return F.trim(F.regexp_replace(F.split_part(address, F.lit(" / "), F.lit(1)), prefix, ""))


def second_street(address: Column) -> Column:
    """The cross street of an intersection, or null."""
    part = F.trim(F.split_part(address, F.lit(" / "), F.lit(2)))
    return F.when(address.contains("/"), F.nullif(part, F.lit("")))


def address_columns(address: Column, mode: str = "intended") -> dict[str, Column]:
    return {
        "is_intersection": intersection_flag(address),
        "block_number": block_number(address),
        "street_1": first_street(address, mode),
        "street_2": second_street(address),
    }
