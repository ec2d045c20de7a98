"""Column expressions used across the stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.params import RATIO_EPSILON

# Money is summed in ten-thousandths so that totals do not depend on the order
# in which tasks deliver their part.
MONEY_UNITS = 10_000


def as_timestamp(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def month_text(date: Column) -> Column:
    """``yyyy-MM``, without a detour through the session's time zone."""
    return F.substring(date.cast("string"), 1, 7)


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole 24-hour periods from ``earlier`` to ``later`` (not midnights crossed)."""
    return F.extract(F.lit("DAY"), later - earlier)


def fractional_days(earlier: Column, later: Column) -> Column:
    span = later - earlier
    seconds = (
        F.extract(F.lit("HOUR"), span) * 3600
        + F.extract(F.lit("MINUTE"), span) * 60
        + F.extract(F.lit("SECOND"), span).cast("double")
    )
    return F.extract(F.lit("DAY"), span) + seconds / F.lit(86_400.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator + F.lit(RATIO_EPSILON))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    limit = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (value < limit) & (value > -limit), value)


def money_sum(value: Column) -> Column:
    return F.sum(F.floor(value * MONEY_UNITS + 0.5)) / F.lit(float(MONEY_UNITS))


def money_total(entries: str, name: str) -> Column:
    """What ``money_sum`` gives for field ``name`` of an array of structs; null without values."""
    known = F.filter(entries, lambda e: e[name].isNotNull())
    units = lambda s, e: s + F.floor(e[name] * MONEY_UNITS + 0.5)
    total = F.aggregate(known, F.lit(0).cast("long"), units) / F.lit(float(MONEY_UNITS))
    return F.when(F.size(known) > 0, total)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def clip(value: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; null stays null."""
    bounded = value
    if lower is not None:
        bounded = F.when(value < lower, F.lit(lower)).otherwise(bounded)
    if upper is not None:
        bounded = F.when(value > upper, F.lit(upper)).otherwise(bounded)
    return bounded


def zero_if_undefined(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def text_map(entries: dict[str, str]) -> Column:
    """A literal map; an empty text counts as no entry."""
    pairs = [F.lit(part) for item in entries.items() if item[1] for part in item]
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*pairs)


def lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(text_map(entries), key)


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-up rounding by plain arithmetic, so any engine gives the same double."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 4, skip: Sequence[str] = ()) -> DataFrame:
    doubles = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
    }
    return df.select(
        *[rounded(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )
