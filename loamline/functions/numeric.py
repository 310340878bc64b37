"""Arithmetic that every analysis shares: rounding, decay, scaling. All are column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, for values that are never negative: floor(x * 10^n + 0.5) / 10^n."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5).cast("double") / scale


def rounded_signed(x: Column, digits: int = 4) -> Column:
    """Half away from zero."""
    return F.signum(x) * rounded(F.abs(x), digits)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or the other value where b isn't above 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(otherwise))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high] as 0 to 1; 0 where the range is empty."""
    return F.when(high > low, (x - low).cast("double") / (high - low)).otherwise(F.lit(0.0))


def moment(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


def age_days(date: Column, now: datetime | str) -> Column:
    return (F.unix_micros(moment(now)) - F.unix_micros(date)).cast("double") / float(DAY_MICROS)


def decay(date: Column, now: datetime | str, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_days(date, now) / F.lit(float(half_life)))
