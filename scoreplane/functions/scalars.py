"""Numeric, date, hash and validation scalars."""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_avg(c, digits: int = 2) -> Column:
    """H7: ROUND(AVG(x)::numeric, n) half away from zero, returned as double."""
    return F.round(F.avg(_c(c).cast("double")), digits).cast("double")


def percent_of(n, total, digits: int = 2) -> Column:
    """Share of a total in percent, rounded."""
    return F.round(_c(n).cast("double") * 100.0 / _c(total), digits).cast("double")


def day_of_text(c, fmt: str = FV.LOG_TIME_FORMAT) -> Column:
    """H9: DATE(text); malformed text gives NULL instead of failing."""
    return F.to_date(F.try_to_timestamp(_c(c), F.lit(fmt)))


def local_stamp(c, zone: str = FV.LOCAL_ZONE) -> Column:
    """UTC instant -> local wall clock text, whole seconds."""
    return F.date_format(F.from_utc_timestamp(_c(c).cast("timestamp"), zone), FV.LOG_TIME_FORMAT)


def seconds_between(start, end) -> Column:
    """Elapsed seconds with fractions."""
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / 1e6


def prompt_hash(prompt, model) -> Column:
    """H6: SHA-256 hex of ``model|prompt``."""
    return F.sha2(F.concat_ws("|", _c(model), _c(prompt)), 256)


def failure_reason(error) -> Column:
    """Quota-like error text -> 'quota', anything else -> 'error'."""
    low = F.lower(_c(error))
    hit = functools.reduce(lambda a, b: a | b, [low.contains(w) for w in FV.QUOTA_WORDS])
    return F.when(hit, F.lit(FV.REASON_QUOTA)).otherwise(F.lit(FV.REASON_ERROR))


def valid_email(c) -> Column:
    """E-mail format rule."""
    return _c(c).rlike(FV.EMAIL_PATTERN)


def check_iso_date(s: str) -> _dt.date:
    """``YYYY-MM-DD`` argument check (raises on bad input)."""
    return _dt.datetime.strptime(s, "%Y-%m-%d").date()


def check_unit_interval(x: float, name: str = "threshold") -> float:
    """Threshold argument must lie in 0..1."""
    if not (0.0 <= x <= 1.0):
        raise ValueError(f"{name} must be between 0.0 and 1.0, got {x}")
    return x
