"""Predicates, projections, ordering and paging."""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.scalars import check_iso_date, check_unit_interval, day_of_text


def conjunction(conds: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conds, F.lit(True))


def newest_first(df: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """order by time descending; the id breaks ties deterministically."""
    return df.orderBy(F.desc(ts), F.desc(tie))


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """LIMIT/OFFSET; OFFSET alone is ignored, as in the original."""
    if limit is None:
        return df
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def list_candidates(df: DataFrame, bias_threshold: float | None = None,
                    min_ats: int | None = None, limit: int | None = None,
                    offset: int = 0) -> DataFrame:
    """B1: optional ``bias >= t`` and ``ats >= m``, newest first, paged."""
    conds = []
    if bias_threshold is not None:
        conds.append(F.col("bias_score") >= F.lit(float(bias_threshold)))
    if min_ats is not None:
        conds.append(F.col("ats_score") >= F.lit(min_ats))
    out = df.where(conjunction(conds)) if conds else df
    return page(newest_first(out), limit, offset)


def between_dates(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """B2: DATE(ts) between two ISO dates, both ends inclusive, newest first."""
    s, e = check_iso_date(start), check_iso_date(end)
    day = F.to_date(ts)
    return newest_first(df.where((day >= F.lit(s)) & (day <= F.lit(e))), ts)


def by_id(df: DataFrame, id_value: int, id_col: str = "id") -> DataFrame:
    """Point lookup."""
    return df.where(F.col(id_col) == F.lit(id_value))


def flagged(df: DataFrame, threshold: float = FV.BIAS_THRESHOLD) -> DataFrame:
    """Strictly above the threshold, six columns, highest first."""
    check_unit_interval(threshold)
    return (df.where(F.col("bias_score") > F.lit(float(threshold)))
              .select("resume_name", "candidate_name", "ats_score", "bias_score", "domain", "timestamp")
              .orderBy(F.desc("bias_score"), F.desc("timestamp"), F.asc("resume_name")))


def export_filter(df: DataFrame, filters: dict | None = None, ts: str = "timestamp") -> DataFrame:
    """The export's optional filter set, newest first."""
    f = filters or {}
    conds = []
    day = F.to_date(ts)
    if "min_ats" in f:
        conds.append(F.col("ats_score") >= F.lit(f["min_ats"]))
    if "domain" in f:
        conds.append(F.col("domain") == F.lit(f["domain"]))
    if "start_date" in f:
        conds.append(day >= F.lit(check_iso_date(f["start_date"])))
    if "end_date" in f:
        conds.append(day <= F.lit(check_iso_date(f["end_date"])))
    out = df.where(conjunction(conds)) if conds else df
    return newest_first(out, ts)


def last_days(df: DataFrame, as_of: str | _dt.date, days: int, ts: str = "timestamp") -> DataFrame:
    """DATE(ts) >= as_of - days (spans days + 1 dates)."""
    return df.where(F.to_date(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))


def member_of(df: DataFrame, col: str, values: DataFrame | list, values_col: str | None = None) -> DataFrame:
    """Membership in a list (``isin``) or a table (left-semi join)."""
    if isinstance(values, list):
        return df.where(F.col(col).isin(values))
    vc = values_col or col
    return df.join(values.select(F.col(vc).alias("_m")).distinct(), F.col(col) == F.col("_m"), "left_semi")


def logins_on(logs: DataFrame, day: str, action: str = FV.LOGIN_ACTION) -> DataFrame:
    """Action equality and DATE(text) equality."""
    d = check_iso_date(day)
    return logs.where((F.col("action") == action) & (day_of_text("timestamp") == F.lit(d)))


def log_listing(logs: DataFrame) -> DataFrame:
    """Three columns, newest text timestamp first."""
    return logs.select("username", "action", "timestamp").orderBy(
        F.desc("timestamp"), F.desc("username"), F.desc("action"))


def username_for_email(accounts: DataFrame, email: str) -> DataFrame:
    """Email -> username."""
    return accounts.where(F.col("email") == F.lit(email)).select("username")


def attribute_for_users(accounts: DataFrame, requests: DataFrame, attr: str,
                        key: str = "username") -> DataFrame:
    """B11 batch form: left join of requests; empty attribute counts as missing."""
    a = accounts.select(F.col(key).alias("_k"), F.nullif(F.col(attr), F.lit("")).alias(attr))
    return requests.join(a, requests[key] == a["_k"], "left").drop("_k")
