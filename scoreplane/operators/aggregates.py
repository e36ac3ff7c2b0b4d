"""Grouped score profiles, distributions and trends.

All are one ``groupBy().agg()`` (partial aggregation before the shuffle,
final after it). Totals for percentages come from a global aggregate that
Spark joins back as a one-row broadcast, so the table is read once per
scan and the group rows never travel to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.scalars import check_unit_interval, percent_of, round_avg
from scoreplane.sources.schemas import SCORE_COLUMNS


def _with_total(grouped: DataFrame, count_col: str) -> DataFrame:
    """Attach the grand total (the scalar subquery) to grouped rows.

    The total is the sum of the group counts, so the table is scanned once;
    both branches read the same aggregation exchange, and the one-row total
    is broadcast.
    """
    total = grouped.agg(F.sum(count_col).alias("_total"))
    return grouped.crossJoin(F.broadcast(total))


def having_count(df: DataFrame, count_col: str, min_count: int = 1) -> DataFrame:
    """HAVING COUNT(*) >= n."""
    return df.where(F.col(count_col) >= min_count) if min_count > 1 else df


def average_by_group(df: DataFrame, key: str = "domain", score: str = "ats_score",
                     avg_name: str = "avg_ats_score", count_name: str = "candidate_count",
                     digits: int = 2, min_count: int = 1) -> DataFrame:
    """Rounded average and count per group, best first (key breaks ties)."""
    g = df.groupBy(key).agg(round_avg(score, digits).alias(avg_name),
                            F.count(F.lit(1)).alias(count_name))
    return having_count(g, count_name, min_count).orderBy(F.desc(avg_name), F.asc(key))


def top_groups(df: DataFrame, k: int = FV.TOP_DOMAINS_DEFAULT, key: str = "domain",
               score: str = "ats_score") -> DataFrame:
    """Top-k groups by rounded average (TakeOrderedAndProject)."""
    return (average_by_group(df, key, score, avg_name="avg_score", count_name="count")
            .limit(k))


def group_distribution(df: DataFrame, key: str = "domain") -> DataFrame:
    """D3: count and percent of all rows per group, most frequent first."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return (_with_total(g, "count")
            .select(key, "count", percent_of("count", "_total").alias("percentage"))
            .orderBy(F.desc("count"), F.asc(key)))


def count_by_day(df: DataFrame, ts: str = "timestamp", days: int = FV.DAY_HISTORY) -> DataFrame:
    """Rows per calendar day, newest ``days`` active days."""
    return (df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("day")).limit(days))


def threshold_split(df: DataFrame, threshold: float = FV.BIAS_THRESHOLD,
                    col: str = "bias_score", hit: str = "Biased", miss: str = "Fair") -> DataFrame:
    """Two-way CASE bucket (``>=``) with count and percent."""
    check_unit_interval(threshold)
    bucket = F.when(F.col(col) >= F.lit(float(threshold)), hit).otherwise(miss)
    g = df.groupBy(bucket.alias("bias_category")).agg(F.count(F.lit(1)).alias("count"))
    return (_with_total(g, "count")
            .select("bias_category", "count", percent_of("count", "_total").alias("percentage")))


def recent_daily_stats(df: DataFrame, as_of: str | _dt.date, days: int = FV.DAILY_STATS_DAYS,
                       ts: str = "timestamp", score: str = "ats_score") -> DataFrame:
    """Daily average and count for dates >= as_of - days, oldest first."""
    day = F.to_date(ts)
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return (df.where(day >= start)
              .groupBy(day.alias("date"))
              .agg(round_avg(score, 2).alias("avg_ats"), F.count(F.lit(1)).alias("daily_count"))
              .orderBy("date"))


def group_profile(df: DataFrame, key: str = "domain", min_count: int = 1) -> DataFrame:
    """13-column performance profile per group."""
    avgs = [round_avg(c, 2).alias(f"avg_{c}") for c in SCORE_COLUMNS]
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_candidates"),
        *avgs,
        round_avg("bias_score", 3).alias("avg_bias_score"),
        F.max("ats_score").alias("max_ats_score"),
        F.min("ats_score").alias("min_ats_score"),
        (F.max("ats_score") - F.min("ats_score")).cast("double").alias("score_range"),
    )
    return having_count(g, "total_candidates", min_count).orderBy(F.desc("avg_ats_score"), F.asc(key))


def group_frequency(df: DataFrame, key: str = "domain", min_count: int = 1) -> DataFrame:
    """Frequency, average score, average bias and share per group."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("frequency"),
                            round_avg("ats_score", 2).alias("avg_performance"),
                            round_avg("bias_score", 3).alias("avg_bias"))
    # The total is count(*) of the input (the SQL's scalar subquery), not the
    # sum of the group counts: this aggregation carries averages the total
    # does not need, so the two branches would not share an exchange, while
    # a bare count(*) reads no column data (row-group metadata only).
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    g = having_count(g, "frequency", min_count).crossJoin(F.broadcast(total))
    return (g
            .select(key, "frequency", "avg_performance", "avg_bias",
                    percent_of("frequency", "_total").alias("percentage"))
            .orderBy(F.desc("frequency"), F.asc(key)))


def table_summary(df: DataFrame, key: str = "domain", ts: str = "timestamp") -> DataFrame:
    """One-row summary in a single scan; missing/zero averages -> 0, dates NULL."""
    a = df.agg(F.count(F.lit(1)).alias("total_candidates"),
               round_avg("ats_score", 2).alias("_avg_ats"),
               round_avg("bias_score", 3).alias("_avg_bias"),
               F.count_distinct(key).alias("unique_domains"),
               F.min(F.to_date(ts)).alias("earliest_date"),
               F.max(F.to_date(ts)).alias("latest_date"))
    z = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(0.0))
    return a.select("total_candidates", z("_avg_ats").alias("avg_ats_score"),
                    z("_avg_bias").alias("avg_bias_score"), "unique_domains",
                    "earliest_date", "latest_date")


def row_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    """Total rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))
