"""Score profiles, summaries and daily trends kept up under table changes (D4, D6-D9 under A5, I1, I2).

The kept state is small and mergeable: per group counts and exact sums, per
day the same, and a counted multiset of (group, score), from which minimum
and maximum follow also after deletions. A change is a set of signed rows
(+1 inserted, -1 deleted); its own state is added to the kept one, and keys
whose count falls to zero go. So an update reads the changed rows and the
state, never the table.

Sums are integers or decimals, so adding and taking away in any order gives
the same state. Null scores count in no average and no extreme; a null group
is a group of its own that ``unique_domains`` leaves out, and rows without a
timestamp count in no day. Deleting a row that is not there raises when the
state is read.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.scalars import percent_of
from scoreplane.session import checkpoint_dir
from scoreplane.sources.schemas import SCORE_COLUMNS

BIAS = "bias_score"
_MEASURES = [*SCORE_COLUMNS, BIAS]
_KEYS = {"groups": ["domain"], "values": ["domain", "ats_score"], "days": ["day"]}


@dataclass
class State:
    """groups: domain, n, and c_ (non-null count) and s_ (sum) of each measure; values: domain, ats_score, n; days: day, n, c_, s_."""
    groups: DataFrame
    values: DataFrame
    days: DataFrame


def signed(inserted: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
    """Change rows: the inserted with ``sign`` 1, the deleted with -1."""
    parts = [df.select("domain", "timestamp", *_MEASURES, F.lit(s).cast("long").alias("sign"))
             for df, s in ((inserted, 1), (deleted, -1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _sums(measures: list[str]) -> list[Column]:
    out = [F.sum("sign").alias("n")]
    for m in measures:
        exact = F.col(m).cast("double").cast("decimal(28,15)") if m == BIAS else F.col(m).cast("long")
        out += [F.sum(F.when(F.col(m).isNotNull(), F.col("sign")).otherwise(0)).alias(f"c_{m}"),
                F.coalesce(F.sum(F.when(F.col("sign") > 0, exact).otherwise(-exact)), F.lit(0)).cast(
                    "decimal(38,15)" if m == BIAS else "long").alias(f"s_{m}")]
    return out


def state_of(changes: DataFrame) -> State:
    """The state that signed rows make by themselves (for a whole table: all with sign 1)."""
    day = F.to_date("timestamp")
    return State(changes.groupBy("domain").agg(*_sums(_MEASURES)),
                 changes.where("ats_score IS NOT NULL").groupBy("domain", "ats_score").agg(F.sum("sign").alias("n")),
                 changes.where(day.isNotNull()).groupBy(day.alias("day")).agg(*_sums(["ats_score"])))


def _merged(old: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(change).groupBy(*keys).agg(*[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in rest])
    lost = F.raise_error(F.lit("a deleted row is not in the state")).cast("long")
    return both.withColumn("n", F.when(F.col("n") < 0, lost).otherwise(F.col("n"))).where("n <> 0")


def apply(state: State, changes: DataFrame) -> State:
    """The state after signed rows."""
    change = state_of(changes)
    return State(**{t: _merged(getattr(state, t), getattr(change, t), keys) for t, keys in _KEYS.items()})


def kept(state: State) -> State:
    """The state checkpointed, so that the next update starts from its rows (runs a job per table)."""
    checkpoint_dir(state.groups.sparkSession)
    return State(**{t: getattr(state, t).checkpoint(eager=True) for t in _KEYS})


def _avg(m: str, digits: int) -> Column:
    c, s = F.col(f"c_{m}"), F.col(f"s_{m}").cast("double")
    return F.round(F.when(c > 0, s / c), digits).cast("double")


def profile(state: State, min_count: int = 1) -> DataFrame:
    """D7 from the state."""
    ends = state.values.groupBy("domain").agg(F.max("ats_score").alias("max_ats_score"), F.min("ats_score").alias("min_ats_score"))
    g = state.groups.where(F.col("n") >= min_count)
    out = g.join(ends.withColumnRenamed("domain", "_d"), F.col("domain").eqNullSafe(F.col("_d")), "left")
    return out.select(
        "domain", F.col("n").alias("total_candidates"), *[_avg(c, 2).alias(f"avg_{c}") for c in SCORE_COLUMNS],
        _avg(BIAS, 3).alias("avg_bias_score"), "max_ats_score", "min_ats_score",
        (F.col("max_ats_score") - F.col("min_ats_score")).cast("double").alias("score_range")).orderBy(
        F.desc("avg_ats_score"), F.asc("domain"))


def frequency(state: State, min_count: int = 1) -> DataFrame:
    """D8 from the state."""
    total = state.groups.agg(F.sum("n").alias("_total"))
    return state.groups.where(F.col("n") >= min_count).crossJoin(F.broadcast(total)).select(
        "domain", F.col("n").alias("frequency"), _avg("ats_score", 2).alias("avg_performance"),
        _avg(BIAS, 3).alias("avg_bias"), percent_of("n", "_total").alias("percentage")).orderBy(
        F.desc("frequency"), F.asc("domain"))


def summary(state: State) -> DataFrame:
    """D9 from the state: one row, missing or zero averages 0."""
    g = state.groups.agg(*[F.sum(f"{x}_{m}").alias(f"{x}_{m}") for m in ("ats_score", BIAS) for x in "cs"],
                         F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"), F.count("domain").alias("unique_domains"))
    d = state.days.agg(F.min("day").alias("earliest_date"), F.max("day").alias("latest_date"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # one row each
    return g.crossJoin(F.broadcast(d)).select(
        "total_candidates", zero(_avg("ats_score", 2)).alias("avg_ats_score"), zero(_avg(BIAS, 3)).alias("avg_bias_score"),
        "unique_domains", "earliest_date", "latest_date")


def recent_days(state: State, as_of: str | _dt.date, days: int = FV.DAILY_STATS_DAYS) -> DataFrame:
    """D6 from the state."""
    return state.days.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)).select(
        F.col("day").alias("date"), _avg("ats_score", 2).alias("avg_ats"), F.col("n").alias("daily_count")).orderBy("date")
