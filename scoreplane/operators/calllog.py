"""Response cache, key usage and key failure state from a call log.

The original keeps three small tables up to date call by call. Here the
state is a pure function of the call log (set form), computed with
per-key aggregations that combine map-side before the shuffle, so a key
that carries a third of all calls costs one partial aggregate per task,
not one giant group. ``as_of`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.scalars import failure_reason, prompt_hash


def _ts(as_of) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else F.lit(as_of)


def with_hash(calls: DataFrame) -> DataFrame:
    """H6: content hash of ``model|prompt`` per call."""
    return calls.withColumn("prompt_hash", prompt_hash("prompt", "model"))


def successes(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("error").isNull())


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Last row per key by (ts, tie, then the values) via ``max_by``: partial aggregation, no window sort."""
    order = F.struct(F.col(ts), F.col(tie), *[F.col(c).alias(f"_v{k}") for k, c in enumerate(cols)])
    payload = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.max_by(payload, order).alias("_last"))
              .select(key, *[F.col("_last")[c].alias(c) for c in cols]))


def cache_state(calls: DataFrame) -> DataFrame:
    """I5 (set form): latest successful response per prompt hash."""
    s = with_hash(successes(calls))
    return (latest_per_key(s, "prompt_hash", "ts", "call_id", ["response", "ts"])
            .withColumnRenamed("ts", "timestamp"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """Last write wins; new rows beat old ones at equal time."""
    o = old.select(key, *cols, F.lit(0).alias("_src"))
    n = new.select(key, *cols, F.lit(1).alias("_src"))
    return latest_per_key(o.unionByName(n), key, ts, "_src", [c for c in cols])


def usage_state(calls: DataFrame) -> DataFrame:
    """D16/I6 (set form): successes on each key's last success date."""
    per_day = (successes(calls).groupBy("api_key", F.to_date("ts").alias("day"))
               .agg(F.count(F.lit(1)).alias("n")))
    return per_day.groupBy("api_key").agg(
        F.max_by("n", "day").cast("bigint").alias("usage_count"), F.max("day").alias("last_reset"))


def merge_usage(old: DataFrame, calls: DataFrame) -> DataFrame:
    """Fold new calls into a stored usage table.

    Same last date -> counts add; a newer date -> the new count replaces;
    keys without new calls keep their row.
    """
    new = usage_state(calls).select("api_key", F.col("usage_count").alias("_n"),
                                    F.col("last_reset").alias("_d"))
    j = old.join(new, "api_key", "full")
    count = (F.when(F.col("_d").isNull(), F.col("usage_count"))
             .when(F.col("last_reset").isNull() | (F.col("_d") > F.col("last_reset")), F.col("_n"))
             .when(F.col("_d") == F.col("last_reset"), F.col("usage_count") + F.col("_n"))
             .otherwise(F.col("usage_count")))
    day = F.when(F.col("_d").isNull(), F.col("last_reset")).otherwise(F.greatest("_d", "last_reset"))
    return j.select("api_key", count.cast("bigint").alias("usage_count"), day.alias("last_reset"))


def failure_events(calls: DataFrame) -> DataFrame:
    """Rows that change failure state: every failure, and pool-key successes (which clear it)."""
    return (calls.where(F.col("error").isNotNull() | ~F.col("own_key"))
            .select("api_key", "ts", "call_id", F.col("error").isNotNull().alias("failed"),
                    F.when(F.col("error").isNotNull(), failure_reason("error")).alias("reason")))


def failure_state(calls: DataFrame) -> DataFrame:
    """J7/I7/I4 (set form): a key is failed when its latest state-changing call failed."""
    last = latest_per_key(failure_events(calls), "api_key", "ts", "call_id", ["failed", "ts", "reason"])
    return last.where("failed").select("api_key", F.col("ts").alias("fail_time"), "reason")


def mark_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert failure time and reason per key."""
    return upsert_latest(old, new, "api_key", "fail_time", ["fail_time", "reason"])


def clear_failures(failures: DataFrame, keys: DataFrame) -> DataFrame:
    """I4: delete failure rows of the given keys."""
    return failures.join(keys.select("api_key").distinct(), "api_key", "left_anti")


def purge_cache(cache: DataFrame, as_of, hours: int = FV.CACHE_TTL_HOURS) -> DataFrame:
    """Keep cache rows with ``timestamp >= as_of - ttl`` (strictly older ones go)."""
    return cache.where(F.col("timestamp") >= _ts(as_of) - F.make_dt_interval(hours=F.lit(hours)))


def purge_failures(failures: DataFrame, as_of, days: int = FV.FAILURE_RETENTION_DAYS) -> DataFrame:
    """Keep failure rows with ``fail_time >= as_of - retention``."""
    return failures.where(F.col("fail_time") >= _ts(as_of) - F.make_dt_interval(days=F.lit(days)))


def probe_cache(requests: DataFrame, cache: DataFrame, as_of,
                hours: int = FV.CACHE_TTL_HOURS) -> DataFrame:
    """Per request, the live non-empty cached response or NULL (a miss).

    The cache has one row per hash, so the left join never multiplies rows;
    at scale it is a shuffle join on the hash (or broadcast when AQE sees a
    small cache).
    """
    live = purge_cache(cache, as_of, hours).where(F.col("response") != "")
    r = with_hash(requests)
    c = live.select(F.col("prompt_hash").alias("_h"), F.col("response").alias("cached_response"))
    return (r.join(c, F.col("prompt_hash") == F.col("_h"), "left").drop("_h")
             .withColumn("hit", F.col("cached_response").isNotNull()))


def key_health(keys: DataFrame, failures: DataFrame, usage: DataFrame, as_of,
               daily_limit: int = FV.DAILY_KEY_LIMIT) -> DataFrame:
    """Status per key at ``as_of``: 'cooling', 'over_quota' or 'healthy'.

    Cooldown is tested first (60 min after a quota failure, 5 min after any
    other, strictly less than). Usage counts only when its date is the UTC
    date of ``as_of``. Over-quota keys also yield a new 'quota' failure row
    (see ``quota_failures``).
    """
    now = _ts(as_of)
    f = failures.select(F.col("api_key").alias("_fk"), "fail_time", "reason")
    u = usage.select(F.col("api_key").alias("_uk"), "usage_count", "last_reset")
    j = (keys.select("api_key").distinct()
         .join(f, F.col("api_key") == F.col("_fk"), "left")
         .join(u, F.col("api_key") == F.col("_uk"), "left"))
    minutes = F.when(F.col("reason") == FV.REASON_QUOTA, FV.QUOTA_COOLDOWN_MINUTES).otherwise(
        FV.ERROR_COOLDOWN_MINUTES)
    cooling = F.col("fail_time").isNotNull() & (
        now < F.col("fail_time") + F.make_dt_interval(mins=minutes))
    used = F.when(F.col("last_reset") == F.to_date(now), F.col("usage_count")).otherwise(F.lit(0))
    status = (F.when(cooling, "cooling").when(used >= daily_limit, "over_quota").otherwise("healthy"))
    return j.select("api_key", status.alias("status"), F.coalesce(used, F.lit(0)).cast("bigint").alias("usage_today"))


def healthy_keys(health: DataFrame) -> DataFrame:
    return health.where(F.col("status") == "healthy").select("api_key")


def quota_failures(health: DataFrame, as_of) -> DataFrame:
    """J6 side output: a 'quota' failure row for each over-quota key."""
    return (health.where(F.col("status") == "over_quota")
            .select("api_key", _ts(as_of).alias("fail_time"), F.lit(FV.REASON_QUOTA).alias("reason")))
