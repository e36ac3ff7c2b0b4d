"""The call log replayed in set form: what each call met when it came.

Both operators answer for every call at its own time, not for one ``as_of``.
Calls are put in order (key, ts, call_id) once, with dense positions from
range sums (``tables.assign_ids``), so "the next one" and "the n-th of a day"
are joins on positions and a key with a third of all calls spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.operators import calllog as CG
from scoreplane.operators.asof import asof_join
from scoreplane.operators.tables import assign_ids
from scoreplane.session import checkpoint_dir


def answered() -> Column:
    """The call fills the cache: it succeeded, with a response that is not empty."""
    return F.col("error").isNull() & (F.coalesce(F.col("response"), F.lit("")) != "")


def cache_misses(calls: DataFrame, ttl_hours: int = FV.CACHE_TTL_HOURS) -> DataFrame:
    """(call_id, prompt_hash, ts) of the calls that miss the response cache.

    A call misses unless a miss of its prompt that was answered lies at most the
    lifetime before it; failed calls and empty responses fill nothing. For
    every call the next miss *if it were one* is known from the table alone:
    the next call of the prompt if it is not answered, else the first one
    beyond the lifetime (an as-of join). The misses are what these pointers
    reach from each prompt's first call, found by doubling the pointers, in as
    many rounds as the logarithm of the longest chain, each written to the
    checkpoint folder. Calls at one instant go by call_id.
    """
    checkpoint_dir(calls.sparkSession)
    h = CG.with_hash(calls).select("call_id", "prompt_hash", "ts", answered().alias("ok"))
    h = assign_ids(h, None, "pos", ["prompt_hash", "ts", "call_id"]).checkpoint()
    last_at = h.groupBy("prompt_hash", "ts").agg(F.max("pos").alias("pos"))
    expiry = h.where("ok").select("prompt_hash", (F.col("ts") + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("ts"), "pos")
    beyond = asof_join(expiry, last_at, "prompt_hash", "ts", "pos", ["pos"]).select(
        "pos", "prompt_hash", (F.col("r_pos") + 1).alias("nxt"))
    step = h.where("NOT ok").select("pos", "prompt_hash", (F.col("pos") + 1).alias("nxt")).unionByName(beyond)
    there = h.select(F.col("pos").alias("nxt"), F.col("prompt_hash").alias("there"))
    step = step.join(there, "nxt").where("prompt_hash = there").select("pos", "nxt").checkpoint()
    reached = h.groupBy("prompt_hash").agg(F.min("pos").alias("pos")).select("pos").checkpoint()
    while not step.isEmpty():
        reached = reached.unionByName(reached.join(step, "pos").select(F.col("nxt").alias("pos"))).distinct().checkpoint()
        twice = step.select(F.col("pos").alias("nxt"), F.col("nxt").alias("beyond"))
        step = step.join(twice, "nxt").select("pos", F.col("beyond").alias("nxt")).checkpoint()
    return h.join(reached, "pos", "left_semi").select("call_id", "prompt_hash", "ts")


def cooldowns(calls: DataFrame) -> DataFrame:
    """(api_key, ts, call_id, until, n_ts, n_call): each failure's cooldown, ended early by the key's next state change."""
    ev = CG.failure_events(calls)
    ev = assign_ids(ev, None, "pos", ["api_key", "ts", "call_id"]).checkpoint()
    after = ev.select((F.col("pos") - 1).alias("pos"), F.col("api_key").alias("n_key"), F.col("ts").alias("n_ts"),
                      F.col("call_id").alias("n_call"))
    minutes = F.when(F.col("reason") == FV.REASON_QUOTA, FV.QUOTA_COOLDOWN_MINUTES).otherwise(FV.ERROR_COOLDOWN_MINUTES)
    same = F.col("n_key") == F.col("api_key")
    return ev.where("failed").join(after, "pos", "left").select(
        "api_key", "ts", "call_id", (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("until"),
        F.when(same, F.col("n_ts")).alias("n_ts"), F.when(same, F.col("n_call")).alias("n_call"))


def quota_reached(calls: DataFrame, daily_limit: int = FV.DAILY_KEY_LIMIT) -> DataFrame:
    """(api_key, day, q_ts, q_call): the call with which a key used up its day."""
    ok = CG.successes(calls).select("api_key", "ts", "call_id", F.to_date("ts").alias("day"))
    ok = assign_ids(ok, None, "pos", ["api_key", "ts", "call_id"]).checkpoint()
    first = ok.groupBy("api_key", "day").agg((F.min("pos") + daily_limit - 1).alias("pos"))
    return first.join(ok.select("pos", F.col("api_key").alias("k"), F.col("day").alias("d"), F.col("ts").alias("q_ts"),
                                F.col("call_id").alias("q_call")), "pos").where("k = api_key AND d = day").select(
        "api_key", "day", "q_ts", "q_call")


def health_at_calls(calls: DataFrame, daily_limit: int = FV.DAILY_KEY_LIMIT) -> DataFrame:
    """(call_id, api_key, ts, status) of every call: its key's health just before it, by the calls before it.

    ``cooling``: the key's last state change was a failure less than its
    cooldown ago (a pool key's success ends it); else ``over_quota`` once the
    day's limit of successes is used, until the UTC day ends; else
    ``healthy``. Cooldowns are intervals that do not overlap within a key.
    Calls meet them on (key, time bin), a bin as long as the longest cooldown,
    so an interval stands in two bins at most and a hot key is spread over its
    bins.
    """
    checkpoint_dir(calls.sparkSession)
    size = max(FV.QUOTA_COOLDOWN_MINUTES, FV.ERROR_COOLDOWN_MINUTES) * 60
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / size)
    cold = cooldowns(calls).select(F.col("api_key").alias("c_key"), F.col("ts").alias("c_ts"), F.col("call_id").alias("c_call"),
                                   "until", "n_ts", "n_call", F.explode(F.sequence(bin_of("ts"), bin_of("until"))).alias("c_bin"))
    own = F.struct("ts", "call_id")
    inside = (F.struct("c_ts", "c_call") < own) & (F.col("ts") < F.col("until")) & (
        F.col("n_ts").isNull() | (own <= F.struct("n_ts", "n_call")))
    c = calls.select("call_id", "api_key", "ts", F.to_date("ts").alias("day")).withColumn("bin", bin_of("ts"))
    c = c.join(cold, (F.col("api_key") == F.col("c_key")) & (F.col("bin") == F.col("c_bin")) & inside, "left")
    q = quota_reached(calls, daily_limit).select(F.col("api_key").alias("q_key"), F.col("day").alias("q_day"), "q_ts", "q_call")
    c = c.join(q, (F.col("api_key") == F.col("q_key")) & (F.col("day") == F.col("q_day")), "left")
    used = F.col("q_ts").isNotNull() & (F.struct("q_ts", "q_call") < own)
    return c.select("call_id", "api_key", "ts", F.when(F.col("c_ts").isNotNull(), "cooling").when(used, "over_quota").otherwise(
        "healthy").alias("status"))
