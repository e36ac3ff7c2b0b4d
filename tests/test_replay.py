"""What each call met when it came: cache misses (batch and stream) and key health, against a call-by-call replay."""

import datetime as dt
import random

import pytest

from scoreplane import fixed_values as FV
from scoreplane.operators import replay as RP
from scoreplane.streaming import streams as SS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("call_id long, api_key string, own_key boolean, ts timestamp_ntz, model string, prompt string, "
          "response string, error string")


def _call(k, prompt, hours, response="r", error=None, key="k", own=False):
    return (k, key, own, T0 + dt.timedelta(hours=hours), "m", prompt, None if error else response, error)


def _misses(rows, life=24):
    last, out = {}, set()
    for k, _, _, ts, _, prompt, response, error in sorted(rows, key=lambda r: (r[3], r[0])):
        if prompt not in last or ts - last[prompt] > dt.timedelta(hours=life):
            out.add(k)
            if error is None and response:
                last[prompt] = ts
    return out


HAND = [_call(1, "p", 0, error="boom"), _call(2, "p", 1), _call(3, "p", 2), _call(4, "q", 0, ""), _call(5, "q", 1),
        _call(6, "q", 25), _call(7, "q", 25.5), _call(8, "s", 5, None), _call(9, "s", 5, "x"), _call(10, "s", 29), _call(11, "s", 29.01)]


def test_only_answered_misses_fill_the_cache(spark):
    got = {r.call_id for r in RP.cache_misses(spark.createDataFrame(HAND, SCHEMA)).collect()}
    # exactly the lifetime later (10; 6 after 5) still hits, a moment more misses
    assert got == {1, 2, 4, 5, 7, 8, 9, 11} == _misses(HAND)


def test_the_stream_follows_the_same_rule(spark, tmp_path):
    path = str(tmp_path / "calls")
    spark.createDataFrame(HAND, SCHEMA).coalesce(1).write.parquet(path)
    got = SS.run_to_table(SS.cache_misses(spark.readStream.schema(SCHEMA).parquet(path)), "s2-hand")
    assert {r.call_id for r in got.collect()} == _misses(HAND)


def _random_calls(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        hot = rng.random() < 0.4  # one prompt and key with over a third of all calls
        error = rng.choice(["quota hit", "boom"]) if rng.random() < 0.25 else None
        key = "hot" if hot else f"k{rng.randrange(5)}"
        rows.append(_call(k, "hot" if hot else f"p{rng.randrange(6)}", rng.randrange(24 * 12 * 60) / 60,
                          rng.choice(["r", "r", ""]), error, key, key == "k0"))
    return rows + [_call(n + k, "hot", 100, error="boom", key="hot") for k in range(3)]  # ties


@pytest.mark.parametrize("seed", [1, 2])
def test_cache_misses_equal_the_replay(spark, seed):
    rows = _random_calls(600, seed)
    got = [r.call_id for r in RP.cache_misses(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == _misses(rows)
    assert RP.cache_misses(spark.createDataFrame([], SCHEMA)).count() == 0


def _health(rows, limit):
    fail, used, out = {}, {}, {}
    for k, key, own, ts, _, _, _, error in sorted(rows, key=lambda r: (r[3], r[0])):
        state = fail.get(key)
        if state and ts < state[0] + dt.timedelta(minutes=state[1]):
            out[k] = "cooling"
        else:
            out[k] = "over_quota" if used.get((key, ts.date()), 0) >= limit else "healthy"
        if error:
            fail[key] = (ts, FV.QUOTA_COOLDOWN_MINUTES if "quota" in error or "429" in error else FV.ERROR_COOLDOWN_MINUTES)
        else:
            used[key, ts.date()] = used.get((key, ts.date()), 0) + 1
            if not own:
                fail.pop(key, None)
    return out


def test_health_at_each_call_equals_the_replay(spark):
    rows = _random_calls(900, 3)
    got = {r.call_id: r.status for r in RP.health_at_calls(spark.createDataFrame(rows, SCHEMA).repartition(5), 8).collect()}
    want = _health(rows, 8)
    assert got == want and set(want.values()) == {"cooling", "over_quota", "healthy"}


def test_health_at_the_edges(spark):
    quota, other = FV.QUOTA_COOLDOWN_MINUTES / 60, FV.ERROR_COOLDOWN_MINUTES / 60
    rows = [_call(1, "p", 0, error="429", own=True), _call(2, "p", quota / 2, own=True),  # an own key's success ends nothing
            _call(3, "p", quota, own=True),
            _call(4, "p", 0, error="429", key="pool"), _call(5, "p", 0.1, key="pool"), _call(6, "p", 0.2, key="pool"),
            _call(7, "p", 5, error="boom", key="e"), _call(8, "p", 5, key="e"), _call(9, "p", 5 + other, key="e")]
    got = {r.call_id: r.status for r in RP.health_at_calls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _health(rows, 800) == {1: "healthy", 2: "cooling", 3: "healthy", 4: "healthy", 5: "cooling", 6: "healthy",
                                         7: "healthy", 8: "cooling", 9: "healthy"}
