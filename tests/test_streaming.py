"""Streaming folds over several micro-batches equal the batch operators."""

import os

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import calllog as CG
from scoreplane.sources import fixtures as FX
from scoreplane.streaming import streams as SS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """events written as 4 files in time order, so a stream sees 4 micro-batches."""
    d = tmp_path_factory.mktemp("events-split")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for i in range(4):
        part = ev.where((F.col("ts") >= F.lit(bounds[i]).cast("timestamp_ntz"))
                        & (F.col("ts") < F.lit(bounds[i + 1]).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(str(d / f"part{i}"))
        # flatten into one folder with ordered names
        for f in os.listdir(d / f"part{i}"):
            if f.endswith(".parquet"):
                os.link(d / f"part{i}" / f, d / f"{i:02d}.parquet")
    flat = d / "events.parquet"
    flat.mkdir()
    for i in range(4):
        os.link(d / f"{i:02d}.parquet", flat / f"{i:02d}.parquet")
    return str(d)


def _as_set(df, cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_failure_fold_over_batches(spark, split_events):
    stream = FX.call_log_from(SS.file_stream(spark, split_events, "events", max_files=1))
    got = SS.read_failure_state(spark, SS.failure_state_stream(stream, "t-fail"))
    want = CG.failure_state(FX.call_log(spark, SF))
    cols = ["api_key", "fail_time", "reason"]
    assert _as_set(got, cols) == _as_set(want, cols)


def test_cache_fold_over_batches(spark, split_events):
    stream = FX.call_log_from(SS.file_stream(spark, split_events, "events", max_files=1))
    got = SS.read_cache_state(spark, SS.cache_state_stream(stream, "t-cache"))
    want = CG.cache_state(FX.call_log(spark, SF))
    cols = ["prompt_hash", "response", "timestamp"]
    assert _as_set(got, cols) == _as_set(want, cols)


def test_interval_join_equals_batch(spark, split_events):
    ce = FX.code_events_from(SS.file_stream(spark, split_events, "events", max_files=1))
    got = SS.run_to_table(SS.code_interval_join(ce.where("kind = 'issue'"), ce.where("kind = 'attempt'"), 21600),
                          "t-s5")
    b = FX.code_events(spark, SF)
    i = b.where("kind = 'issue'").select(F.col("user_id").alias("u"), F.col("ts").alias("issue_ts"))
    a = b.where("kind = 'attempt'")
    want = a.join(i, (a.user_id == i.u) & (a.ts >= i.issue_ts)
                  & (a.ts <= i.issue_ts + F.expr("INTERVAL 21600 SECONDS")))
    cols = ["event_id", "issue_ts"]
    assert _as_set(got, cols) == _as_set(want, cols)


def test_failure_fold_resumes_after_restart(spark, split_events, tmp_path):
    """A stopped fold restarted on the same folder continues from its last version."""
    src = tmp_path / "events.parquet"
    src.mkdir()
    for i in range(2):
        os.link(os.path.join(split_events, f"{i:02d}.parquet"), src / f"{i:02d}.parquet")
    base = str(tmp_path / "state")
    s1 = FX.call_log_from(SS.file_stream(spark, str(tmp_path), "events", max_files=1))
    SS.failure_state_stream(s1, base=base)
    for i in range(2, 4):
        os.link(os.path.join(split_events, f"{i:02d}.parquet"), src / f"{i:02d}.parquet")
    s2 = FX.call_log_from(SS.file_stream(spark, str(tmp_path), "events", max_files=1))
    got = SS.read_failure_state(spark, SS.failure_state_stream(s2, base=base))
    want = CG.failure_state(FX.call_log(spark, SF))
    cols = ["api_key", "fail_time", "reason"]
    assert _as_set(got, cols) == _as_set(want, cols)
    batches = sorted(int(d.split("=")[1]) for d in os.listdir(os.path.join(base, "changes"))
                     if d.startswith("batch="))
    assert batches == [0, 1, 2, 3]


def test_compacted_fold_reads_snapshot_plus_later_batches(spark, split_events, tmp_path):
    """Compaction between runs: snapshot + later change folders equal the batch state."""
    src = tmp_path / "events.parquet"
    src.mkdir()
    for i in range(2):
        os.link(os.path.join(split_events, f"{i:02d}.parquet"), src / f"{i:02d}.parquet")
    base = str(tmp_path / "state")
    s1 = FX.call_log_from(SS.file_stream(spark, str(tmp_path), "events", max_files=1))
    SS.cache_state_stream(s1, base=base)
    assert SS.compact_state(spark, base, "prompt_hash", ["ts", "call_id"]) == 1
    for i in range(2, 4):
        os.link(os.path.join(split_events, f"{i:02d}.parquet"), src / f"{i:02d}.parquet")
    s2 = FX.call_log_from(SS.file_stream(spark, str(tmp_path), "events", max_files=1))
    SS.cache_state_stream(s2, base=base)
    want = CG.cache_state(FX.call_log(spark, SF))
    cols = ["prompt_hash", "response", "timestamp"]
    assert _as_set(SS.read_cache_state(spark, base), cols) == _as_set(want, cols)
    assert SS.compact_state(spark, base, "prompt_hash", ["ts", "call_id"]) == 3
    assert _as_set(SS.read_cache_state(spark, base), cols) == _as_set(want, cols)


CODE_EVENTS = "event_id long, user_id long, kind string, code string, ts timestamp_ntz"


def _code_events():
    import datetime as dt
    import random

    rng, t0, rows = random.Random(5), dt.datetime(2024, 3, 1), []
    for k in range(400):  # user 0 has over a third of all events; many at one second
        rows.append((k, 0 if rng.random() < 0.4 else rng.randrange(1, 6), rng.choice(["issue", "attempt", "attempt"]),
                     rng.choice(["a", "b"]), t0 + dt.timedelta(seconds=rng.randrange(12_000))))
    # one issue of a user at one instant: the batch form knows no order of two
    seen, kept = set(), []
    for r in rows:
        if r[2] == "attempt" or (r[1], r[4]) not in seen:
            kept.append(r)
            seen |= {(r[1], r[4])} if r[2] == "issue" else set()
    return kept + [(900, 99, "attempt", "a", t0 + dt.timedelta(hours=9))]  # moves the watermark past all others


@pytest.mark.parametrize("order", ["in time order", "shuffled"])
def test_attempt_outcomes_equal_the_batch_form(spark, tmp_path, order):
    import random

    from scoreplane.operators.accounts import match_codes

    rows = _code_events()
    batches = sorted(rows[:-1], key=lambda r: r[4])
    if order == "shuffled":
        random.Random(1).shuffle(batches)
    path = tmp_path / "events"
    for k in range(4):
        part = batches[k * 100:(k + 1) * 100 if k < 3 else None] + (rows[-1:] if k == 3 else [])
        spark.createDataFrame(part, CODE_EVENTS).coalesce(1).write.mode("append").parquet(str(path))
        for f in sorted(path.glob("part-*.parquet")):
            os.rename(f, path / f"b{k}.parquet")
            os.utime(path / f"b{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(CODE_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path))
    # shuffled rows are up to the whole span late: the delay says so
    got = SS.run_to_table(SS.attempt_outcomes(stream, 180, "4 hours" if order == "shuffled" else "10 minutes"), "outcomes")
    want = match_codes(spark.createDataFrame(rows[:-1], CODE_EVENTS), 180)
    cols = ["event_id", "user_id", "ts", "code", "issue_ts", "outcome"]
    assert _as_set(got, cols) == _as_set(want, cols) and got.count() == want.count()
    assert {r.outcome for r in got.collect()} == {"ok", "invalid", "expired", "no_pending"}
