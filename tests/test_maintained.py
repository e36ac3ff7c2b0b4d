"""Kept state equals a fresh aggregation after any changes."""

import datetime as dt
import random

import pytest

from scoreplane.operators import aggregates as AG
from scoreplane.operators import maintained as MT
from scoreplane.sources.schemas import CANDIDATES, SCORE_COLUMNS


def _rows(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        # a third of the rows in one group, and a group of one row
        domain = "hot" if k % 3 == 0 else "once" if k == 1 else rng.choice(["a", "b", "c"])
        out.append((k, f"r{k}", f"c{k}", *[rng.randint(0, 100) for _ in SCORE_COLUMNS], rng.randint(0, 64) / 64, domain,
                    dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * rng.randint(0, 60))))
    return out


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_state_follows_inserts_and_deletes(spark):
    rows = _rows(240, 1)
    df = lambda part: spark.createDataFrame(part, CANDIDATES)
    live, state = list(rows[:120]), MT.state_of(MT.signed(df(rows[:120]), None))
    rng = random.Random(2)
    for lo in (120, 180):
        # the extremes and the only row of a group go, and some of what has just come
        gone = [r for r in live if r[3] in (min(x[3] for x in live), max(x[3] for x in live)) or r[11] == "once"]
        gone += [r for r in rng.sample(live, 30) if r not in gone]
        live = [r for r in live if r not in gone] + rows[lo:lo + 60]
        state = MT.kept(MT.apply(state, MT.signed(df(rows[lo:lo + 60]), df(gone))))
    now = df(live)
    _same(MT.profile(state), AG.group_profile(now))
    _same(MT.frequency(state), AG.group_frequency(now))
    _same(MT.summary(state), AG.table_summary(now))
    _same(MT.recent_days(state, "2024-01-18", 9), AG.recent_daily_stats(now, "2024-01-18", 9))
    assert "once" not in {r.domain for r in state.groups.collect()}


def test_all_deleted_and_empty(spark):
    rows = spark.createDataFrame(_rows(9, 3), CANDIDATES)
    none = rows.where("false")
    state = MT.apply(MT.state_of(MT.signed(rows, None)), MT.signed(none, rows))
    assert MT.profile(state).count() == 0
    _same(MT.summary(state), AG.table_summary(none))
    _same(MT.summary(MT.state_of(MT.signed(none, None))), AG.table_summary(none))


def test_deleting_an_absent_row_raises(spark):
    rows = spark.createDataFrame(_rows(3, 4), CANDIDATES)
    state = MT.apply(MT.state_of(MT.signed(rows.where("id = 0"), None)), MT.signed(None, rows))
    with pytest.raises(Exception, match="not in the state"):
        MT.profile(state).collect()


def test_update_reads_the_state_not_the_table(spark):
    rows = spark.createDataFrame(_rows(90, 5), CANDIDATES)
    state = MT.kept(MT.state_of(MT.signed(rows, None)))
    assert state.groups.count() <= 6 and state.values.count() <= 90 and state.days.count() <= 90
    plan = MT.apply(state, MT.signed(rows.limit(1), None)).groups._jdf.queryExecution().logical().toString()
    assert plan.count("LogicalRDD") == 2
