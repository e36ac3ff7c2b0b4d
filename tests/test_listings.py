"""Deep pages and places in ordered listings against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import filters as FL
from scoreplane.operators import listings as LS


def _rows(n=500):
    rng = random.Random(2)
    # one score holds a third of all rows, some are null
    return [(k, rng.choice([None, *[7] * 4, *range(10)]), f"n{rng.randrange(3)}") for k in range(n)]


@pytest.mark.parametrize("offset, limit", [(0, 10), (150, 40), (333, 1), (490, 50), (500, 5), (3, 0), (0, 1000)])
def test_deep_page_is_the_page(spark, offset, limit):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, score int, name string").repartition(7)
    got = LS.deep_page(df, [(F.col("score"), "desc"), F.upper("name")], "id", limit, offset).collect()
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2].upper(), r[0])
    want = sorted(rows, key=key)[offset:offset + limit]
    assert [tuple(r) for r in got] == [(*w, offset + k + 1) for k, w in enumerate(want)]


def test_deep_page_sorts_no_skipped_rows(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("score"))
    q = LS.deep_page(df, [F.col("score")], "id", 10, 15_000)
    plan = q._jdf.queryExecution().optimizedPlan().toString() + q._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan and "Offset" not in plan
    assert [r["rank"] for r in q.collect()] == list(range(15_001, 15_011))
    with pytest.raises(ValueError):
        LS.deep_page(df, [F.col("score")], "id", 10, -1)


def test_deep_page_of_no_rows(spark):
    assert LS.deep_page(spark.createDataFrame([], "id long, score int"), [F.col("score")], "id", 10, 0).count() == 0


def test_places_follow_the_listing(spark):
    df = spark.createDataFrame(_rows(), "id long, score int, name string").repartition(5)
    up, down = (LS.with_place(df.orderBy(o)).collect() for o in (F.asc("id"), F.desc("id")))
    assert {(r.id, r.place) for r in up} == {(k, k + 1) for k in range(500)}
    assert {(r.id, r.place) for r in down} == {(k, 500 - k) for k in range(500)}
    assert LS.with_place(df.where("id < 0").orderBy("id")).count() == 0


def test_log_listing_shows_the_newest_first(spark):
    rows = [(k, f"u{k % 3}", "login" if k % 2 else "logout", f"2024-01-0{1 + k % 4} 10:00:00") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, username string, action string, timestamp string").repartition(4)
    got = LS.with_place(FL.log_listing(df)).orderBy("place").collect()
    assert [tuple(r)[:3] for r in got] == sorted([(u, a, t) for _, u, a, t in rows], key=lambda r: (r[2], r[0], r[1]), reverse=True)
