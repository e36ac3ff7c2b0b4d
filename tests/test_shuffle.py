"""the order is a permutation that follows from the rows and the seed alone."""

import numpy as np
import pytest

from scoreplane.operators.shuffle import permutation, shuffled


@pytest.mark.parametrize("seed", [0, 42, 10**6])
def test_every_size_is_permuted(seed):
    for n in [*range(1, 130), 4096, 4097, 70_001]:
        assert (np.sort(permutation(n, seed)(np.arange(n))) == np.arange(n)).all()
    big = permutation(1 << 60, seed)(np.arange((1 << 60) - 1000, 1 << 60))
    assert len(set(big.tolist())) == 1000 and big.min() >= 0 and big.max() < 1 << 60


def test_places_are_spread():
    n = 50_000
    at = permutation(n, 7)(np.arange(n))
    assert abs(np.corrcoef(np.arange(n), at)[0, 1]) < 0.02
    # neighbours part: an adjacent pair stays adjacent about twice in n
    assert (np.abs(np.diff(at)) == 1).sum() < 20
    assert np.bincount(at[:5000] * 10 // n, minlength=10).min() > 400


def test_same_order_on_any_partitioning(spark):
    rows = [(k, f"v{k % 7}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v string")
    a = [tuple(r) for r in shuffled(df.repartition(1), ["id"]).collect()]
    b = [tuple(r) for r in shuffled(df.repartition(13, "v"), ["id"]).collect()]
    assert a == b and [r[2] for r in a] == list(range(1, 1001)) and sorted(r[:2] for r in a) == rows
    assert a != [tuple(r) for r in shuffled(df, ["id"], seed=43).collect()]


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "id long, v string")
    got = shuffled(df).collect()
    assert [r.place for r in got] == [1, 2, 3, 4] and sum((r.id, r.v) == (1, "a") for r in got) == 2
    assert shuffled(df.where("false")).count() == 0
