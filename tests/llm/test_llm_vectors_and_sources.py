"""Source divergence, vantage-point trees and ball k-means against brute force, and their edges."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("scoreplane.llm")
from pyspark.sql import functions as F  # noqa: E402
from scoreplane.llm import ballkmeans, divergence, vptree  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, min_docs, ranks):
    """The contract, term by term."""
    groups, docs, n = set(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in WORDS.findall(text or "")]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        total = collections.Counter()
        for s in own:
            total.update(n[lang, s])

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}
        p, q = {s: shares(n[lang, s]) for s in own}, shares(total)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


SCHEMA = "text string, lang string, source string, n string, term string, own string, block string, row_id string, value string, size string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def _texts(seed, count):
    rng = np.random.default_rng(seed)
    vocab = [f"Word{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(count):
        lang = ["en", "de", None][min(2, k % 4)]
        words = rng.choice(vocab, 30, p=(w := 1 / np.arange(1, 61)) / w.sum())
        rows.append((" ".join(words) + ". 12 İ_ß", lang, [None, "a", "b", "é", "zz", "B"][rng.integers(6)]))
    return rows


@pytest.mark.parametrize("block, tile", [(7, 2), (8192, 64)])
def test_divergence_brute_force(spark, block, tile):
    rows = _texts(1, 120) + [("", "en", "blank"), (None, "xx", "a"), ("lone Word", "xx", "b")]
    got = divergence.audit(_docs(spark, rows), min_docs=5, ranks=6, block=block, tile=tile)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, 5, 6)


def test_divergence_ties_and_huge_counts(spark):
    # all terms equally common: ties at the rank limit, ordered by the term
    rows = [(" ".join(f"t{chr(97 + k)}" for k in range(20)), "en", s) for s in "ab" for _ in range(6)]
    rows += [(" ".join(f"t{chr(97 + k)}" for k in range(10)) * 1, "en", "a")] * 3
    got = divergence.audit(_docs(spark, rows), min_docs=2, ranks=4, block=3, tile=1)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, 2, 4)
    big = 10**13  # SCALE * count is beyond 64 bits
    assert divergence.shares([big, 0], big, 2).tolist() == [1 + 10**9 * (big + 5) // (big + 10), 1 + 5 * 10**9 // (big + 10)]


@pytest.mark.parametrize("block, tile", [(7, 2), (7, 64)])
def test_divergence_pairs_of_many_blocks_in_any_row_order(spark, block, tile):
    """Shuffled joins of many partitions bring the sources of each block in another order."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = _texts(1, 120)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, divergence.audit(_docs(spark, rows), min_docs=5, ranks=6, block=block, tile=tile).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(plain_audit(rows, 5, 6))


def test_divergence_empty_table(spark):
    assert divergence.audit(_docs(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=40, max_size=40))
def test_runs_are_the_columns(a, b):
    b = b[:len(a)]

    def runs(c):
        at = np.array([k for k, v in enumerate(c) if v], np.int64)
        return divergence.encode(at[::-1], [c[k] for k in at[::-1]], len(c))
    (ea, ca), (eb, cb) = runs(a), runs(b)
    assert all(x != y for x, y in zip(ca, ca[1:]))
    assert np.repeat(ca, np.diff(ea, prepend=0)).tolist() == a
    cut, i, j = divergence.intersect(ea, eb)
    length = np.diff(cut, prepend=0)
    assert (np.abs(np.array(ca)[i] - np.array(cb)[j]) * length).sum() == sum(abs(x - y) for x, y in zip(a, b))


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows],
                                 "vec_id long, embedding array<float>, label int, dim string, vec string, row_id string")


def _clustered(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    return (centre[rng.integers(6, size=n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)


def plain_nearest(rows, every, k):
    ok = [(i, v, np.array(x, float)) for i, (v, x, *_) in enumerate(rows)
          if x is not None and None not in x and all(map(math.isfinite, x)) and any(x)]
    out = set()
    for i, q, x in ok:
        if q is None or q % every:
            continue
        near = []
        for j, v, y in ok:
            if j != i and len(x) == len(y):
                near.append((-vptree.cosines(x[None], y[None])[0], v is None, v or 0, j))
        out |= {(q, rank, v if not null else None, -s) for rank, (s, null, v, _) in enumerate(sorted(near)[:k], 1)}
    return out


def test_vantage_points_factor_one_is_exact(spark):
    x = _clustered(700, 12)
    x[50:90] = x[50]  # one vector forty times: ties
    x[90] = 2 * x[50]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(700, None, 0), (710, [0.0] * 12, 0), (720, [float("nan")] * 12, 0), (730, [float("inf")] + [1.0] * 11, 0),
             (740, [None] + [1.0] * 11, 0), (None, x[50].tolist(), 0), (750, [1.0, 2.0], 0), (760, [2.0, 4.5], 0),
             (770, [], 0), (780, [3e38] * 12, 0)]
    got = vptree.nearest(_vectors(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=200, query_rows=30, sample_rows=50, leaf=16)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}
    assert got == plain_nearest(rows, 10, 5)


def test_vantage_points_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [1.0, 1.0], 0), (7, [0.0, 1.0], None)]
    got = vptree.nearest(_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(1, 50), (2, 7), (1, 0), (2, 7)]
    assert vptree.nearest(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert vptree.nearest(_vectors(spark, [(0, [1.0], 0)]), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_are_neighbours_of_each_other(spark):
    got = vptree.nearest(_vectors(spark, [(50, [1.0, 2.0], 0)] * 3), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(50, 1, 50)] * 3 + [(50, 2, 50)] * 3


def test_a_higher_factor_prunes_more_and_recall_falls_slowly():
    x = _clustered(4000, 8).astype(float)
    order, bounds = vptree.build(vptree.unit(x), 32)
    q = x[::50]
    exact = vptree.unit(q) @ vptree.unit(x).T
    exact[np.arange(len(q)), np.arange(0, 4000, 50)] = -2
    best = np.argsort(-exact, axis=1)[:, :5]
    seen, recall = [], []
    for factor in (1.0, 2.0, 4.0):
        s = vptree.Search(x[order], order, order, bounds, q, np.arange(0, 4000, 50), np.full(len(q), -2.0), 5, factor, 32)
        s.run()
        seen.append(s.visited)
        recall.append(np.mean([len(set(order[p]) & set(b)) / 5 for p, b in zip(s.place, best)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert seen[0] < 0.8 * len(q) * len(x) and seen[0] > seen[1] > seen[2]


def plain_codes(rows, entries=64, rounds=2):
    kept = [(v, lab, [math.floor(256 * c) for c in x]) for v, x, lab in rows
            if x is not None and None not in x and all(map(math.isfinite, x))]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // 16
    cut = lambda x: [x[p * width:(p + 1) * width] for p in range(16)]
    books = [[cut(x)[p] for _, _, x in kept[:entries]] for p in range(16)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda a, book: min((dist(a, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = collections.defaultdict(list)
            for _, _, x in kept:
                own[near(cut(x)[p], book)[1]].append(cut(x)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else c for k, c in enumerate(book)]
    text = ",".join(str(v) for b in books for c in b for v in c)
    out, by_label = [], collections.Counter()
    for v, lab, x in kept:
        got = [near(cut(x)[p], books[p]) for p in range(16)]
        out.append((v, lab, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
        by_label[lab] += out[-1][3]
    return sorted(((v, c, e, by_label[lab]) for v, lab, c, e in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("count, grid", [(300, 0), (40, 0), (200, 1)])
def test_codes_brute_force(spark, count, grid):
    x = _clustered(count, 32)
    if grid:  # few distinct values: ties, equal entries, unused entries
        x = np.round(x)
    rows = [(7 * k % 1009, v.tolist(), [None, 1, 2][k % 3]) for k, v in enumerate(x)]
    rows += [rows[0], (None, rows[1][1], 2), (2000, None, 1), (2001, [float("nan")] * 32, 1), (2002, [None] * 32, 1)]
    out, books = ballkmeans.codes(_vectors(spark, rows).repartition(3))
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in ballkmeans.with_label_error(out, 4).collect()), key=repr)
    assert (got, ballkmeans.digest(books)) == plain_codes(rows)


def test_codes_leave_out_what_has_no_parts(spark):
    good = [(k, [float(k)] * 16, 1) for k in range(5)]
    odd = [(-1, [1.0] * 5, 1), (9, [1.0] * 32, 1), (10, [], 1), (11, [1e9] * 16, 1)]
    out, books = ballkmeans.codes(_vectors(spark, good + odd))
    assert sorted(r.vec_id for r in out.collect()) == [0, 1, 2, 3, 4] and books[0].shape == (5, 1)
    out, books = ballkmeans.codes(_vectors(spark, []))
    assert ballkmeans.with_label_error(out).count() == 0 and ballkmeans.digest(books) == hashlib.sha256(b"").hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 6))
def test_balls_find_the_nearest_entry(seed, entries, spread):
    rng = np.random.default_rng(seed)
    x, book = (rng.integers(-spread, spread + 1, (n, 2)).astype(np.int64) for n in (60, entries))
    own = rng.integers(entries, size=60)  # any earlier entry, also a bad one
    d = ((x - book[own]) ** 2).sum(axis=1)
    radius = np.zeros(entries)
    np.maximum.at(radius, own, np.sqrt(d))
    best, best_d, compared = ballkmeans.reassign(x, own, book, ballkmeans.neighbours(book, radius))
    assert best.tolist() == ballkmeans.nearest_entry(x, book).tolist()
    assert best_d.tolist() == ((x - book[best]) ** 2).sum(axis=1).tolist()
    assert compared <= 60 * (entries - 1)


def test_stable_cores_are_not_compared():
    book = np.array([[0, 0], [100, 0], [0, 100]], np.int64)
    x = np.concatenate([c + np.random.default_rng(1).integers(-20, 21, (50, 2)) for c in book])
    own = np.repeat([0, 1, 2], 50)
    assert ballkmeans.reassign(x, own, book, ballkmeans.neighbours(book, np.full(3, 30.0)))[2] == 0
