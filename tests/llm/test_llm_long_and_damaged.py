"""Dense long texts, damaged archives and number signs."""

import itertools
import time
import tracemalloc

import numpy as np
import pytest

from scoreplane.llm import langid, pii, warc


def _weights():
    rng = np.random.default_rng(0)
    some = []
    for _ in range(60):
        n = "".join(map(str, rng.integers(0, 10, 3)))
        some += [f"call now +1 ({n}) 555-{n}1 please", f"write to a{n}.b@mail{n}.example.com soon", f"about {n} of {n}7 items"]
    return pii.fit(some)


def _best_of_all(w, weights):
    """The highest score of any set of segments that do not overlap."""
    tokens, segs = pii.segments(w)
    scored = [(i, j, max(float(weights[k, f].sum()) for k in range(len(pii.KINDS))) - pii.MARGIN) for i, j, f in segs]
    best = 0.0
    for n in range(1, 4):
        for some in itertools.combinations(scored, n):
            ordered = sorted(some)
            if all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:])):
                best = max(best, sum(x[2] for x in some))
    return best


def test_decoder_finds_the_best_of_all_segmentations():
    rng = np.random.default_rng(3)
    for _ in range(60):
        w = "".join(rng.choice(["555 ", "1234567", "@", "a.b", ".com", " ", "+1 ", "(743) ", "-", "card "], 7))
        weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
        tokens, segs = pii.segments(w)
        if len(segs) > 60:
            continue
        at = {(tokens[i][0], tokens[j - 1][1]): f for i, j, f in segs}
        got = pii.decode(w, weights)
        assert all(x[2] <= y[0] for x, y in zip(got, got[1:]))
        score = sum(float(weights[k, at[a, b]].sum()) - pii.MARGIN for a, k, b in got)
        assert score == pytest.approx(_best_of_all(w, weights)) or len(got) > 3


@pytest.mark.parametrize("unit", ["743 555 3824, ", "a1@b2.com, ", "12 ", "@ "])
def test_a_long_list_takes_linear_time_and_bounded_memory(unit):
    weights = _weights()
    text = unit * (200_000 // len(unit))
    begin = time.time()
    pii.added(text, pii.base_spans(text), weights)
    assert time.time() - begin < 40
    small = unit * (20_000 // len(unit))
    tracemalloc.start()
    pii.added(small, pii.base_spans(small), weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(small)


def test_number_signs_are_no_letters(spark):
    assert langid.words_of("\u00bd \u00b2 \u2460 a\u00bdbc") == ["a", "bc"]
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "\u00bd \u00b2 \u2460", "en"),
                                  (4, "the\u00bdcat", "en")], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs, F.col("doc_id") < 3)).collect()}
    assert (got[3].lang_pred, got[3].score) == ("und", 0.0) and got[4].lang_pred == "en"
    assert [(s.start, s.end) for s in got[4].spans] == [(0, 7)]


@pytest.mark.parametrize("lost", ["first", "middle", "last"])
def test_a_record_with_a_chunk_missing_is_reported_once(spark, tmp_path, lost):
    pages = spark.createDataFrame([(1, "http://a", "x" * 50), (2, "http://b", "y" * 50)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"), chunk=10)
    archive = spark.read.parquet(str(tmp_path / "w"))
    last = archive.groupBy().max("chunk_no").first()[0]
    record = [r.record_id for r in warc.read_archive(archive).collect() if r.page_id == 1][0]
    hurt = archive.where(f"NOT (record_id = {record} AND chunk_no = {dict(first=0, middle=2, last=last)[lost]})")
    got = warc.read_archive(hurt).collect()
    assert sorted((r.page_id or 0, r.record_id == record, r.fault) for r in got) == [(0, True, "chunk missing"), (2, False, "")]
