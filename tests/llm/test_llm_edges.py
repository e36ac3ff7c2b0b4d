"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import itertools

import pytest

pytest.importorskip("scoreplane.llm")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from scoreplane.llm import common, exact_dedup, langid, lm_score, mixing, near_dedup, packing, pii, quality, toxicity, warc  # noqa: E402

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row_id string, digest string, size string, "
          "`key` string, ids string, target string, cls string, part string, n string, page_id long, url string, html string, "
          "h string, word string, score string, toxic int, l_id string, id string")
LONG = " ".join(f"word{k % 5000}" for k in range(60_000))


def _rows():
    def row(doc_id, text, lang="en", source="a", toxic=0):
        return (doc_id, text, lang, source, None if text is None else len(text), "x", "x", "x", "x", "x", "x", "x", "x", "x",
                doc_id, None, text, "x", "x", "x", toxic, "x", "x")
    plain = " ".join(f"plain{k}" for k in range(80))
    return [row(1, plain), row(1, plain), row(2, plain + " "), row(None, plain), row(None, None, None, None, None),
            row(3, None), row(4, ""), row(5, " \n\t "), row(6, LONG, "de", None), row(7, "one two", None, "b", 1),
            row(8, "!!! 123", "fr", "b"), row(9, "a@b.co +1 (743) 555-3824 " * 30, "fr", "c", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_groups(d),
    "quality": lambda d: quality.measured(d),
    "near": lambda d: near_dedup.near_classes(d),
    "mix": lambda d: mixing.mixture(d),
    "pii": lambda d: pii.find(d),
    "lang": lambda d: langid.identify(d, langid.fit(d, F.lit(True))),
    "lm": lambda d: lm_score.score(d, F.lit(True)),
    "toxic": lambda d: toxicity.score(d, *toxicity.fit(d, d.select("doc_id", "toxic"), F.lit(True))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(edge, empty, name):
    assert OPERATORS[name](edge).count() == len(_rows())
    assert OPERATORS[name](empty).count() == 0


def test_exact_groups_ties_and_repeats(edge):
    g = {(r.doc_id, r.row_id): r for r in exact_dedup.exact_groups(edge).collect()}
    same = [r for r in g.values() if r.win_id == 1]  # doc 2 ends in a space: a text of its own
    assert sorted(r.doc_id or 0 for r in same) == [0, 1, 1] and {r.group_size for r in same} == {3}
    assert sum(r.row_id == r.win_row for r in same) == 1
    blank = [r for r in g.values() if r.win_id == 3]
    assert sorted(r.doc_id or 0 for r in blank) == [0, 3, 4] and {r.group_size for r in blank} == {3}
    assert [r.group_size for r in g.values() if r.doc_id == 5] == [1]  # one space
    kept = exact_dedup.drop_repeats(edge)
    assert kept.columns == edge.columns and kept.count() == len({r.win_row for r in g.values()})


def test_near_classes_edges(edge):
    rows = near_dedup.near_classes(edge).collect()
    plain = [r for r in rows if r.class_size == 4 and r.class_id == 1]
    assert len(plain) == 4 and sum(r.kept for r in plain) == 1
    blank = [r for r in rows if r.class_id == 3]
    assert len(blank) == 4 and sum(r.kept for r in blank) == 1
    assert near_dedup.drop_near(edge).columns == edge.columns


def test_quality_edges(edge):
    rows = quality.measured(edge).select("doc_id", "__q.*").collect()
    assert all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert [r.kept for r in rows if r.doc_id == 1] == [True, True]
    assert [(r.n_words, r.base_failed) for r in rows if r.doc_id == 6] == [(60_000, True)]
    assert quality.clean(edge).columns == edge.columns


def test_mixing_edges(edge):
    rows = mixing.mixture(edge).collect()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(edge).columns == edge.columns


def test_packing_edges(edge, empty):
    pytest.importorskip("public_tokenizers")
    got = packing.pack(edge).toPandas()
    assert len(got[got.start == 0]) == len(_rows())
    assert (got[got.doc_id.isin([3, 4])].doc_tokens == 1).all()
    end = got.sort_values(["sequence_id", "offset"])
    assert (end.sequence_id * 2048 + end.offset).tolist() == [0, *(end.length.cumsum().tolist()[:-1])]
    assert packing.pack(empty).count() == 0


def test_warc_edges(spark, edge, empty):
    rows = warc.archive_and_read(spark, edge).collect()
    assert len(rows) == len(_rows()) and all(r.fault == "" for r in rows)
    assert sum(r.record_type == "response" for r in rows) == len({t[16] or "" for t in _rows()})
    all_responses = warc.archive_and_read(spark, edge, min_bytes=1 << 30).collect()
    assert {r.record_type for r in all_responses} == {"response"}
    assert warc.archive_and_read(spark, empty).count() == 0


def test_language_and_toxicity_edges(edge):
    lang = langid.identify(edge, langid.fit(edge, F.lit(True))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in lang if r.doc_id in (3, 4, 5))
    got = toxicity.score(edge, *toxicity.fit(edge, edge.select("doc_id", "toxic"), F.lit(True))).collect()
    assert all(0 <= r.score <= 1 for r in got)


def test_pii_edges(edge):
    rows = pii.find(edge).collect()
    assert all(r.base == [] for r in rows if r.doc_id in (3, 4, 5, 6))
    assert [len(r.base) for r in rows if r.doc_id == 9] == [60]
    masked = pii.mask(edge)
    assert masked.columns == edge.columns
    assert masked.where("doc_id = 9 and text like '[email] [phone] %'").count() == 1


def test_lm_edges(edge, empty):
    rows = lm_score.score(edge, F.lit(False)).collect()
    assert {(r.base_score, r.train_tokens) for r in rows} == {(0.0, 0)}
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, edge, empty, k):
    pytest.importorskip("public_tokenizers")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edge, "")
    assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == edge.columns
    assert out.count() > 0
    assert stage(spark, empty, "").count() == 0


def test_quality_phrases_in_any_case(spark):
    clean = "\n".join(" ".join(f"word{k}x{j}" for j in range(9)) for k in range(12))
    cases = [f(p) for p in quality.BOILERPLATE for f in (str.lower, str.title, str.upper, str.capitalize,
                                                         lambda p: "".join(c.upper() if i % 2 else c for i, c in enumerate(p)))]
    docs = spark.createDataFrame([(k, f"{clean}\n{p} 2020") for k, p in enumerate(cases)], "doc_id long, text string")
    rows = quality.measured(docs).select("doc_id", "__q.*").collect()
    assert [cases[r.doc_id] for r in rows if r.clean_text != clean or not r.kept] == []


def test_quality_phrase_in_a_long_line(spark):
    words = " ".join(f"word{k}" for k in range(2000))
    cases = [f"{words} to {p} about {words[::-1]}" for p in quality.BOILERPLATE]
    menu = " - ".join(f"{p} {k}" for k in range(5) for p in quality.BOILERPLATE)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*cases, f"{words}\n{menu}"])], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.measured(docs).select("doc_id", "__q.*").collect()}
    assert [cases[k] for k in range(len(cases)) if rows[k].clean_text != cases[k] or not rows[k].kept] == []
    assert rows[len(cases)].clean_text == words  # a long line that is mostly phrases is removed


@pytest.mark.parametrize("name", ["near", "drop_near", "drop_repeats", "mix", "warc"])
def test_file_splits_may_change_between_scans(spark, tmp_path, monkeypatch, name):
    """Every table written moves the file splits of the scans that follow: the rows stay the same."""
    rows = [(k % 40 if k % 3 else k, " ".join(f"t{k % 40}x{j}" for j in range(60)), f"s{k % 2}", f"u{k}") for k in range(120)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string, url string").repartition(6).write.parquet(path)
    run = {
        "near": lambda d: near_dedup.near_classes(d).select("doc_id", "class_id", "class_size", "kept"),
        "drop_near": near_dedup.drop_near, "drop_repeats": exact_dedup.drop_repeats, "mix": mixing.mix,
        "warc": lambda d: warc.archive_and_read(spark, d.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html")))
        .select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "fault"),
    }[name]
    splits, real, count = "spark.sql.files.maxPartitionBytes", common.written, itertools.count()
    found = lambda: sorted(map(repr, run(spark.read.parquet(path)).collect()))
    kept = {k: spark.conf.get(k) for k in (splits, "spark.sql.files.openCostInBytes")}

    def moved(*args, **how):
        out = real(*args, **how)
        spark.conf.set(splits, ("700", "134217728")[next(count) % 2])
        return out
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set(splits, "134217728")
        want = found()
        for m in (common, near_dedup, exact_dedup, mixing, warc):
            monkeypatch.setattr(m, "written", moved)
        for first in ("700", "134217728"):
            spark.conf.set(splits, first)
            assert len(found()) == len(want)
        spark.conf.set(splits, "134217728")
        assert found() == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_toxicity_labels_outside_0_and_1_are_no_labels(spark):
    docs = spark.createDataFrame([(k, f"you idiot number{k % 7}" if k % 3 == 0 else f"a calm day number{k % 7}") for k in range(300)],
                                 "doc_id long, text string")
    good = [(k, int(k % 3 == 0)) for k in range(300)]
    labels = lambda more: spark.createDataFrame(good + more, "doc_id long, toxic int")
    lexicon, weights = toxicity.fit(docs, labels([]), F.lit(True))
    assert "idiot$" in lexicon
    odd = toxicity.fit(docs, labels([(k, v) for k in range(90) for v in (2, -1, None)]), F.lit(True))
    assert odd[0] == lexicon and odd[1].tolist() == weights.tolist()
    assert toxicity.fit(docs, spark.createDataFrame([(1, 2), (2, -1)], "doc_id long, toxic int"), F.lit(True)) == ({}, None)
