"""Spark operators against plain-Python restatements on small fixtures."""

import datetime as dt
import random
import re

import pytest

from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane import rules as R
from scoreplane.operators.asof import asof_join
from scoreplane.operators.tables import assign_ids
from scoreplane.operators.phrase_join import phrase_hits
from scoreplane.plans import classify as CL


def py_hit(kw, text):
    return re.search(r"(?<![a-z])" + re.escape(kw) + r"(?![a-z])", text) is not None


def py_classify(title, desc, rs):
    """Sequential restatement of the keyword rule."""
    t, d = title.lower().strip(), desc.lower().strip()
    for old, new in rs.replacements:
        t, d = t.replace(old, new), d.replace(old, new)
    kws = {}
    for dom, k in rs.keywords:
        kws.setdefault(dom, []).append(k)
    scores = {}
    for dom in rs.domains:
        w = rs.weights.get(dom, 0)
        th = sum(1 for k in kws.get(dom, []) if py_hit(k, t))
        dh = sum(1 for k in kws.get(dom, []) if py_hit(k, d))
        scores[dom] = (FV.TITLE_FACTOR * th + dh) * w
    fe, be = (sum(1 for k in kws.get(x, []) if py_hit(k, t) or py_hit(k, d)) for x in FV.COMBO_DOMAINS)
    if any(py_hit(x, t) or py_hit(x, d) for x in FV.FULLSTACK_TERMS):
        scores[FV.FULLSTACK_DOMAIN] += FV.FULLSTACK_BONUS
    if fe >= FV.COMBO_MIN_HITS and be >= FV.COMBO_MIN_HITS:
        scores[FV.FULLSTACK_DOMAIN] += FV.COMBO_BONUS
    for dom, terms in rs.boosts.items():
        if any(py_hit(x, t) for x in terms):
            scores[dom] += FV.BOOST_TITLE
        if any(py_hit(x, d) for x in terms):
            scores[dom] += FV.BOOST_DESC
    if len(d.split()) < FV.SHORT_DESC_WORDS and not any(py_hit(k, t) or py_hit(k, d) for k in FV.STRONG_PHRASES):
        for dom in scores:
            dh = sum(1 for k in kws.get(dom, []) if py_hit(k, d))
            scores[dom] = max(0, scores[dom] - dh * rs.weights.get(dom, 0) * FV.SHORT_DESC_PENALTY)
    top = max(scores, key=scores.get)
    if scores[top] >= FV.MIN_SCORE:
        for phrase, lbl in FV.TITLE_OVERRIDES:
            if py_hit(phrase, t):
                return lbl
        return top
    return FV.UNCLASSIFIED


WORDS = ("react css html javascript typescript vue django flask api node.js go postgres java backend "
         "frontend full stack full-stack fullstack aws cloud kubernetes docker ci/cd devops c++ unity 3d game "
         "ai ml security cyber iot sensor android ios app mobile pandas sql etl the and x802.11 802.11 "
         "ipv6 tcp/ip sre dba misread cyber security engineer ml engineer data engineer django go2 (go) "
         "full stack developer mobile developer android developer selenium test unit tests").split()


def random_text(rng, n):
    seps = [" ", " ", " ", ", ", "\n", "-", "/", ". "]
    return "".join(rng.choice(WORDS) + rng.choice(seps) for _ in range(n)).strip()


@pytest.mark.parametrize("method", ["inline", "join"])
def test_classifier_matches_python_restatement(spark, method):
    rng = random.Random(7)
    rs = R.sample_ruleset()
    rows = []
    for i in range(300):
        title = random_text(rng, rng.randint(0, 4)).title() if i % 3 else rng.choice(R.SAMPLE_TITLES)
        desc = random_text(rng, rng.choice([0, 3, 7, 8, 12, 40]))
        rows.append((i, title, "  " + desc.upper() if i % 7 == 0 else desc))
    df = spark.createDataFrame(rows, "id long, job_title string, job_description string")
    got = {r["id"]: r["kw_domain"] for r in CL.classify(df, rs, keep=["id"], method=method).collect()}
    want = {i: py_classify(t, d, rs) for i, t, d in rows}
    assert got == want
    assert len(set(want.values())) > 5
    if method == "join":
        keyed = CL.classify(df, rs, keep=["id"], method="join", key="id")
        assert {r["id"]: r["kw_domain"] for r in keyed.collect()} == want


def test_classifier_row_order_invariant(spark):
    rs = R.sample_ruleset()
    rng = random.Random(3)
    rows = [(i, random_text(rng, 2), random_text(rng, 10)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, job_title string, job_description string")
    a = {r["id"]: r["kw_domain"] for r in CL.classify(df, rs, keep=["id"]).collect()}
    b = {r["id"]: r["kw_domain"] for r in CL.classify(df.orderBy(F.rand(1)), rs, keep=["id"]).collect()}
    assert a == b


def test_asof_join_hot_key_matches_brute_force(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    right, left = [], []
    for i in range(600):
        user = 0 if i % 3 == 0 else rng.randint(1, 20)     # user 0 holds a third of the rows
        ts = t0 + dt.timedelta(seconds=rng.randint(0, 100000))
        if rng.random() < 0.4:
            right.append((user, ts, f"c{i}"))
        else:
            left.append((i, user, ts))
    L = spark.createDataFrame(left, "event_id long, user_id long, ts timestamp_ntz")
    Rt = spark.createDataFrame(right, "user_id long, ts timestamp_ntz, code string")
    got = {r["event_id"]: (r["r_ts"], r["r_code"])
           for r in asof_join(L, Rt, "user_id", "ts", "event_id", ["ts", "code"], num_partitions=16).collect()}
    want = {}
    for eid, u, ts in left:
        c = [(rt, code) for ru, rt, code in right if ru == u and rt <= ts]
        want[eid] = max(c) if c else (None, None)
    assert got == want


def test_assign_ids_contiguous_after_max(spark):
    existing = spark.createDataFrame([(5,), (9,)], "id long")
    new = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    out = assign_ids(new, existing, "id", ["k"]).collect()
    pairs = sorted((r["k"], r["id"]) for r in out)
    assert [p[1] for p in pairs] == list(range(10, 1010))


def test_assign_ids_hot_leading_key_checkpointed_input(spark):
    """A third of the rows share the leading order column; ids follow (k, j) exactly."""
    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)]
    new = spark.createDataFrame(rows, "k long, j long").repartition(11).checkpoint(eager=True)
    out = assign_ids(new, None, "id", ["k", "j"], materialize=False).collect()
    got = sorted((r["id"], r["k"], r["j"]) for r in out)
    want = [(n + 1, k, j) for n, (k, j) in enumerate(sorted(rows))]
    assert got == want


@pytest.mark.parametrize("method", ["inline", "join"])
def test_classifier_shared_anchor_dictionary(spark, method):
    """Many multi-word and punctuated terms sharing anchors, random texts over the same words."""
    rng = random.Random(5)
    vocab = ["data", "cloud", "go", "net", "ops", "ai", "stack", "dev"]
    terms = set(vocab)
    for a in vocab:
        for b in vocab:
            if a != b and rng.random() < 0.5:
                terms.add(f"{a} {b}")
        terms.add(f"{a}.js")
        terms.add(f"{a}++")
    terms |= {"802.11", "3d", "a/b", "ci/cd"}
    doms = list(FV.DOMAIN_WEIGHTS)[:10]
    kws = [(doms[i % len(doms)], t) for i, t in enumerate(sorted(terms))]
    kws += kws[:5]  # repeated entries count again
    rs = R.RuleSet(replacements=[("dev ops", "devops")], keywords=kws)
    seps = [" ", " ", ".", "++ ", ", ", "/", "\n", "-", "x"]
    words = vocab + ["802.11", "3d", "a/b", "ci/cd", "the", "js"]

    def txt(n):
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n)).strip()

    rows = [(i, txt(rng.randint(0, 3)), txt(rng.choice([2, 5, 9, 30]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, job_title string, job_description string")
    got = {r["id"]: r["kw_domain"] for r in CL.classify(df, rs, keep=["id"], method=method).collect()}
    want = {i: py_classify(t, d, rs) for i, t, d in rows}
    assert got == want
    assert len(set(want.values())) > 3


def test_classifier_forms_follow_the_callers_rules_not_a_size(spark):
    """30,000 keywords: as a list they are inlined, as a table joined; the labels are the same and no job runs early."""
    rs = R.sample_ruleset()
    more = R.RuleSet(replacements=rs.replacements, keywords=rs.keywords + [("Networking", f"zz{k} qq") for k in range(30_000)])
    rows = [(i, x, "that ered thly with zz7 qq, zz29999 qq and zz30000 qq") for i, x in enumerate(R.SAMPLE_TITLES[:2])]
    df = spark.createDataFrame(rows, "id long, job_title string, job_description string")
    kt = spark.createDataFrame(more.keywords, "domain string, keyword string")
    spark.sparkContext.setJobGroup("table-plan", "table-plan")
    q = CL.classify_table(df, more, kt, keep=["id"], with_score=True)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("table-plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["id"]: r["kw_domain"] for r in q.collect()} == {i: py_classify(t, d, more) for i, t, d in rows}


def test_phrase_join_matches_regex(spark):
    """Every kind of edge: letters and gaps at the ends, inner gaps, phrases without letters, overlaps, odd characters."""
    rng = random.Random(4)
    parts = ["a", "b", "ab", "c++", ".net", "node.js", " ", "  ", ". ", "1", "11", "+", "\n", "ba", "é", "x", "A", "'", "\\"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(250)] + [(900, None)]
    terms = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)})
    got = phrase_hits(spark.createDataFrame(texts, "row long, text string").repartition(3),
                      spark.createDataFrame([(t,) for t in [*terms, terms[0], "", None]], "term string"))
    want = sorted((k, p) for k, s in texts for p in terms if s and re.search("(?<![a-z])" + re.escape(p) + "(?![a-z])", s))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_fifty_thousand_phrases_on_one_run(spark):
    """All phrases share their only frequent run, with other gaps or other rare runs: candidates stay near the hits."""
    terms = [f"data {k}" for k in range(25_000)] + [f"data w{_letters(k)}" for k in range(25_000)]
    texts = [(k, f"the data {k} and data w{_letters(2 * k)}, more data, data " * 5) for k in range(400)]
    t, p = spark.createDataFrame(texts, "row long, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.row, r.term) for r in phrase_hits(t, p).collect()}
    assert {(k, x) for k, x in got if "w" in x} == {(k, f"data w{_letters(2 * k)}") for k in range(400)}
    # digits are boundaries of letters only: data 39 is in data 399 too
    assert {(k, x) for k, x in got if "w" not in x} == {
        (k, f"data {str(k)[:n]}") for k in range(400) for n in range(1, len(str(k)) + 1)}


def _shuffled_bytes(plan):
    """Bytes that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_bytes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled_bytes(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
    below = plan.children()
    return own + (0 if kind == "ReusedExchangeExec" else sum(_shuffled_bytes(below.apply(k)) for k in range(below.size())))


def test_phrase_join_shuffles_hits_not_words(spark):
    """Every word of the texts is in some phrase, yet what is shuffled stays below the size of the texts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1500)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(400))) for k in range(200)]
    terms = {f"{w} {rng.choice(words)}" for w in words}
    df = phrase_hits(spark.createDataFrame(texts, "row long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    got = sorted(map(tuple, df.collect()))
    want = sorted({(k, f"{a} {b}") for k, s in texts for a, b in zip(s.split(), s.split()[1:]) if f"{a} {b}" in terms})
    assert got == want and want
    assert _shuffled_bytes(df._jdf.queryExecution().executedPlan()) < sum(len(s) for _, s in texts) / 2


def test_phrase_filter_lets_every_phrase_through(spark):
    """All bits of a tiny filter are set: slower, the same rows."""
    from scoreplane.operators import phrase_join

    old, phrase_join.FILTER_BITS = phrase_join.FILTER_BITS, 64
    try:
        t = spark.createDataFrame([(1, "c++ and node.js"), (1, "c++ and node.js"), (None, "no c, + + here")], "row long, text string")
        p = spark.createDataFrame([("c++",), ("node",), ("node.js",), ("+ +",), ("no c",), ("odd",)], "term string")
        got = sorted(map(tuple, phrase_hits(t, p).collect()), key=str)
    finally:
        phrase_join.FILTER_BITS = old
    assert got == sorted([(1, "c++"), (1, "node"), (1, "node.js"), (None, "no c"), (None, "+ +")], key=str)


def _letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def test_registration_batch_equals_sequential_inserts(spark):
    from scoreplane.operators.accounts import register_batch

    rng = random.Random(9)
    stored = [(1, "u0", "e0@x.io"), (2, "u1", None)]
    reqs = []
    t0 = dt.datetime(2024, 1, 1)
    for i in range(200):
        u = f"u{rng.randint(0, 40)}"
        e = None if rng.random() < 0.2 else f"e{rng.randint(0, 40)}@x.io"
        reqs.append((i, u, e, t0 + dt.timedelta(seconds=rng.randint(0, 50))))
    acc = spark.createDataFrame(stored, "id long, username string, email string")
    batch = spark.createDataFrame(reqs, "req_id long, username string, email string, ts timestamp_ntz")
    got = {r["req_id"]: (r["accepted"], r["rejected_for"]) for r in register_batch(batch, acc).collect()}
    names = {u for _, u, _ in stored}
    mails = {e for _, _, e in stored if e}
    want = {}
    for rid, u, e, ts in sorted(reqs, key=lambda r: (r[3], r[0])):
        if u in names:
            want[rid] = (False, "username")
        elif e is not None and e in mails:
            want[rid] = (False, "email")
        else:
            want[rid] = (True, None)
            names.add(u)
            if e is not None:
                mails.add(e)
    assert got == want
    assert sum(1 for v in want.values() if v[0]) > 10


def test_keyword_hits_join_form_equals_inline(spark):
    from scoreplane.functions.text import compose_text
    from scoreplane.sources import fixtures as FX

    p = FX.postings(spark, "/root/testdata/sf0.001")
    rs = R.sample_ruleset()
    desc = compose_text("job_description", "resume_text")
    a = CL.keyword_hits(p, rs, "id", "job_title", desc, method="inline")
    b = CL.keyword_hits(p, rs, "id", "job_title", desc, method="join")
    assert a.schema == b.schema
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() > 0


def test_best_scores_join_form_equals_inline(spark):
    from scoreplane.functions.text import compose_text
    from scoreplane.sources import fixtures as FX

    p = FX.postings(spark, "/root/testdata/sf0.001")
    rs = R.sample_ruleset()
    desc = compose_text("job_description", "resume_text")
    a = CL.best_scores(p, rs, "job_title", desc, keep=["id"], method="inline")
    b = CL.best_scores(p, rs, "job_title", desc, keep=["id"], method="join")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_classify_table_keeps_keywords_as_dataframe(spark):
    """Keyword table as a DataFrame (the unbounded form) equals the plain-Python restatement."""
    rng = random.Random(11)
    rs = R.sample_ruleset()
    rows = [(i, random_text(rng, rng.randint(0, 4)), random_text(rng, rng.choice([0, 3, 7, 8, 12, 40])))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, job_title string, job_description string")
    kt = spark.createDataFrame(rs.keywords, "domain string, keyword string")
    got = {r["id"]: r["kw_domain"] for r in CL.classify_table(df, rs, kt, keep=["id"]).collect()}
    want = {i: py_classify(t, d, rs) for i, t, d in rows}
    assert got == want
