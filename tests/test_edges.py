"""Hand-written edge rows with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane import rules as R
from scoreplane.functions import scalars as SC
from scoreplane.functions import text as TX
from scoreplane.operators import accounts as AC
from scoreplane.operators import aggregates as AG
from scoreplane.operators import calllog as CG
from scoreplane.operators import filters as FL
from scoreplane.operators import labels as LB
from scoreplane.operators import similarity as SM
from scoreplane.operators import tables as TB
from scoreplane.plans import classify as CL
from scoreplane.plans import ingest as IG
from scoreplane.sources.schemas import CANDIDATES


def cand(spark, rows):
    """rows: (id, ats, bias, domain, ts)"""
    full = [(i, f"r{i}", f"c{i}", a, 50, 50, 50, 50, 50, 50, b, d, t) for i, a, b, d, t in rows]
    return spark.createDataFrame(full, CANDIDATES)


T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def test_float_threshold_semantics(spark):
    df = cand(spark, [(1, 50, 0.6, "A", T0), (2, 50, 0.7, "A", T0)])
    flagged = {r["candidate_name"] for r in FL.flagged(df, 0.6).collect()}
    assert flagged == {"c1", "c2"}            # 0.6f > 0.6 (double)
    assert FL.flagged(df, 0.7).count() == 0   # 0.7f is below 0.7
    biased = {r["bias_category"]: r["count"] for r in AG.threshold_split(df, 0.7).collect()}
    assert biased == {"Fair": 2}
    with pytest.raises(ValueError):
        FL.flagged(df, 1.5)


def test_rounding_tie_half_up(spark):
    df = spark.createDataFrame([(1.0,), (1.01,)], "x double")
    v = df.agg(SC.round_avg("x", 2).alias("a")).first()["a"]
    assert v == 1.01


def test_retention_boundary(spark):
    as_of = "2025-02-20"
    df = cand(spark, [(1, 1, 0.1, "A", dt.datetime(2024, 2, 21, 0, 0)),    # exactly as_of - 365
                      (2, 1, 0.1, "A", dt.datetime(2024, 2, 20, 23, 59, 59))])
    assert [r["id"] for r in TB.retain_recent(df, as_of, 365).collect()] == [1]
    assert [r["id"] for r in TB.expired_rows(df, as_of, 365).collect()] == [2]


def test_date_range_inclusive_and_arg_check(spark):
    df = cand(spark, [(1, 1, 0.1, "A", dt.datetime(2024, 3, 1, 0, 0)),
                      (2, 1, 0.1, "A", dt.datetime(2024, 3, 31, 23, 59, 59)),
                      (3, 1, 0.1, "A", dt.datetime(2024, 4, 1, 0, 0))])
    assert [r["id"] for r in FL.between_dates(df, "2024-03-01", "2024-03-31").collect()] == [2, 1]
    with pytest.raises(ValueError):
        FL.between_dates(df, "2024-3-1x", "2024-03-31")


def test_offset_ignored_without_limit(spark):
    df = cand(spark, [(i, i, 0.1, "A", T0 + dt.timedelta(minutes=i)) for i in range(5)])
    assert FL.list_candidates(df, offset=3).count() == 5
    assert [r["id"] for r in FL.list_candidates(df, limit=2, offset=1).collect()] == [3, 2]


def test_empty_table_summary(spark):
    df = spark.createDataFrame([], CANDIDATES)
    r = AG.table_summary(df).first()
    assert (r["total_candidates"], r["avg_ats_score"], r["avg_bias_score"], r["unique_domains"]) == (0, 0.0, 0.0, 0)
    assert r["earliest_date"] is None and r["latest_date"] is None
    assert AG.average_by_group(df).count() == 0
    assert AG.group_distribution(df).count() == 0


# ---------------------------------------------------------------- cache and keys
def cache_df(spark, rows):
    return spark.createDataFrame(rows, "prompt_hash string, response string, timestamp timestamp_ntz")


def test_cache_ttl_boundary(spark):
    as_of = dt.datetime(2024, 1, 2, 12, 0, 0)
    cache = cache_df(spark, [("a", "ok", as_of - dt.timedelta(hours=24)),
                             ("b", "ok", as_of - dt.timedelta(hours=24, microseconds=1)),
                             ("c", "", as_of)])
    kept = {r["prompt_hash"] for r in CG.purge_cache(cache, as_of).collect()}
    assert kept == {"a", "c"}
    req = spark.createDataFrame([("p", "m")], "prompt string, model string")
    h = CG.with_hash(req).first()["prompt_hash"]
    cache2 = cache_df(spark, [(h, "", as_of)])
    assert CG.probe_cache(req, cache2, as_of).first()["hit"] is False  # empty response = miss
    cache3 = cache_df(spark, [(h, "yes", as_of - dt.timedelta(hours=24))])
    assert CG.probe_cache(req, cache3, as_of).first()["cached_response"] == "yes"


def test_prompt_hash_is_sha256_of_model_bar_prompt(spark):
    import hashlib

    req = spark.createDataFrame([("hello", "m1")], "prompt string, model string")
    assert CG.with_hash(req).first()["prompt_hash"] == hashlib.sha256(b"m1|hello").hexdigest()


def test_key_health_boundaries(spark):
    now = dt.datetime(2024, 1, 2, 12, 0, 0)
    keys = spark.createDataFrame([(k,) for k in "abcdefg"], "api_key string")
    failures = spark.createDataFrame([
        ("a", now - dt.timedelta(minutes=5), "error"),                   # exactly 5 min: healthy
        ("b", now - dt.timedelta(minutes=4, seconds=59), "error"),       # cooling
        ("c", now - dt.timedelta(minutes=60), "quota"),                  # exactly 60 min: healthy
        ("d", now - dt.timedelta(minutes=59), "quota"),                  # cooling
    ], "api_key string, fail_time timestamp_ntz, reason string")
    usage = spark.createDataFrame([
        ("e", 799, dt.date(2024, 1, 2)), ("f", 800, dt.date(2024, 1, 2)), ("g", 5000, dt.date(2024, 1, 1)),
        ("d", 900, dt.date(2024, 1, 2)),
    ], "api_key string, usage_count bigint, last_reset date")
    h = {r["api_key"]: r["status"] for r in CG.key_health(keys, failures, usage, now).collect()}
    assert h == {"a": "healthy", "b": "cooling", "c": "healthy", "d": "cooling",
                 "e": "healthy", "f": "over_quota", "g": "healthy"}
    q = CG.quota_failures(CG.key_health(keys, failures, usage, now), now).collect()
    assert [(r["api_key"], r["reason"]) for r in q] == [("f", "quota")]


def test_failure_reason_words(spark):
    df = spark.createDataFrame([("HTTP 429",), ("Rate limit reached",), ("QUOTA",), ("boom",)], "e string")
    assert [r[0] for r in df.select(SC.failure_reason("e")).collect()] == ["quota", "quota", "quota", "error"]


def test_usage_merge_equals_sequential_fold(spark):
    rows = [(i, "k1" if i % 3 else "k2", i % 2 == 0, dt.datetime(2024, 1, 1 + i // 7, i % 24), "m", "p", "r", None)
            for i in range(60)]
    calls = spark.createDataFrame(rows, "call_id long, api_key string, own_key boolean, ts timestamp_ntz, "
                                        "model string, prompt string, response string, error string")
    # sequential fold of the per-call upsert
    state = {}
    for r in sorted(rows, key=lambda x: (x[3], x[0])):
        day = r[3].date()
        c, d = state.get(r[1], (0, None))
        state[r[1]] = (c + 1, day) if d == day else (1, day)
    got = {r["api_key"]: (r["usage_count"], r["last_reset"]) for r in CG.usage_state(calls).collect()}
    assert got == state
    cut = dt.datetime(2024, 1, 4)
    old = CG.usage_state(calls.where(F.col("ts") < cut))
    merged = {r["api_key"]: (r["usage_count"], r["last_reset"])
              for r in CG.merge_usage(old, calls.where(F.col("ts") >= cut)).collect()}
    assert merged == state


def test_own_key_success_does_not_clear_failure(spark):
    t = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([
        (1, "own", True, t, "m", "p", None, "Quota exceeded"),
        (2, "own", True, t + dt.timedelta(minutes=1), "m", "p", "ok", None),
        (3, "pool", False, t, "m", "p", None, "boom"),
        (4, "pool", False, t + dt.timedelta(minutes=1), "m", "p", "ok", None),
    ], "call_id long, api_key string, own_key boolean, ts timestamp_ntz, model string, prompt string, "
       "response string, error string")
    st = {r["api_key"]: r["reason"] for r in CG.failure_state(calls).collect()}
    assert st == {"own": "quota"}


# ---------------------------------------------------------------- text rules
def test_replacement_order_is_chained(spark):
    rs = R.sample_ruleset()
    df = spark.createDataFrame([("Thon Ther",), ("MIT License",), ("where",)], "t string")
    got = [r[0] for r in df.select(CL.normalized(F.col("t"), rs)).collect()]
    assert got == ["anea", "licence grant", "wthere"]


@pytest.mark.parametrize("text,phrase,expected", [
    ("django", "go", False), ("go2", "go", True), ("(go)", "go", True), ("go-lang", "go", True),
    ("x802.11", "802.11", False), ("1802.11", "802.11", True), ("c++ games", "c++", True),
    ("node.js", "node.js", True), ("nodexjs", "node.js", False),
])
def test_phrase_boundaries(spark, text, phrase, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(TX.has_phrase(F.col("t"), phrase)).first()[0] is expected


def _classify_one(spark, rs, title, desc):
    df = spark.createDataFrame([(1, title, desc)], "id long, job_title string, job_description string")
    r = CL.classify(df, rs, keep=["id"], with_score=True).first()
    return r["kw_domain"], r["kw_domain_score"]


def test_argmax_tie_and_threshold(spark):
    rs = R.RuleSet(replacements=[], keywords=[("Cloud Engineering", "kubernetes"),
                                              ("DevOps/Infrastructure", "kubernetes"),
                                              ("Quality Assurance", "selenium")],
                   boosts={})
    # tie 12 vs 12 -> Cloud Engineering comes first in rule order
    assert _classify_one(spark, rs, "kubernetes", "one two three four five six seven eight") == \
        ("Cloud Engineering", 12.0)
    # short description: 3*1 -> 3 - 1.5 = 1.5 ... with title 12: 12+3-1.5 = 13.5
    assert _classify_one(spark, rs, "kubernetes", "kubernetes") == ("Cloud Engineering", 13.5)
    # 7.5 is below the threshold, 9 reaches it
    rs2 = R.RuleSet(replacements=[], keywords=[("Quality Assurance", "selenium"), ("Quality Assurance", "qa")],
                    weights={"Quality Assurance": 2.5}, boosts={})
    assert _classify_one(spark, rs2, "", "selenium qa and more words to pass eight")[0] == FV.UNCLASSIFIED
    rs3 = R.RuleSet(replacements=[], keywords=[("Quality Assurance", "selenium"), ("Quality Assurance", "qa")],
                    weights={"Quality Assurance": 4}, boosts={})
    assert _classify_one(spark, rs3, "", "selenium qa and more words to pass eight") == ("Quality Assurance", 8.0)


def test_title_override_survives_only_doubled_text(spark):
    rs = R.RuleSet(replacements=[("full stack developer", "full stack")],
                   keywords=[("Frontend Development", k) for k in ("that", "ered", "thly", "onnd")])
    label, _ = _classify_one(spark, rs, "full stack developer developer", "that ered thly onnd")
    assert label == "Full Stack Development"


def test_similarity_rules(spark):
    df = spark.createDataFrame([
        (1, "Data Science", "Business Analysis"), (2, "Business Analysis", "Data Science"),
        (3, "Unknown", "Data Science"), (4, "Foo", " foo "), (5, "ML", "data science"),
        (6, "Backend Development", "Networking"), (7, "Data Science", "Game Development"),
        (8, "Product Management", "Agile Coaching"), (9, "UI/UX Design", "Fintech"),
    ], "id long, a string, b string")
    got = {r["id"]: r["similarity"] for r in SM.similarity(df, "a", "b").collect()}
    assert got == {1: 0.70, 2: 0.65, 3: 0.25, 4: 1.0, 5: 0.95, 6: 0.45, 7: 0.40, 8: 0.50, 9: 0.25}
    assert all(0.0 <= v <= 1.0 for v in got.values())


def test_confidence_branches(spark):
    df = spark.createDataFrame([
        (1, "Data Science", None), (2, "Data Science", "data science"),
        (3, "Unclassified", "Fintech"), (4, "Fintech", "EdTech"), (5, "Unclassified", "Unclassified"),
    ], "id long, kw_domain string, llm_domain string")
    got = {r["id"]: (r["domain"], r["confidence"], r["agreed"]) for r in LB.reconcile(df).collect()}
    assert got == {1: ("Data Science", "low", False), 2: ("data science", "high", True),
                   3: ("Fintech", "high", False), 4: ("EdTech", "medium", False),
                   5: ("Unclassified", "high", True)}


def test_invalid_label_becomes_null(spark):
    ml = spark.createDataFrame([(1, " Fintech "), (2, "fintech"), (3, "LLM unavailable")], "id long, label string")
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    got = {r["id"]: r["llm_domain"] for r in LB.attach_labels(df, ml).collect()}
    assert got == {1: "Fintech", 2: None, 3: None, 4: None}


# ---------------------------------------------------------------- validation and ingest
def test_validation_rules(spark):
    rows = [(1, 50.0, 85.5, float("nan"), 0.5, None), (2, 101.0, 0.0, 0.0, 0.5, 85.9),
            (3, -1.0, 0.0, 0.0, 1.01, None), (4, 84.5, 0.0, 0.0, 0.0, 100.9)]
    df = spark.createDataFrame(rows, "sub_id long, ats_score double, edu_score double, skills_score double, "
                                     "bias_score double, format_score double")
    for c in ("exp_score", "lang_score", "keyword_score"):
        df = df.withColumn(c, F.lit(10.0))
    errs = {r["sub_id"]: r["e"] for r in df.select("sub_id", IG.validation_errors(df).alias("e")).collect()}
    assert errs == {1: ["skills_score"], 2: ["ats_score"], 3: ["ats_score", "bias_score"], 4: []}
    ints = df.select(IG.to_int_score(F.lit(85.5)).alias("a"), IG.to_int_score(F.lit(84.5)).alias("b")).first()
    assert (ints["a"], ints["b"]) == (86, 85)
    fmt = df.where("sub_id = 2").select(IG._truncate(F.col("format_score")).cast("int")).first()[0]
    assert fmt == 85


# ---------------------------------------------------------------- accounts and codes
def test_registration_conflicts(spark):
    acc = spark.createDataFrame([(1, "alice", "a@x.io"), (2, "bob", None)], "id long, username string, email string")
    batch = spark.createDataFrame([
        (10, "carol", None, T0), (11, "dave", None, T0),                 # two NULL e-mails: both fine
        (12, "erin", "e@x.io", T0), (13, "frank", "e@x.io", T0 + dt.timedelta(seconds=1)),
        (14, "alice", "a@x.io", T0),                                     # both taken
    ], "req_id long, username string, email string, ts timestamp_ntz")
    pre = {r["req_id"]: r["conflict"] for r in AC.existing_conflicts(batch, acc).collect()}
    assert pre == {10: None, 11: None, 12: None, 13: None, 14: "email"}
    dec = {r["req_id"]: (r["accepted"], r["rejected_for"]) for r in AC.register_batch(batch, acc).collect()}
    assert dec == {10: (True, None), 11: (True, None), 12: (True, None), 13: (False, "email"),
                   14: (False, "username")}
    ids = sorted(r["id"] for r in AC.new_accounts(AC.register_batch(batch, acc), acc).collect())
    assert ids == [3, 4, 5]


def test_code_expiry_boundaries(spark):
    rows = [(1, 7, "issue", "111111", T0),
            (2, 7, "attempt", "000000", T0 + dt.timedelta(seconds=10)),         # wrong code, stays open
            (3, 7, "attempt", "111111", T0 + dt.timedelta(seconds=180)),        # exactly 180 s: ok
            (4, 7, "attempt", "111111", T0 + dt.timedelta(seconds=200)),        # issue used up
            (5, 8, "issue", "222222", T0),
            (6, 8, "attempt", "999999", T0 + dt.timedelta(seconds=180, milliseconds=1)),  # expired first
            (7, 9, "attempt", "333333", T0)]                                     # nothing issued
    ev = spark.createDataFrame(rows, "event_id long, user_id long, kind string, code string, ts timestamp_ntz")
    got = {r["event_id"]: r["outcome"] for r in AC.match_codes(ev, 180).collect()}
    assert got == {2: "invalid", 3: "ok", 4: "no_pending", 6: "expired", 7: "no_pending"}


def test_identity_resolution(spark):
    acc = spark.createDataFrame([(1, "alice", "a@x.io")], "id long, username string, email string")
    req = spark.createDataFrame([(1, "a@x.io"), (2, "alice"), (3, "alice@x"), (4, "zed")],
                                "req_id long, identifier string")
    got = {r["req_id"]: r["matched_username"] for r in AC.resolve_identity(req, acc).collect()}
    assert got == {1: "alice", 2: "alice", 3: None, 4: None}


def test_email_pattern(spark):
    df = spark.createDataFrame([("a.b@c.io",), ("a@b",), ("a@b.c",), ("x y@z.com",), (None,)], "email string")
    assert [r["email_valid"] for r in AC.email_check(df).collect()] == [True, False, False, False, False]


# ---------------------------------------------------------------- catalogue
def test_nested_catalog_json_roundtrip(spark, tmp_path):
    import json

    from scoreplane.operators import catalog as CT
    from scoreplane.sources.catalog import read_catalog_json

    doc = {"catalog": {"Software": {"Frontend Developer": [{"title": "CSS", "url": "u1"},
                                                           {"title": "React", "url": "u2"}],
                                    "Backend Developer": [{"title": "Go", "url": "u3"}]},
                       "Data": {"Analyst": [{"title": "SQL", "url": "u4"}]}}}
    p = tmp_path / "cat.json"
    p.write_text(json.dumps(doc) + "\n")
    cat = read_catalog_json(spark, str(p))
    flat = {(r["category"], r["role"], r["name"], r["link"]) for r in CT.flatten(cat).collect()}
    assert flat == {("Software", "Frontend Developer", "CSS", "u1"), ("Software", "Frontend Developer", "React", "u2"),
                    ("Software", "Backend Developer", "Go", "u3"), ("Data", "Analyst", "SQL", "u4")}
    got = [r["name"] for r in CT.courses_for_role(cat, "Software", "Backend Developer").collect()]
    assert got == ["Go"]
    assert CT.courses_for_role(cat, "Software", "Nobody").count() == 0
    assert CT.courses_for_role(cat, "Nothing", "Backend Developer").count() == 0


def test_percentages_use_whole_table_total_with_having(spark):
    df = cand(spark, [(1, 10, 0.1, "A", T0), (2, 20, 0.1, "A", T0), (3, 30, 0.1, "B", T0)])
    rows = {r["domain"]: r["percentage"] for r in AG.group_frequency(df, min_count=2).collect()}
    assert rows == {"A": 66.67}
    rows = {r["domain"]: r["percentage"] for r in AG.group_distribution(df).collect()}
    assert rows == {"A": 66.67, "B": 33.33}


def test_similarity_literal_and_join_forms_agree(spark):
    from scoreplane.sources import fixtures as FX

    df = FX.label_pairs(spark, "/root/testdata/sf0.001")
    a = SM.similarity(df, "resume_domain", "job_domain").select("id", "similarity")
    b = SM.similarity(df, "resume_domain", "job_domain", aliases=R.alias_table(spark), pairs=R.pair_table(spark),
                      groups=R.group_table(spark)).select("id", F.col("similarity").alias("s2"))
    assert a.join(b, "id").where(F.col("similarity") != F.col("s2")).count() == 0
    assert a.count() == df.count()


def test_similarity_oversized_pair_table_joins_by_shuffle(spark):
    """A pair table above the broadcast bound is joined by shuffle with the same answers."""
    from scoreplane.sources import fixtures as FX

    df = FX.label_pairs(spark, "/root/testdata/sf0.001")
    pairs = R.pair_table(spark)
    filler = spark.range(R.MAX_RULE_ROWS + 1).selectExpr(
        "concat('zz', CAST(id AS STRING)) AS a", "'zz' AS b", "CAST(0.9 AS DOUBLE) AS similarity")
    big = pairs.unionByName(filler.select(*[F.col(c).cast(pairs.schema[c].dataType) for c in pairs.columns]))
    a = SM.similarity(df, "resume_domain", "job_domain").select("id", "similarity")
    out = SM.similarity(df, "resume_domain", "job_domain", pairs=big)
    b = out.select("id", F.col("similarity").alias("s2"))
    assert a.join(b, "id").where(F.col("similarity") != F.col("s2")).count() == 0
    assert b.count() == df.count()


def test_rules_from_tables_match_sample(spark):
    rs = R.sample_ruleset()
    rs2 = R.ruleset_from_tables(R.replacements_table(spark), R.keywords_table(spark, rs))
    assert rs2.replacements == rs.replacements and rs2.keywords == rs.keywords and rs2.domains == rs.domains
    df = spark.createDataFrame([(1, "Ered Thly", "that ered eron"), (2, None, None),
                                (3, "Thble Attion", None)], "id long, job_title string, job_description string")
    a = {r["id"]: r["kw_domain"] for r in CL.classify(df, rs, keep=["id"]).collect()}
    b = {r["id"]: r["kw_domain"] for r in CL.classify(df, rs2, keep=["id"]).collect()}
    assert a == b
    assert a[2] == FV.UNCLASSIFIED and a[1] == "Frontend Development" and a[3] == "AI/Machine Learning"


def test_rule_table_size_is_checked(spark):
    big = spark.range(R.MAX_RULE_ROWS + 1).selectExpr("1 AS rank", "'X' AS domain", "CAST(id AS STRING) AS keyword")
    with pytest.raises(ValueError):
        R.ruleset_from_tables(R.replacements_table(spark), big)


def test_checkpoint_dir_required_on_a_cluster():
    """Without spark.checkpoint.dir a cluster session raises; it never falls back to a local folder."""
    from types import SimpleNamespace

    from scoreplane.session import checkpoint_dir

    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None,
                         setCheckpointDir=lambda d: pytest.fail("must not set a local folder"))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: default), sparkContext=sc)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
    fake.conf = SimpleNamespace(get=lambda k, default=None: "hdfs://nn/ckpt/" if k == "spark.checkpoint.dir" else default)
    seen = []
    sc.setCheckpointDir = seen.append
    assert checkpoint_dir(fake) == "hdfs://nn/ckpt" and seen == ["hdfs://nn/ckpt/"]


def test_rejected_without_classification_equals_ingest(spark):
    from scoreplane.sources import fixtures as FX

    sub = FX.submissions(spark, "/root/testdata/sf0.001")
    full = IG.ingest(sub, FX.candidates(spark, "/root/testdata/sf0.001"),
                     FX.model_labels(spark, "/root/testdata/sf0.001"), R.sample_ruleset(), "2025-02-20 06:30:00")
    a = sorted((r["sub_id"], tuple(r["errors"])) for r in full.rejected.collect())
    b = sorted((r["sub_id"], tuple(r["errors"])) for r in IG.rejected(sub).collect())
    assert a == b and len(a) > 0


def test_csv_export_is_lossless(spark, tmp_path):
    from scoreplane.sources import tables as ST

    texts = ["  pad ", "a\nb", "a\r\nb", "", None, 'say "x"', "back\\slash\\", "\\N", ",", '"']
    texts.remove("\\N")  # the mark for NULL
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    ST.export_csv(df, str(tmp_path / "x"))
    got = {r.id: r["name"] for r in ST.read_csv(spark, str(tmp_path / "x"), df.schema).collect()}
    assert got == dict(enumerate(texts))


def test_integer_scores_round_half_away_from_zero(spark):
    from scoreplane.plans import ingest as IG

    df = spark.createDataFrame([(0.5,), (84.5,), (85.5,), (84.4,), (None,)], "x double")
    assert [r[0] for r in df.select(IG.to_int_score(F.col("x"))).collect()] == [1, 85, 86, 84, None]


def test_missing_description_keeps_the_resume(spark):
    from scoreplane.functions.text import compose_text

    df = spark.createDataFrame([(None, "cv"), ("d", "cv"), ("d", ""), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(compose_text("a", "b")).collect()] == ["cv", "d\n\ncv", "d", None]


def test_building_a_classifier_plan_runs_no_job(spark):
    rs = R.sample_ruleset()
    a = spark.range(100).selectExpr("id", "'that' AS job_title", "'ered' AS job_description").repartition(3)
    joined = a.join(spark.range(50), "id")
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    CL.classify(joined, rs, keep=["id"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_latest_update_of_a_tie_is_fixed(spark):
    t = spark.createDataFrame([("a", "old")], "username string, email string")
    u = spark.createDataFrame([("a", "x", 1), ("a", "z", 1), ("a", "y", 1)], "username string, email string, ts int")
    from scoreplane.operators import accounts as AC

    for order in (["email"], [F.col("email").desc()]):
        assert AC.update_column(t, u.orderBy(*order), "username", "email", "ts").first()["email"] == "z"


def test_failures_at_one_instant_have_a_fixed_last(spark):
    schema = "api_key string, fail_time timestamp, reason string"
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("k", t, "quota")], schema)
    rows = [("k", t, "a"), ("k", t, "c"), ("k", t, "b")]
    from scoreplane.operators import calllog as CG

    for new in (rows, rows[::-1]):
        assert CG.mark_failures(old, spark.createDataFrame(new, schema)).first()["reason"] == "c"
