"""Registered queries: every inventory operator run on the fixture views.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the driver's tables). Column names match between the two.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.oracle import with_views as W
from scoreplane.operators import aggregates as AG
from scoreplane.operators import filters as FL
from scoreplane.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ravg(x: str, n: int = 2) -> str:
    return f"CAST(ROUND(CAST(AVG(CAST({x} AS DOUBLE)) AS DECIMAL(38,15)), {n}) AS DOUBLE)"


def rpct(n: str, total: str) -> str:
    return f"CAST(ROUND(CAST(CAST({n} AS DOUBLE) * 100.0 / ({total}) AS DECIMAL(38,15)), 2) AS DOUBLE)"


AS_OF = FX.AS_OF_DATE
ALL_CAND = ("id, resume_name, candidate_name, ats_score, edu_score, exp_score, skills_score, "
            "lang_score, keyword_score, format_score, bias_score, domain, timestamp")

# ---------------------------------------------------------------- aggregates
register("d1_avg_score_by_domain", W(f"""
SELECT domain, {ravg('ats_score')} AS avg_ats_score, COUNT(*) AS candidate_count
FROM candidates GROUP BY domain HAVING COUNT(*) >= 1""", "candidates"))(
    lambda s, d: AG.average_by_group(FX.candidates(s, d)))

register("d2_top_domains", W(f"""
SELECT domain, {ravg('ats_score')} AS avg_score, COUNT(*) AS count
FROM candidates GROUP BY domain ORDER BY avg_score DESC, domain LIMIT 5""", "candidates"))(
    lambda s, d: AG.top_groups(FX.candidates(s, d), 5))

register("d3_domain_distribution", W(f"""
SELECT domain, COUNT(*) AS count, {rpct('COUNT(*)', 'SELECT COUNT(*) FROM candidates')} AS percentage
FROM candidates GROUP BY domain""", "candidates"))(
    lambda s, d: AG.group_distribution(FX.candidates(s, d)))

register("d4_count_by_day", W("""
SELECT CAST(timestamp AS DATE) AS day, COUNT(*) AS count
FROM candidates GROUP BY 1 ORDER BY day DESC LIMIT 365""", "candidates"))(
    lambda s, d: AG.count_by_day(FX.candidates(s, d)))

register("d5_bias_distribution", W(f"""
SELECT CASE WHEN CAST(bias_score AS DOUBLE) >= CAST(0.6 AS DOUBLE) THEN 'Biased' ELSE 'Fair' END AS bias_category,
       COUNT(*) AS count, {rpct('COUNT(*)', 'SELECT COUNT(*) FROM candidates')} AS percentage
FROM candidates GROUP BY 1""", "candidates"))(
    lambda s, d: AG.threshold_split(FX.candidates(s, d), 0.6))

register("d6_daily_stats", W(f"""
SELECT CAST(timestamp AS DATE) AS date, {ravg('ats_score')} AS avg_ats, COUNT(*) AS daily_count
FROM candidates WHERE CAST(timestamp AS DATE) >= DATE '{AS_OF}' - 90
GROUP BY 1""", "candidates"))(
    lambda s, d: AG.recent_daily_stats(FX.candidates(s, d), AS_OF, 90))

_prof = ", ".join(f"{ravg(c)} AS avg_{c}" for c in
                  ["ats_score", "edu_score", "exp_score", "skills_score", "lang_score",
                   "keyword_score", "format_score"])
register("d7_domain_profile", W(f"""
SELECT domain, COUNT(*) AS total_candidates, {_prof}, {ravg('bias_score', 3)} AS avg_bias_score,
       MAX(ats_score) AS max_ats_score, MIN(ats_score) AS min_ats_score,
       CAST(MAX(ats_score) - MIN(ats_score) AS DOUBLE) AS score_range
FROM candidates GROUP BY domain HAVING COUNT(*) >= 1""", "candidates"))(
    lambda s, d: AG.group_profile(FX.candidates(s, d)))

register("d8_domain_frequency", W(f"""
SELECT domain, COUNT(*) AS frequency, {ravg('ats_score')} AS avg_performance,
       {ravg('bias_score', 3)} AS avg_bias,
       {rpct('COUNT(*)', 'SELECT COUNT(*) FROM candidates')} AS percentage
FROM candidates GROUP BY domain HAVING COUNT(*) >= 1""", "candidates"))(
    lambda s, d: AG.group_frequency(FX.candidates(s, d)))

register("d9_table_summary", W(f"""
SELECT COUNT(*) AS total_candidates,
       COALESCE(NULLIF({ravg('ats_score')}, 0), 0.0) AS avg_ats_score,
       COALESCE(NULLIF({ravg('bias_score', 3)}, 0), 0.0) AS avg_bias_score,
       COUNT(DISTINCT domain) AS unique_domains,
       MIN(CAST(timestamp AS DATE)) AS earliest_date, MAX(CAST(timestamp AS DATE)) AS latest_date
FROM candidates""", "candidates"))(
    lambda s, d: AG.table_summary(FX.candidates(s, d)))

register("d10_total_accounts", W("SELECT COUNT(*) AS cnt FROM accounts", "accounts"))(
    lambda s, d: AG.row_count(FX.accounts(s, d)))

register("d11_logins_on_day", W("""
SELECT COUNT(*) AS cnt FROM user_logs
WHERE action = 'login' AND CAST(strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS DATE) = DATE '2024-01-15'""",
                                 "user_logs"))(
    lambda s, d: AG.row_count(FL.logins_on(FX.user_logs(s, d), "2024-01-15")))

register("d14_having_min_count", W(f"""
SELECT domain, {ravg('ats_score')} AS avg_ats_score, COUNT(*) AS candidate_count
FROM candidates GROUP BY domain HAVING COUNT(*) >= 300""", "candidates"))(
    lambda s, d: AG.average_by_group(FX.candidates(s, d), min_count=300))

# ---------------------------------------------------------------- profiles kept up under changes
from scoreplane.operators import maintained as MT  # noqa: E402
from scoreplane.operators import tables as _TB  # noqa: E402


def _maintained(s, d):
    """State of the rows before 2024-07, then the later rows come in, then a year's retention run deletes."""
    rows = FX.candidates(s, d)
    early = F.col("timestamp") < F.lit("2024-07-01").cast("timestamp_ntz")
    state = MT.kept(MT.state_of(MT.signed(rows.where(early), None)))
    state = MT.kept(MT.apply(state, MT.signed(rows.where(~early), None)))
    return MT.apply(state, MT.signed(None, _TB.expired_rows(rows, AS_OF, 365)))


_LIVE = f"(SELECT * FROM candidates WHERE CAST(timestamp AS DATE) >= DATE '{AS_OF}' - 365)"
register("d7_maintained_profile", ORACLE["d7_domain_profile"].replace("FROM candidates GROUP", f"FROM {_LIVE} GROUP"))(
    lambda s, d: MT.profile(_maintained(s, d)))
register("d8_maintained_frequency", ORACLE["d8_domain_frequency"].replace(
    "FROM candidates)", f"FROM {_LIVE})").replace("FROM candidates GROUP", f"FROM {_LIVE} GROUP"))(
    lambda s, d: MT.frequency(_maintained(s, d)))
register("d9_maintained_summary", ORACLE["d9_table_summary"].replace("latest_date\nFROM candidates", f"latest_date\nFROM {_LIVE}"))(
    lambda s, d: MT.summary(_maintained(s, d)))
register("d6_maintained_days", ORACLE["d6_daily_stats"].replace("FROM candidates WHERE", f"FROM {_LIVE} WHERE"))(
    lambda s, d: MT.recent_days(_maintained(s, d), AS_OF, 90))

# ---------------------------------------------------------------- filters
register("b1_list_candidates_paged", W(f"""
SELECT {ALL_CAND} FROM candidates
WHERE CAST(bias_score AS DOUBLE) >= CAST(0.6 AS DOUBLE) AND ats_score >= 50
ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 20""", "candidates"))(
    lambda s, d: FL.list_candidates(FX.candidates(s, d), 0.6, 50, 100, 20))

register("b1_list_candidates_all", W(f"""
SELECT {ALL_CAND} FROM candidates WHERE ats_score >= 90""", "candidates"))(
    lambda s, d: FL.list_candidates(FX.candidates(s, d), None, 90, None, 20))

register("b2_between_dates", W(f"""
SELECT {ALL_CAND} FROM candidates
WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""", "candidates"))(
    lambda s, d: FL.between_dates(FX.candidates(s, d), "2024-03-01", "2024-06-30"))

register("b3_candidate_by_id", W(f"SELECT {ALL_CAND} FROM candidates WHERE id = 4242", "candidates"))(
    lambda s, d: FL.by_id(FX.candidates(s, d), 4242))

register("b4_flagged", W("""
SELECT resume_name, candidate_name, ats_score, bias_score, domain, timestamp
FROM candidates WHERE CAST(bias_score AS DOUBLE) > CAST(0.6 AS DOUBLE)""", "candidates"))(
    lambda s, d: FL.flagged(FX.candidates(s, d), 0.6))

register("b5_export_filter", W(f"""
SELECT {ALL_CAND} FROM candidates
WHERE ats_score >= 40 AND domain = 'Data Science'
  AND CAST(timestamp AS DATE) >= DATE '2024-02-01' AND CAST(timestamp AS DATE) <= DATE '2024-12-31'""",
                                 "candidates"))(
    lambda s, d: FL.export_filter(FX.candidates(s, d), {
        "min_ats": 40, "domain": "Data Science", "start_date": "2024-02-01", "end_date": "2024-12-31"}))

register("b6_last_days", W(f"""
SELECT {ALL_CAND} FROM candidates WHERE CAST(timestamp AS DATE) >= DATE '{AS_OF}' - 30""", "candidates"))(
    lambda s, d: FL.last_days(FX.candidates(s, d), AS_OF, 30))

register("b7_key_membership", W("""
SELECT call_id, api_key, ts FROM call_log WHERE api_key IN ('key_1', 'key_3', 'key_9')""", "call_log"))(
    lambda s, d: FL.member_of(FX.call_log(s, d), "api_key", ["key_1", "key_3", "key_9"])
    .select("call_id", "api_key", "ts"))

register("b9_logins_on_day", W("""
SELECT id, username, action, timestamp FROM user_logs
WHERE action = 'login' AND CAST(strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS DATE) = DATE '2024-01-15'""",
                               "user_logs"))(
    lambda s, d: FL.logins_on(FX.user_logs(s, d), "2024-01-15"))

register("b10_log_listing", W("SELECT username, action, timestamp FROM user_logs", "user_logs"))(
    lambda s, d: FL.log_listing(FX.user_logs(s, d)))

register("b11_username_for_email", W(
    "SELECT username FROM accounts WHERE email = 'user1234@example.com'", "accounts"))(
    lambda s, d: FL.username_for_email(FX.accounts(s, d), "user1234@example.com"))

register("b11_attribute_batch", W("""
SELECT r.req_id, r.username, NULLIF(a.email, '') AS email
FROM (SELECT req_id, username FROM registrations) r LEFT JOIN accounts a ON r.username = a.username""",
                                  "accounts", "registrations"))(
    lambda s, d: FL.attribute_for_users(FX.accounts(s, d),
                                        FX.registrations(s, d).select("req_id", "username"), "email"))

# the order is random, the set of rows is not
# ---------------------------------------------------------------- text rules
from scoreplane import oracle as O  # noqa: E402
from scoreplane import rules as R  # noqa: E402
from scoreplane.functions.text import compose_text  # noqa: E402
from scoreplane.plans import classify as CL  # noqa: E402

_RS = R.sample_ruleset()
_COMPOSED = O.compose_sql("job_description", "resume_text")


def _postings_classified(s, d):
    p = FX.postings(s, d)
    return CL.classify(p, _RS, "job_title", compose_text("job_description", "resume_text"),
                       keep=["id"])


register("j1_keyword_domain", W("SELECT id, kw_domain FROM kwres", "postings",
                                extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED)))(
    _postings_classified)

# J1 with the keyword table kept as a DataFrame (the form for vocabularies too
# large to inline or collect): same labels, checked against the same SQL.
register("j1_keyword_domain_table", ORACLE["j1_keyword_domain"])(
    lambda s, d: CL.classify_table(FX.postings(s, d), _RS, R.keywords_table(s, _RS), "job_title",
                                   compose_text("job_description", "resume_text"), keep=["id"], key="id"))

register("d12_keyword_hits", W("""
SELECT COALESCE(tc.id, dc.id) AS id, dm.domain, COALESCE(tc.n, 0) AS title_hits, COALESCE(dc.n, 0) AS desc_hits
FROM tc FULL OUTER JOIN dc ON tc.id = dc.id AND tc.rank = dc.rank
JOIN doms dm ON dm.rank = COALESCE(tc.rank, dc.rank)""", "postings",
                               extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED)))(
    lambda s, d: CL.keyword_hits(FX.postings(s, d), _RS, "id", "job_title",
                                 compose_text("job_description", "resume_text")))

# D12 and D13 with the keyword table kept as a DataFrame.
register("d12_keyword_hits_table", ORACLE["d12_keyword_hits"])(
    lambda s, d: CL.keyword_hits(FX.postings(s, d), _RS, "id", "job_title", compose_text("job_description", "resume_text"),
                                 unique_id=True, keywords=R.keywords_table(s, _RS)))

# C6 with a vocabulary that Spark draws from the documents: their first three and
# last two words, as they stand (over 1,000 phrases at sf0.01).
from scoreplane.operators.phrase_join import phrase_hits  # noqa: E402

_OPENING = "^[^a-z]*([a-z]+[^a-z]+[a-z]+[^a-z]+[a-z]+)"
_CLOSING = "([a-z]+[^a-z]+[a-z]+)[^a-z]*$"


def _phrases_in_documents(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    phrase = F.explode(F.array(*[F.regexp_extract("text", p, 1) for p in (_OPENING, _CLOSING)]))
    return phrase_hits(docs, docs.select(phrase.alias("phrase")).where("phrase <> ''"), "doc_id", "text", "phrase")


register("c6_phrase_join", f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
p AS (SELECT regexp_extract(t, '{_OPENING}', 1) AS phrase FROM d UNION SELECT regexp_extract(t, '{_CLOSING}', 1) FROM d)
SELECT doc_id, phrase FROM d, p WHERE phrase <> ''
  AND CASE WHEN contains(t, phrase) THEN regexp_matches(t, '(^|[^a-z])' || regexp_escape(phrase) || '([^a-z]|$)') ELSE false END
""")(_phrases_in_documents)

# ---------------------------------------------------------------- similarity and labels
from scoreplane.operators import labels as LB  # noqa: E402
from scoreplane.operators import similarity as SM  # noqa: E402

register("j3_domain_similarity", W("SELECT id, similarity FROM sim", "label_pairs",
                                   extra=O.similarity_ctes("label_pairs", "resume_domain", "job_domain")))(
    lambda s, d: SM.similarity(FX.label_pairs(s, d), "resume_domain", "job_domain").select("id", "similarity"))

register("b8_valid_model_labels", W(f"""
SELECT id, label FROM model_labels WHERE {O.strip_sql('label')} IN ({', '.join(O.q(x) for x in FV.DOMAIN_LABELS)})""",
                                    "model_labels"))(
    lambda s, d: LB.valid_labels(FX.model_labels(s, d)))

_J2_SQL = W("""
SELECT k.id, CASE WHEN l.llm_domain IS NULL THEN k.kw_domain ELSE l.llm_domain END AS domain,
       CASE WHEN l.llm_domain IS NULL THEN 'low'
            WHEN lower(l.llm_domain) = lower(k.kw_domain) THEN 'high'
            WHEN k.kw_domain = 'Unclassified' THEN 'high' ELSE 'medium' END AS confidence,
       l.llm_domain, k.kw_domain,
       COALESCE(l.llm_domain IS NOT NULL AND lower(l.llm_domain) = lower(k.kw_domain), false) AS agreed
FROM kwres k LEFT JOIN lbl l ON l.id = k.id""", "postings", "model_labels",
            extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED) + "," + O.labels_cte())


def _j2(s, d):
    k = _postings_classified(s, d)
    return LB.reconcile(LB.attach_labels(k, FX.model_labels(s, d))).select(
        "id", "domain", "confidence", "llm_domain", "kw_domain", "agreed")


register("j2_domain_with_confidence", _J2_SQL)(_j2)

register("j2b_label_or_keyword", W("""
SELECT k.id, COALESCE(l.llm_domain, k.kw_domain) AS domain FROM kwres k LEFT JOIN lbl l ON l.id = k.id""",
                                   "postings", "model_labels",
                                   extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED)
                                   + "," + O.labels_cte()))(
    lambda s, d: LB.label_or_keyword(LB.attach_labels(_postings_classified(s, d), FX.model_labels(s, d)))
    .select("id", "domain"))

# ---------------------------------------------------------------- call log
from scoreplane.operators import calllog as CG  # noqa: E402

SPLIT_TS = "2024-01-15 00:00:00"
PURGE_AS_OF = "2024-01-30 00:00:00"
PROBE_AS_OF = "2024-01-29 12:00:00"
HEALTH_AS_OF = "2024-01-30 20:00:00"
HEALTH_LIMIT = 25


def _calls(s, d):
    return FX.call_log(s, d)


def _before(df, ts):
    return df.where(F.col("ts") < F.lit(ts).cast("timestamp_ntz"))


def _from(df, ts):
    return df.where(F.col("ts") >= F.lit(ts).cast("timestamp_ntz"))


register("h6_prompt_hash", W(f"SELECT call_id, {O.hash_sql()} AS prompt_hash FROM call_log", "call_log"))(
    lambda s, d: CG.with_hash(_calls(s, d)).select("call_id", "prompt_hash"))

register("h15_failure_reason", W(f"""
SELECT call_id, {O.reason_sql('error')} AS reason FROM call_log WHERE error IS NOT NULL""", "call_log"))(
    lambda s, d: _calls(s, d).where(F.col("error").isNotNull())
    .select("call_id", CG.failure_reason("error").alias("reason")))

register("i5_cache_state", W("SELECT * FROM cache", "call_log", extra=O.cache_cte("cache", "call_log")))(
    lambda s, d: CG.cache_state(_calls(s, d)))

register("i5_cache_upsert", W("SELECT * FROM cache", "call_log", extra=O.cache_cte("cache", "call_log")))(
    lambda s, d: CG.upsert_latest(CG.cache_state(_before(_calls(s, d), SPLIT_TS)),
                                  CG.cache_state(_from(_calls(s, d), SPLIT_TS)),
                                  "prompt_hash", "timestamp", ["response", "timestamp"]))

register("d16_key_usage", W("SELECT * FROM usage", "call_log", extra=O.usage_cte("usage", "call_log")))(
    lambda s, d: CG.usage_state(_calls(s, d)))

register("i6_usage_merge", W("SELECT * FROM usage", "call_log", extra=O.usage_cte("usage", "call_log")))(
    lambda s, d: CG.merge_usage(CG.usage_state(_before(_calls(s, d), SPLIT_TS)),
                                _from(_calls(s, d), SPLIT_TS)))

register("j7_failure_state", W("SELECT * FROM failures", "call_log",
                               extra=O.failures_cte("failures", "call_log")))(
    lambda s, d: CG.failure_state(_calls(s, d)))

register("i7_failure_upsert", W(f"""
SELECT api_key, fail_time, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY fail_time DESC, src DESC) AS rn FROM (
    SELECT api_key, fail_time, reason, 0 AS src FROM old_f
    UNION ALL
    SELECT api_key, ts AS fail_time, {O.reason_sql('error')} AS reason, 1 AS src
    FROM call_log WHERE error IS NOT NULL AND ts >= TIMESTAMP '{SPLIT_TS}')) WHERE rn = 1""",
                                "call_log",
                                extra="\nold_calls AS (SELECT * FROM call_log WHERE ts < TIMESTAMP '"
                                + SPLIT_TS + "')," + O.failures_cte("old_f", "old_calls")))(
    lambda s, d: CG.mark_failures(
        CG.failure_state(_before(_calls(s, d), SPLIT_TS)),
        CG.failure_events(_from(_calls(s, d), SPLIT_TS)).where("failed")
        .select("api_key", F.col("ts").alias("fail_time"), "reason")))

register("i4_clear_failures", W("""
SELECT * FROM failures WHERE api_key NOT IN ('key_1', 'key_2')""", "call_log",
                                extra=O.failures_cte("failures", "call_log")))(
    lambda s, d: CG.clear_failures(CG.failure_state(_calls(s, d)),
                                   s.createDataFrame([("key_1",), ("key_2",)], "api_key string")))

register("i3_purge_cache", W(f"""
SELECT * FROM cache WHERE timestamp >= TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 24 HOUR""", "call_log",
                             extra=O.cache_cte("cache", "call_log")))(
    lambda s, d: CG.purge_cache(CG.cache_state(_calls(s, d)), PURGE_AS_OF))

register("i3_purge_failures", W(f"""
SELECT * FROM failures WHERE fail_time >= TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 3 DAY""", "call_log",
                                extra=O.failures_cte("failures", "call_log")))(
    lambda s, d: CG.purge_failures(CG.failure_state(_calls(s, d)), PURGE_AS_OF))

register("c2_cache_probe", W(f"""
SELECT r.call_id, r.model, r.prompt, {O.hash_sql('r.model', 'r.prompt')} AS prompt_hash,
       c.response AS cached_response, c.response IS NOT NULL AS hit
FROM (SELECT call_id, model, prompt FROM call_log WHERE ts >= TIMESTAMP '{PROBE_AS_OF}') r
LEFT JOIN (SELECT * FROM cache WHERE timestamp >= TIMESTAMP '{PROBE_AS_OF}' - INTERVAL 24 HOUR
           AND response <> '') c
  ON c.prompt_hash = {O.hash_sql('r.model', 'r.prompt')}""", "call_log",
                             extra="\nold_calls AS (SELECT * FROM call_log WHERE ts < TIMESTAMP '"
                             + PROBE_AS_OF + "')," + O.cache_cte("cache", "old_calls")))(
    lambda s, d: CG.probe_cache(_from(_calls(s, d), PROBE_AS_OF).select("call_id", "model", "prompt"),
                                CG.cache_state(_before(_calls(s, d), PROBE_AS_OF)), PROBE_AS_OF))

_HEALTH_SQL = f"""
SELECT k.api_key,
       CASE WHEN f.fail_time IS NOT NULL AND TIMESTAMP '{HEALTH_AS_OF}' < f.fail_time +
                 CASE WHEN f.reason = 'quota' THEN INTERVAL {FV.QUOTA_COOLDOWN_MINUTES} MINUTE
                      ELSE INTERVAL {FV.ERROR_COOLDOWN_MINUTES} MINUTE END THEN 'cooling'
            WHEN COALESCE(CASE WHEN u.last_reset = DATE '{HEALTH_AS_OF[:10]}' THEN u.usage_count END, 0)
                 >= {HEALTH_LIMIT} THEN 'over_quota'
            ELSE 'healthy' END AS status,
       CAST(COALESCE(CASE WHEN u.last_reset = DATE '{HEALTH_AS_OF[:10]}' THEN u.usage_count END, 0) AS BIGINT)
         AS usage_today
FROM (SELECT DISTINCT api_key FROM call_log) k
LEFT JOIN failures f ON f.api_key = k.api_key LEFT JOIN usage u ON u.api_key = k.api_key"""
_HEALTH_CTES = ("\nupto AS (SELECT * FROM call_log WHERE ts <= TIMESTAMP '" + HEALTH_AS_OF + "'),"
                + O.failures_cte("failures", "upto") + "," + O.usage_cte("usage", "upto"))


def _health(s, d):
    c = _calls(s, d)
    upto = c.where(F.col("ts") <= F.lit(HEALTH_AS_OF).cast("timestamp_ntz"))
    return CG.key_health(c.select("api_key"), CG.failure_state(upto), CG.usage_state(upto),
                         HEALTH_AS_OF, HEALTH_LIMIT)


register("j6_key_health", W(_HEALTH_SQL, "call_log", extra=_HEALTH_CTES))(_health)
register("j6_healthy_keys", W(f"SELECT api_key FROM ({_HEALTH_SQL}) WHERE status = 'healthy'", "call_log",
                              extra=_HEALTH_CTES))(lambda s, d: CG.healthy_keys(_health(s, d)))
register("j6_quota_failures", W(f"""
SELECT api_key, TIMESTAMP '{HEALTH_AS_OF}' AS fail_time, 'quota' AS reason
FROM ({_HEALTH_SQL}) WHERE status = 'over_quota'""", "call_log", extra=_HEALTH_CTES))(
    lambda s, d: CG.quota_failures(_health(s, d), HEALTH_AS_OF))

# ---------------------------------------------------------------- accounts and audit
from scoreplane.operators import accounts as AC  # noqa: E402

CODE_TTL = 21600  # widened from 180 s: fixture events are minutes apart

register("c3_existing_conflicts", W("""
SELECT r.req_id, r.username, r.email, r.ts,
       CASE WHEN r.email IS NOT NULL AND r.email IN (SELECT email FROM accounts WHERE email IS NOT NULL) THEN 'email'
            WHEN r.username IN (SELECT username FROM accounts) THEN 'username' END AS conflict
FROM registrations r""", "accounts", "registrations"))(
    lambda s, d: AC.existing_conflicts(FX.registrations(s, d), FX.accounts(s, d)))

# Oracle for I9: in the registration fixture a username and an e-mail always
# belong to the same requester, so "later repeat of a key" equals the
# sequential insert outcome; the general rule (chains across keys) is
# checked against a sequential brute force in tests/test_bruteforce.py.
_I9_SQL = """
SELECT r.req_id, r.username, r.email, r.ts,
       CASE WHEN r.username IN (SELECT username FROM accounts) OR fu.rn > 1 THEN 'username'
            WHEN (r.email IS NOT NULL AND r.email IN (SELECT email FROM accounts WHERE email IS NOT NULL))
                 OR fe.rn > 1 THEN 'email' END AS rejected_for
FROM registrations r
JOIN (SELECT req_id, row_number() OVER (PARTITION BY username ORDER BY ts, req_id) AS rn FROM registrations) fu
  ON fu.req_id = r.req_id
LEFT JOIN (SELECT req_id, row_number() OVER (PARTITION BY email ORDER BY ts, req_id) AS rn
           FROM registrations WHERE email IS NOT NULL) fe ON fe.req_id = r.req_id"""

register("i9_register_batch", W(f"SELECT *, rejected_for IS NULL AS accepted FROM ({_I9_SQL})",
                                "accounts", "registrations"))(
    lambda s, d: AC.register_batch(FX.registrations(s, d), FX.accounts(s, d)))

register("i9_new_accounts", W(f"""
SELECT CAST((SELECT max(id) FROM accounts) + row_number() OVER (ORDER BY ts, req_id) AS BIGINT) AS id,
       username, email
FROM ({_I9_SQL}) WHERE rejected_for IS NULL""", "accounts", "registrations"))(
    lambda s, d: AC.new_accounts(AC.register_batch(FX.registrations(s, d), FX.accounts(s, d)),
                                 FX.accounts(s, d)))

register("c8_resolve_identity", W("""
SELECT l.req_id, l.identifier, a.username AS matched_username
FROM login_attempts l LEFT JOIN accounts a
  ON (CASE WHEN contains(l.identifier, '@') THEN a.email ELSE a.username END) = l.identifier""",
                                  "accounts", "login_attempts"))(
    lambda s, d: AC.resolve_identity(FX.login_attempts(s, d), FX.accounts(s, d)))

register("c10_code_match", W(f"""
SELECT m.event_id, m.user_id, m.ts, m.code, m.issue_ts,
       CASE WHEN u.uts IS NOT NULL AND (m.ts > u.uts OR (m.ts = u.uts AND m.event_id > u.ueid))
            THEN 'no_pending' ELSE m.raw END AS outcome
FROM m LEFT JOIN (
  SELECT user_id, issue_ts, ts AS uts, event_id AS ueid FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, issue_ts ORDER BY ts, event_id) AS rn
    FROM m WHERE raw IN ('ok', 'expired')) WHERE rn = 1) u
  ON u.user_id = m.user_id AND u.issue_ts = m.issue_ts""", "code_events", extra=f"""
m0 AS (SELECT a.event_id, a.user_id, a.ts, a.code, i.ts AS issue_ts, i.code AS issue_code
       FROM (SELECT * FROM code_events WHERE kind = 'attempt') a
       ASOF LEFT JOIN (SELECT * FROM code_events WHERE kind = 'issue') i
       ON a.user_id = i.user_id AND a.ts >= i.ts),
m AS (SELECT *, CASE WHEN issue_ts IS NULL THEN 'no_pending'
                     WHEN (epoch_us(ts) - epoch_us(issue_ts)) / 1e6 > {CODE_TTL} THEN 'expired'
                     WHEN code <> issue_code THEN 'invalid' ELSE 'ok' END AS raw FROM m0)"""))(
    lambda s, d: AC.match_codes(FX.code_events(s, d), CODE_TTL))

register("i8_update_email", W("""
SELECT a.id, a.username, CASE WHEN u.username IS NOT NULL THEN u.new_email ELSE a.email END AS email,
       (u.username IS NOT NULL AND a.email IS DISTINCT FROM u.new_email) AS changed
FROM accounts a LEFT JOIN (SELECT username, arg_max(email, ts) AS new_email FROM registrations GROUP BY username) u
  ON u.username = a.username""", "accounts", "registrations"))(
    lambda s, d: AC.update_column(FX.accounts(s, d), FX.registrations(s, d).select("username", "email", "ts"),
                                  "username", "email", ts="ts"))

register("h13_email_valid", W(f"""
SELECT id, username, email, COALESCE(regexp_matches(email, {O.q(FV.EMAIL_PATTERN)}), false) AS email_valid
FROM accounts""", "accounts"))(lambda s, d: AC.email_check(FX.accounts(s, d)))

# ---------------------------------------------------------------- catalogue
from scoreplane.operators import catalog as CT  # noqa: E402

_LINK = FX.LINK_PATTERN
_FLAT_SQL = f"""
SELECT page_id AS catalog_id, unnest(regexp_extract_all(html, {O.q(_LINK)}, 2)) AS name,
       unnest(regexp_extract_all(html, {O.q(_LINK)}, 1)) AS link,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS category,
       regexp_extract(url, '^https?://([^/?#]+)', 1) AS role
FROM pages"""
ROLE_HOST = "blog.tionsh.example.net"

register("h21_flatten_catalog", _FLAT_SQL)(lambda s, d: CT.flatten(FX.catalog(s, d)))


def _a8(s, d):
    """Every page's catalogue as a JSON line, beside it a cut line, one without catalogue and ones with an empty level."""
    from scoreplane.session import scratch_path
    from scoreplane.sources import catalog as CS

    path = CS.write_catalog_json(FX.catalog(s, d), scratch_path(s, "catalog-json"))
    lines = s.read.text(path)
    odd = F.array(F.expr("substr(value, 1, length(value) div 2)"), F.lit('{"other": 1}'), F.lit('{"catalog": {"xx": null}}'),
                  F.lit('{"catalog": {"xx": {"yy": null, "zz": []}}}'), F.lit("no json"))
    lines.select(F.explode(odd).alias("value")).write.mode("append").text(path)
    return CT.flatten(CS.read_catalog_json(s, path)).select("name", "link", "category", "role")


register("a8_catalog_json", f"SELECT name, link, category, role FROM ({_FLAT_SQL})")(_a8)
register("c7_courses_for_role", f"""
SELECT catalog_id, name, link FROM ({_FLAT_SQL}) WHERE category = 'en' AND role = '{ROLE_HOST}'""")(
    lambda s, d: CT.courses_for_role(FX.catalog(s, d), "en", ROLE_HOST))
register("c7_courses_missing_role", f"""
SELECT catalog_id, name, link FROM ({_FLAT_SQL}) WHERE category = 'xx' AND role = 'nowhere'""")(
    lambda s, d: CT.courses_for_role(FX.catalog(s, d), "xx", "nowhere"))
register("j5_courses_for_requests", f"""
SELECT r.req_id, f.category, f.role, f.catalog_id, f.name, f.link
FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' ||
             regexp_extract(html, '<html lang="([a-z]+)"', 1) AS req_id,
             regexp_extract(html, '<html lang="([a-z]+)"', 1) AS category,
             regexp_extract(url, '^https?://([^/?#]+)', 1) AS role FROM pages) r
JOIN ({_FLAT_SQL}) f ON f.category = r.category AND f.role = r.role""")(
    lambda s, d: CT.courses_for_requests(
        ST.read_table(s, d, "pages").select(
            F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("category"),
            F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("role")).distinct()
        .withColumn("req_id", F.concat_ws("/", "role", "category")),
        CT.flatten(FX.catalog(s, d))))

# ---------------------------------------------------------------- ingest and table changes
import datetime as _dt  # noqa: E402
from zoneinfo import ZoneInfo  # noqa: E402

from scoreplane.operators import tables as TB  # noqa: E402
from scoreplane.plans import ingest as IG  # noqa: E402
from scoreplane.sources import tables as ST  # noqa: E402
from scoreplane.sources.schemas import CANDIDATES  # noqa: E402

INGEST_AS_OF = "2025-02-20 06:30:00"
_LOCAL = (_dt.datetime.fromisoformat(INGEST_AS_OF).replace(tzinfo=_dt.timezone.utc)
          .astimezone(ZoneInfo(FV.LOCAL_ZONE)).strftime("%Y-%m-%d %H:%M:%S"))


def _ingest(s, d):
    return IG.ingest(FX.submissions(s, d), FX.candidates(s, d), FX.model_labels(s, d), _RS, INGEST_AS_OF)


def _ok(x):
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND {x} >= 0 AND {x} <= 100)"


_ERRS = ", ".join(
    [f"CASE WHEN NOT {_ok(c)} THEN '{c}' END" for c in IG.INT_SCORES]
    + ["CASE WHEN isnan(COALESCE(format_score, 0.0)) OR NOT "
       + _ok("trunc(COALESCE(format_score, 0.0))") + " THEN 'format_score' END",
       "CASE WHEN NOT (bias_score IS NOT NULL AND NOT isnan(bias_score) AND bias_score >= 0 AND bias_score <= 1)"
       " THEN 'bias_score' END"])
_SUB_COMPOSED = O.compose_sql("job_description", "resume_text")
_INGEST_CTES = (O.classify_ctes(_RS, "submissions", "sub_id", "job_title", _SUB_COMPOSED) + "," + O.labels_cte()
                + f""",
j AS (SELECT s.*, CASE WHEN l.llm_domain IS NULL THEN k.kw_domain ELSE l.llm_domain END AS domain,
             CASE WHEN l.llm_domain IS NULL THEN 'low' WHEN lower(l.llm_domain) = lower(k.kw_domain) THEN 'high'
                  WHEN k.kw_domain = 'Unclassified' THEN 'high' ELSE 'medium' END AS confidence,
             list_filter([{_ERRS}], lambda x: x IS NOT NULL) AS errors
      FROM submissions s JOIN kwres k ON k.id = s.sub_id LEFT JOIN lbl l ON l.id = s.sub_id)""")

register("j4_ingest_accepted", W(f"""
SELECT CAST((SELECT max(id) FROM candidates) + row_number() OVER (ORDER BY sub_id) AS BIGINT) AS id,
       resume_name, candidate_name,
       {', '.join(f'CAST(ROUND(CAST({c} AS DECIMAL(18,6))) AS INTEGER) AS {c}' for c in IG.INT_SCORES)},
       CAST(trunc(COALESCE(format_score, 0.0)) AS INTEGER) AS format_score,
       CAST(bias_score AS FLOAT) AS bias_score, domain, confidence,
       TIMESTAMP '{_LOCAL}' AS timestamp
FROM j WHERE len(errors) = 0""", "candidates", "submissions", "postings", "model_labels", extra=_INGEST_CTES))(
    lambda s, d: _ingest(s, d).accepted)

register("h19_ingest_rejected", W("""
SELECT sub_id, array_to_string(errors, ',') AS errors FROM j WHERE len(errors) > 0""",
                                  "submissions", "model_labels", extra=_INGEST_CTES))(
    lambda s, d: IG.rejected(FX.submissions(s, d)).select("sub_id", F.array_join("errors", ",").alias("errors")))



def _ingest_stream(s, d):
    """All accepted rows of the stream; ids are compared as a range, as files come in any order."""
    from scoreplane.streaming import streams as SS

    base = SS.ingest_stream(FX.submissions_from(SS.file_stream(s, d, "documents", max_files=64)), FX.candidates(s, d),
                            FX.model_labels(s, d), _RS, INGEST_AS_OF)
    rows = SS.read_ingested(s, base).drop("batch")
    ids = rows.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"))
    return rows.drop("id").crossJoin(F.broadcast(ids))  # one row


register("j4_ingest_stream", W(f"""
SELECT resume_name, candidate_name,
       {', '.join(f'CAST(ROUND(CAST({c} AS DECIMAL(18,6))) AS INTEGER) AS {c}' for c in IG.INT_SCORES)},
       CAST(trunc(COALESCE(format_score, 0.0)) AS INTEGER) AS format_score,
       CAST(bias_score AS FLOAT) AS bias_score, domain, confidence, TIMESTAMP '{_LOCAL}' AS timestamp,
       CAST((SELECT max(id) FROM candidates) + 1 AS BIGINT) AS first_id,
       CAST((SELECT max(id) FROM candidates) + COUNT(*) OVER () AS BIGINT) AS last_id, COUNT(*) OVER () AS ids
FROM j WHERE len(errors) = 0""", "candidates", "submissions", "postings", "model_labels", extra=_INGEST_CTES))(_ingest_stream)

register("i1_delete_ids", W(f"""
SELECT {ALL_CAND} FROM candidates WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
                            "candidates"))(
    lambda s, d: TB.delete_ids(FX.candidates(s, d),
                               ST.read_table(s, d, "events").where(F.col("event_type") == "error")
                               .select(F.col("event_id").alias("id"))))

register("i2_retention_keep", W(f"""
SELECT {ALL_CAND} FROM candidates WHERE CAST(timestamp AS DATE) >= DATE '{AS_OF}' - 365""", "candidates"))(
    lambda s, d: TB.retain_recent(FX.candidates(s, d), AS_OF, 365))

register("i2_retention_deleted_count", W(f"""
SELECT COUNT(*) AS deleted FROM candidates WHERE CAST(timestamp AS DATE) < DATE '{AS_OF}' - 365""", "candidates"))(
    lambda s, d: TB.expired_rows(FX.candidates(s, d), AS_OF, 365).agg(F.count(F.lit(1)).alias("deleted")))

register("a2_parameterised_sql", W("""
SELECT domain, COUNT(*) AS n FROM candidates WHERE ats_score >= 50 AND domain <> 'Unclassified' GROUP BY domain""",
                                   "candidates"))(
    lambda s, d: ST.run_sql(s, "SELECT domain, COUNT(*) AS n FROM {c} WHERE ats_score >= :m "
                               "AND domain <> :x GROUP BY domain",
                            args={"m": 50, "x": "Unclassified"}, c=FX.candidates(s, d)))

register("a4_add_missing_column", W(f"SELECT {ALL_CAND.replace('format_score', '0 AS format_score')} FROM candidates",
                                    "candidates"))(
    lambda s, d: ST.conform(FX.candidates(s, d).drop("format_score"), CANDIDATES, {"format_score": 0}))

# ---------------------------------------------------------------- places in listings
from scoreplane.operators import listings as LS  # noqa: E402

register("f2_deep_page", W(f"""
SELECT * FROM (SELECT {ALL_CAND}, row_number() OVER (ORDER BY timestamp DESC, id) AS rank FROM candidates)
WHERE rank > 7000 AND rank <= 7100""", "candidates"))(
    lambda s, d: LS.deep_page(FX.candidates(s, d), [(F.col("timestamp"), "desc")], "id", 100, 7000))

# the place at which each listing shows a row, so that its order is compared too
for _name, _of, _order in (
        ("d1_avg_score_by_domain", lambda s, d: AG.average_by_group(FX.candidates(s, d)), "avg_ats_score DESC, domain"),
        ("d3_domain_distribution", lambda s, d: AG.group_distribution(FX.candidates(s, d)), "count DESC, domain"),
        ("d6_daily_stats", lambda s, d: AG.recent_daily_stats(FX.candidates(s, d), AS_OF, 90), "date"),
        ("d8_domain_frequency", lambda s, d: AG.group_frequency(FX.candidates(s, d)), "frequency DESC, domain")):
    register("f4_order_of_" + _name, f"SELECT *, row_number() OVER (ORDER BY {_order}) AS place FROM ({ORACLE[_name]})")(
        lambda s, d, of=_of: LS.with_place(of(s, d)))

# equal rows of the log cannot be told apart, so it does not matter which of them comes first
register("f5_order_of_log", W("""
SELECT username, action, timestamp, row_number() OVER (ORDER BY timestamp DESC, username DESC, action DESC) AS place
FROM user_logs""", "user_logs"))(lambda s, d: LS.with_place(FL.log_listing(FX.user_logs(s, d))))

# ---------------------------------------------------------------- streaming forms
from scoreplane.operators import replay as RP  # noqa: E402
from scoreplane.streaming import streams as SS  # noqa: E402


def _s1(s, d):
    return SS.run_updates(SS.daily_usage(FX.call_log_from(SS.file_stream(s, d, "events"))), "s1",
                          ["window_start", "window_end", "api_key"], "calls")


register("s1_daily_usage_stream", W("""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, api_key, COUNT(*) AS calls
FROM call_log WHERE error IS NULL GROUP BY 1, 2, 3""", "call_log"))(_s1)

def _misses_sql(prompt: str = "prompt") -> str:
    """The calls reached from each prompt's first: the next one after an unanswered miss, else the first beyond the lifetime."""
    log = f"(SELECT * REPLACE ({prompt} AS prompt) FROM call_log)"
    return W("SELECT call_id, prompt_hash, ts FROM miss", "call_log", extra=f"""
h AS (SELECT call_id, ts, error IS NULL AND coalesce(response, '') <> '' AS ok, {O.hash_sql()} AS prompt_hash FROM {log}),
n AS (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY ts, call_id) AS k FROM h),
step AS (SELECT n.*, CASE WHEN ok THEN 1 + (SELECT count(*) FROM n b WHERE b.prompt_hash = n.prompt_hash
                                           AND b.ts <= n.ts + INTERVAL {FV.CACHE_TTL_HOURS} HOUR) ELSE k + 1 END AS nxt FROM n),
miss AS (SELECT * FROM step WHERE k = 1
         UNION ALL
         SELECT s.* FROM miss m JOIN step s ON s.prompt_hash = m.prompt_hash AND s.k = m.nxt)""").replace(
        "WITH ", "WITH RECURSIVE ", 1)


register("s2_cache_misses_stream", _misses_sql())(
    lambda s, d: SS.run_to_table(SS.cache_misses(FX.call_log_from(SS.file_stream(s, d, "events"))), "s2"))

# batch form, by pointer doubling; with one prompt for each key the calls come well inside the lifetime
register("s2_cache_misses", _misses_sql())(lambda s, d: RP.cache_misses(FX.call_log(s, d)))
register("s2_cache_misses_hot_prompts", _misses_sql("api_key"))(
    lambda s, d: RP.cache_misses(FX.call_log(s, d).withColumn("prompt", F.col("api_key"))))

register("j6_health_at_calls", W(f"""
SELECT c.call_id, c.api_key, c.ts, CASE
    WHEN e.failed AND c.ts < e.ts + INTERVAL 1 MINUTE * (CASE WHEN e.reason = '{FV.REASON_QUOTA}' THEN {FV.QUOTA_COOLDOWN_MINUTES}
                                                              ELSE {FV.ERROR_COOLDOWN_MINUTES} END) THEN 'cooling'
    WHEN c.used >= 20 THEN 'over_quota' ELSE 'healthy' END AS status
FROM u c LEFT JOIN e ON e.api_key = c.api_key AND e.call_id = c.e_call""", "call_log", extra=f"""
e AS (SELECT api_key, ts, call_id, error IS NOT NULL AS failed,
             CASE WHEN regexp_matches(lower(error), 'quota|rate limit|429') THEN '{FV.REASON_QUOTA}' ELSE 'error' END AS reason
      FROM call_log WHERE error IS NOT NULL OR NOT own_key),
u AS (SELECT *, count(CASE WHEN error IS NULL THEN 1 END) OVER (PARTITION BY api_key, CAST(ts AS DATE) ORDER BY ts, call_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used,
             last_value(CASE WHEN error IS NOT NULL OR NOT own_key THEN call_id END IGNORE NULLS)
               OVER (PARTITION BY api_key ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e_call
      FROM call_log)"""))(lambda s, d: RP.health_at_calls(FX.call_log(s, d), daily_limit=20))


def _s3(s, d):
    base = SS.failure_state_stream(FX.call_log_from(SS.file_stream(s, d, "events")), "s3")
    return SS.read_failure_state(s, base)


def _s2x(s, d):
    base = SS.cache_state_stream(FX.call_log_from(SS.file_stream(s, d, "events", max_files=1)), "s2x")
    return SS.read_cache_state(s, base)


register("s2_cache_state_stream", W("SELECT * FROM cache", "call_log", extra=O.cache_cte("cache", "call_log")))(_s2x)

register("s3_failure_state_stream", W("SELECT * FROM failures", "call_log",
                                      extra=O.failures_cte("failures", "call_log")))(_s3)

register("s4_logins_per_day_stream", W("""
SELECT CAST(strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS DATE) AS day, COUNT(*) AS logins
FROM user_logs WHERE action = 'login' GROUP BY 1""", "user_logs"))(
    lambda s, d: SS.run_updates(SS.logins_per_local_day(FX.user_logs_from(SS.file_stream(s, d, "events"))), "s4",
                                ["day"], "logins"))


# the rows of c10 that the last watermark (ten minutes behind the newest event) has passed
register("s5_attempt_outcomes_stream", f"""
SELECT * FROM ({ORACLE["c10_code_match"]})
WHERE ts < (SELECT max(ts) FROM events WHERE event_type IN ('signup', 'click')) - INTERVAL 10 MINUTE""")(
    lambda s, d: SS.run_to_table(SS.attempt_outcomes(FX.code_events_from(SS.file_stream(s, d, "events")), CODE_TTL), "s5-outcomes"))


def _s5(s, d):
    ce = FX.code_events_from(SS.file_stream(s, d, "events"))
    return SS.run_to_table(SS.code_interval_join(ce.where("kind = 'issue'"), ce.where("kind = 'attempt'"),
                                                 CODE_TTL), "s5")


register("s5_code_interval_join", W(f"""
SELECT a.event_id, a.user_id, a.ts, i.ts AS issue_ts, a.code = i.code AS code_ok
FROM (SELECT * FROM code_events WHERE kind = 'attempt') a
JOIN (SELECT * FROM code_events WHERE kind = 'issue') i
  ON a.user_id = i.user_id AND a.ts >= i.ts AND a.ts <= i.ts + INTERVAL {CODE_TTL} SECOND""", "code_events"))(_s5)

# ---------------------------------------------------------------- scalar rules as queries
from scoreplane.functions import scalars as SC  # noqa: E402
from scoreplane.functions import text as TX  # noqa: E402

_DOC_LOWER = "lower(text)"

register("h1_normalize_title", W(f"SELECT id, {O.strip_lower_sql('job_title')} AS title FROM postings", "postings"))(
    lambda s, d: FX.postings(s, d).select("id", TX.normalize("job_title").alias("title")))

register("h2_replaced_text", W(f"""
SELECT id, {O.fold_replace_sql(O.strip_lower_sql(_COMPOSED), _RS.replacements)} AS text FROM postings""",
                               "postings"))(
    lambda s, d: FX.postings(s, d).select(
        "id", CL.normalized(compose_text("job_description", "resume_text"), _RS).alias("text")))

_PHRASES = ["ai", "c++", "802.11", "the", "data science"]
register("h3_bounded_phrases", f"""
SELECT doc_id, {', '.join(
    f"regexp_matches(lower(text), {O.q(TX.phrase_pattern_portable(p))}) AS has_{i}" for i, p in enumerate(_PHRASES))}
FROM documents""")(
    lambda s, d: FX.dealt(ST.read_table(s, d, "documents")).select(
        "doc_id", *[TX.has_phrase(F.lower("text"), p).alias(f"has_{i}") for i, p in enumerate(_PHRASES)]))

register("h4_word_count", f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{TX.WS}+'), lambda w: w <> '')) AS words,
       NOT regexp_matches(text, '^{TX.WS}*(?:{TX.WS.replace('[', '[^', 1)}+{TX.WS}+){{7}}{TX.WS.replace('[', '[^', 1)}')
         AS short_text
FROM documents""")(
    lambda s, d: FX.dealt(ST.read_table(s, d, "documents")).select(
        "doc_id", TX.word_count("text").alias("words"), TX.fewer_words_than("text", 8).alias("short_text")))

register("h5_compose_text", W(f"SELECT id, {_COMPOSED} AS text FROM postings", "postings"))(
    lambda s, d: FX.postings(s, d).select("id", compose_text("job_description", "resume_text").alias("text")))

register("h14_split_list", f"""
SELECT conv_id, turn,
       array_to_string(list_filter(list_transform(string_split(text, ','),
                                                  lambda x: regexp_replace(x, '^{TX.WS}+|{TX.WS}+$', '', 'g')),
                                   lambda x: x <> ''), '|') AS items
FROM conversations""")(
    lambda s, d: ST.read_table(s, d, "conversations").select(
        "conv_id", "turn", F.array_join(TX.split_list("text"), "|").alias("items")))

register("h16_local_stamp", W("""
SELECT call_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local_time FROM call_log""",
                              "call_log"))(
    lambda s, d: FX.call_log(s, d).select("call_id", SC.local_stamp("ts").alias("local_time")))

register("c5_alias_resolve", W("""
SELECT n0.id, COALESCE(x.v, n0.nb) AS resolved FROM n0 LEFT JOIN alias x ON x.k = n0.nb""", "label_pairs",
                               extra=O.similarity_ctes("label_pairs", "resume_domain", "job_domain")))(
    lambda s, d: SM.resolve_alias(
        FX.label_pairs(s, d).select("id", TX.normalize("job_domain").alias("nb")), "nb",
        F.broadcast(R.alias_table(s)), "resolved").select("id", "resolved"))

register("c4_pair_lookup", W("""
SELECT n.id, COALESCE(f.s, r.s) AS pair_sim FROM n
LEFT JOIN pairs f ON f.a = n.ra AND f.b = n.rb LEFT JOIN pairs r ON r.a = n.rb AND r.b = n.ra""", "label_pairs",
                             extra=O.similarity_ctes("label_pairs", "resume_domain", "job_domain")))(
    lambda s, d: SM.pair_lookup(
        SM.resolve_alias(SM.resolve_alias(
            FX.label_pairs(s, d).select("id", TX.normalize("resume_domain").alias("na"),
                                        TX.normalize("job_domain").alias("nb")),
            "na", F.broadcast(R.alias_table(s)), "ra"), "nb", F.broadcast(R.alias_table(s)), "rb"),
        "ra", "rb", F.broadcast(R.pair_table(s)), "pair_sim").select("id", "pair_sim"))

register("d13_best_domain_score", W("SELECT id, domain AS best_domain, score AS best_score FROM best", "postings",
                                    extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED)))(
    lambda s, d: CL.best_scores(FX.postings(s, d), _RS, "job_title",
                                compose_text("job_description", "resume_text"), keep=["id"]))

register("d13_best_domain_score_table", ORACLE["d13_best_domain_score"])(
    lambda s, d: CL.best_scores(FX.postings(s, d), _RS, "job_title", compose_text("job_description", "resume_text"),
                                keep=["id"], key="id", keywords=R.keywords_table(s, _RS)))

register("d17_boost_any", W("""
SELECT n.id, bs.rank IS NOT NULL AS ai_boost_in_text
FROM norm n LEFT JOIN (SELECT DISTINCT id, rank FROM bd WHERE rank = 2) bs ON bs.id = n.id""", "postings",
                            extra=O.classify_ctes(_RS, "postings", "id", "job_title", _COMPOSED)))(
    lambda s, d: FX.postings(s, d).select(
        "id", TX.has_any_phrase(CL.normalized(compose_text("job_description", "resume_text"), _RS),
                                FV.DOMAIN_BOOSTS["AI/Machine Learning"]).alias("ai_boost_in_text")))


# ---------------------------------------------------------------- sinks
from scoreplane.session import scratch_path  # noqa: E402
from scoreplane.sources.schemas import USER_LOGS  # noqa: E402

_EXPORT = {"min_ats": 40, "domain": "Data Science", "start_date": "2024-02-01", "end_date": "2024-12-31"}


def _a6(s, d):
    out = scratch_path(s, "export")
    ST.export_csv(FL.export_filter(FX.candidates(s, d), _EXPORT), out)
    return ST.read_csv(s, out, CANDIDATES)


register("a6_export_csv_readback", ORACLE["b5_export_filter"])(_a6)


def _a6_texts(s, d):
    """Whole texts with padding, line breaks, quotes and a backslash; an empty and a missing field."""
    out = scratch_path(s, "export")
    rows = ST.read_table(s, d, "documents").select(
        "doc_id", F.concat(F.lit("  "), "text", F.lit('\r\n"x" \\ ')).alias("name"), F.lit("").alias("empty"),
        F.lit(None).cast("string").alias("missing"))
    ST.export_csv(rows, out)
    return ST.read_csv(s, out, rows.schema)


register("a6_export_csv_texts", """
SELECT doc_id, '  ' || text || chr(13) || chr(10) || '"x" ' || chr(92) || ' ' AS name, '' AS empty,
       CAST(NULL AS VARCHAR) AS missing FROM documents""")(_a6_texts)


def _a7(s, d):
    out = scratch_path(s, "audit")
    logs = FX.user_logs(s, d)
    ST.append(logs.where(F.col("timestamp") < "2024-01-15"), out)
    ST.append(logs.where(F.col("timestamp") >= "2024-01-15"), out)
    return s.read.schema(USER_LOGS).parquet(out)


register("a7_append_audit", W("SELECT * FROM user_logs", "user_logs"))(_a7)

# ---------------------------------------------------------------- reproducible shuffle
from scoreplane.operators import shuffle as SHUF  # noqa: E402

_PERMUTED = O.permuted_sql("x", "half", SHUF.round_keys(42), SHUF.MULTIPLIER, SHUF.SHIFT)


def _shuffled_sql(rows: str, key: str) -> str:
    """Rows numbered by their key, the numbers permuted until they fall among the rows."""
    return f"""
SELECT {key}, x + 1 AS place FROM (
WITH RECURSIVE k AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS x, count(*) OVER () AS n FROM ({rows})),
h AS (SELECT *, greatest(1, (length(bin(n - 1)) + 1) // 2)::INT AS half FROM k),
w AS (SELECT {key}, n, half, {_PERMUTED} AS x FROM h
      UNION ALL SELECT {key}, n, half, {_PERMUTED} AS x FROM w WHERE x >= n)
SELECT * FROM w WHERE x < n)"""


register("f6_shuffled_keys", W(_shuffled_sql("SELECT DISTINCT api_key FROM call_log", "api_key"), "call_log"))(
    lambda s, d: SHUF.shuffled(FX.call_log(s, d).select("api_key").distinct(), ["api_key"]))

register("f6_shuffled_calls", W(_shuffled_sql("SELECT call_id FROM call_log", "call_id"), "call_log"))(
    lambda s, d: SHUF.shuffled(FX.call_log(s, d).select("call_id"), ["call_id"]))
