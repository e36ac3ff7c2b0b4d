"""Fixture views derived from the driver tables.

Deterministic integer arithmetic over ``events``, ``customer``,
``documents`` and ``pages`` so Spark and DuckDB compute equal values. Each
view grows with its source table; nothing here is generated from constants
alone. ``scoreplane.oracle`` holds the DuckDB form of every view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane import rules as R
from scoreplane.sources.tables import read_table

# Fixed reference instant for "now"-relative queries on the fixtures.
AS_OF_DATE = "2025-02-20"
AS_OF_TS = "2024-01-20 12:00:00"

# Intended label of each sample title (same index as rules.SAMPLE_TITLES).
TITLE_LABELS = [
    "Data Science", "AI/Machine Learning", "Frontend Development", "Backend Development",
    "Full Stack Development", "Cybersecurity", "Cloud Engineering", "DevOps/Infrastructure",
    "Quality Assurance", "Game Development", "Mobile Development", "Product Management",
    "Site Reliability Engineering", "Networking", "Unclassified", "Full Stack Development",
]


def dealt(df: DataFrame) -> DataFrame:
    """A small table stored as one file, dealt to all cores once."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


INVALID_LABEL = "LLM unavailable: no healthy key"
MODEL_ERRORS = ["HTTP 429", "Rate limit reached", "Quota exceeded", "connection reset"]


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    v = F.floor(F.col("value") * 100).cast("bigint")
    return ev.select(
        eid.alias("id"),
        F.concat(F.lit("resume_"), eid.cast("string"), F.lit(".pdf")).alias("resume_name"),
        F.concat(F.lit("user_"), uid.cast("string")).alias("candidate_name"),
        (v % 101).cast("int").alias("ats_score"),
        ((eid * 37) % 101).cast("int").alias("edu_score"),
        ((eid * 53 + uid) % 101).cast("int").alias("exp_score"),
        ((eid * 71 + 13) % 101).cast("int").alias("skills_score"),
        ((eid * 29 + uid * 3) % 101).cast("int").alias("lang_score"),
        ((eid * 17 + 5) % 101).cast("int").alias("keyword_score"),
        ((eid * 11) % 101).cast("int").alias("format_score"),
        (((v * 7) % 101).cast("double") / 100).cast("float").alias("bias_score"),
        _pick(FV.DOMAIN_LABELS, uid % 33).alias("domain"),
        (F.col("ts") + F.make_dt_interval(days=((uid % 14) * 30).cast("int"))).alias("timestamp"),
    )


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_logs_from(read_table(spark, sf_dir, "events"))


def user_logs_from(ev: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.when(et == "signup", "register").when(et == "view", "login").otherwise(et).alias("action"),
        F.date_format("ts", FV.LOG_TIME_FORMAT).alias("timestamp"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model call per event: key by user, error text on error events."""
    return call_log_from(read_table(spark, sf_dir, "events"))


def call_log_from(ev: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    is_err = F.col("event_type") == "error"
    return ev.select(
        eid.alias("call_id"),
        F.concat(F.lit("key_"), (uid % 8).cast("string")).alias("api_key"),
        ((uid % 8) == 0).alias("own_key"),
        F.col("ts").alias("ts"),
        F.concat(F.lit("m"), (eid % 2).cast("string")).alias("model"),
        (eid % 500).cast("string").alias("prompt"),
        F.when(is_err, F.lit(None).cast("string")).otherwise(eid.cast("string")).alias("response"),
        F.when(is_err, _pick(MODEL_ERRORS, eid % 4)).alias("error"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = (F.when(k % 10 == 0, F.lit(None).cast("string"))
             .when(k % 13 == 0, F.concat(F.lit("user"), k.cast("string"), F.lit("@invalid")))
             .otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))))
    return c.select(k.alias("id"), F.col("c_name").alias("username"), email.alias("email"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: one per signup event; users sign up repeatedly."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    uid = F.col("user_id")
    email = (F.when(uid % 9 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("user"), (uid * 17).cast("string"), F.lit("@example.com"))))
    return ev.select(
        F.col("event_id").alias("req_id"),
        F.concat(F.lit("Customer#"), F.lpad((uid * 13).cast("string"), 9, "0")).alias("username"),
        email.alias("email"),
        F.col("ts"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings over whole documents: title and phrase chosen by doc_id.

    Every posting carries its document's whole text as the resume text; the
    empty-resume and short-description rules are covered by the edge-row
    and brute-force tests.
    """
    d = dealt(read_table(spark, sf_dir, "documents"))
    did = F.col("doc_id")
    return d.select(
        did.alias("id"),
        _pick(R.SAMPLE_TITLES, did % len(R.SAMPLE_TITLES)).alias("job_title"),
        _pick(R.SAMPLE_PHRASES, (did * 7) % len(R.SAMPLE_PHRASES)).alias("job_description"),
        F.col("text").alias("resume_text"),
    )


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers for the documents the driver's ``labels`` table covers.

    Documents without a ``labels`` row have no model answer (the normal case
    in the original ingest path). A toxic document gets the error string the
    model call returns instead of a label; a good-quality one the label its
    title intends; the rest some domain label.
    """
    lab = read_table(spark, sf_dir, "labels")
    did = F.col("doc_id")
    label = (F.when(F.col("toxic") == 1, F.lit(INVALID_LABEL))
             .when(F.col("quality") == 1, _pick(TITLE_LABELS, did % len(R.SAMPLE_TITLES)))
             .otherwise(_pick(FV.DOMAIN_LABELS, did % 33)))
    return lab.select(did.alias("id"), label.alias("label"))


def code_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued codes (signup) and attempts (click) per user."""
    return code_events_from(read_table(spark, sf_dir, "events"))


def code_events_from(ev: DataFrame) -> DataFrame:
    ev = ev.where(F.col("event_type").isin("signup", "click"))
    uid, eid = F.col("user_id"), F.col("event_id")
    day_code = F.lpad(((uid * 7919 + F.dayofyear("ts") * 104729) % 1000000).cast("string"), 6, "0")
    is_issue = F.col("event_type") == "signup"
    code = F.when(is_issue | (eid % 4 != 0), day_code).otherwise(F.lit("999999"))
    return ev.select(eid.alias("event_id"), uid.alias("user_id"),
                     F.when(is_issue, "issue").otherwise("attempt").alias("kind"),
                     code.alias("code"), F.col("ts"))


LINK_PATTERN = r'<a href="([^"]*)">([^<]*)</a>'


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested catalogue, one per page: {lang: {host: [(title, url)]}}."""
    p = read_table(spark, sf_dir, "pages")
    urls = F.regexp_extract_all("html", F.lit(LINK_PATTERN), 1)
    titles = F.regexp_extract_all("html", F.lit(LINK_PATTERN), 2)
    courses = F.transform(F.arrays_zip(titles.alias("t"), urls.alias("u")),
                          lambda z: F.struct(z["t"].alias("title"), z["u"].alias("url")))
    lang = F.regexp_extract("html", r'<html lang="([a-z]+)"', 1)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return p.select(F.col("page_id").alias("catalog_id"),
                    F.create_map(lang, F.create_map(host, courses)).alias("catalog"))


# Free-text labels compared against candidate domains: alias spellings,
# plain labels in other cases and spacing, and unknown text.
SIM_PROBES = (list(FV.SIMILARITY_ALIASES)
              + [x.upper() for x in FV.DOMAIN_LABELS[:8]]
              + ["  " + x.lower() + " " for x in FV.DOMAIN_LABELS[8:]]
              + ["Unknown Role", "frontend ", "  ML", "Data Science"])


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate domain, free-text job label) per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"),
                     _pick(FV.DOMAIN_LABELS, F.col("user_id") % 33).alias("resume_domain"),
                     _pick(SIM_PROBES, F.col("event_id") % len(SIM_PROBES)).alias("job_domain"))


def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in identifiers: e-mail, username or unknown text, per view event."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    eid, uid = F.col("event_id"), F.col("user_id")
    ident = (F.when(eid % 3 == 0, F.concat(F.lit("user"), (uid * 10).cast("string"), F.lit("@example.com")))
             .when(eid % 3 == 1, F.concat(F.lit("Customer#"), F.lpad((uid * 10).cast("string"), 9, "0")))
             .otherwise(F.concat(F.lit("nobody"), uid.cast("string"))))
    return ev.select(eid.alias("req_id"), ident.alias("identifier"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records to ingest, one per document, some deliberately invalid.

    ats spans -1..101, edu is fractional on every 11th row, bias reaches
    1.01, format is missing on every 4th row and fractional elsewhere,
    and every 97th row has a NaN skills score.
    """
    return submissions_from(dealt(read_table(spark, sf_dir, "documents")))


def submissions_from(d: DataFrame) -> DataFrame:
    did = F.col("doc_id")
    return d.select(
        did.alias("sub_id"),
        F.concat(F.lit("cv_"), did.cast("string"), F.lit(".pdf")).alias("resume_name"),
        F.concat(F.lit("person_"), (did % 997).cast("string")).alias("candidate_name"),
        ((did * 13) % 103 - 1).cast("double").alias("ats_score"),
        F.when(did % 11 == 0, (did * 7) % 100 + 0.5).otherwise(((did * 7) % 100).cast("double"))
        .alias("edu_score"),
        ((did * 3) % 101).cast("double").alias("exp_score"),
        F.when(did % 97 == 0, F.lit(float("nan"))).otherwise(((did * 5) % 101).cast("double"))
        .alias("skills_score"),
        ((did * 9) % 101).cast("double").alias("lang_score"),
        ((did * 19) % 101).cast("double").alias("keyword_score"),
        F.when(did % 4 == 0, F.lit(None).cast("double")).otherwise((did % 1001) / 10.0).alias("format_score"),
        (((did * 7) % 102) / 100.0).alias("bias_score"),
        _pick(R.SAMPLE_TITLES, did % len(R.SAMPLE_TITLES)).alias("job_title"),
        _pick(R.SAMPLE_PHRASES, (did * 7) % len(R.SAMPLE_PHRASES)).alias("job_description"),
        F.col("text").alias("resume_text"),
    )
