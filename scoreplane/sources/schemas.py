"""Typed schemas of the tables the operators read and write (no secret columns)."""

from pyspark.sql import types as T

CANDIDATES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("resume_name", T.StringType(), False),
    T.StructField("candidate_name", T.StringType(), False),
    T.StructField("ats_score", T.IntegerType(), False),
    T.StructField("edu_score", T.IntegerType(), False),
    T.StructField("exp_score", T.IntegerType(), False),
    T.StructField("skills_score", T.IntegerType(), False),
    T.StructField("lang_score", T.IntegerType(), False),
    T.StructField("keyword_score", T.IntegerType(), False),
    T.StructField("format_score", T.IntegerType(), False),
    # 32-bit on purpose: threshold comparisons against double literals depend on it
    T.StructField("bias_score", T.FloatType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])
SCORE_COLUMNS = ["ats_score", "edu_score", "exp_score", "skills_score",
                 "lang_score", "keyword_score", "format_score"]

LLM_CACHE = T.StructType([
    T.StructField("prompt_hash", T.StringType(), False),
    T.StructField("response", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])
KEY_FAILURES = T.StructType([
    T.StructField("api_key", T.StringType(), False),
    T.StructField("fail_time", T.TimestampNTZType(), False),
    T.StructField("reason", T.StringType(), False),
])
KEY_USAGE = T.StructType([
    T.StructField("api_key", T.StringType(), False),
    T.StructField("usage_count", T.LongType(), False),
    T.StructField("last_reset", T.DateType(), False),
])
ACCOUNTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("email", T.StringType(), True),
])
USER_LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("timestamp", T.StringType(), False),
])
CALL_LOG = T.StructType([
    T.StructField("call_id", T.LongType(), False),
    T.StructField("api_key", T.StringType(), False),
    T.StructField("own_key", T.BooleanType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("prompt", T.StringType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])
CODE_EVENTS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])
COURSE = T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType())])
CATALOG = T.StructType([
    T.StructField("catalog", T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(COURSE)))),
])
