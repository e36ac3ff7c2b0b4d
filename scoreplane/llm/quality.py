"""Line-first quality rules, DataFrame functions only.

Every line is judged by itself: symbol noise, shouting punctuation,
navigation (separator-studded) and boilerplate phrases (a phrase fails a line
of up to ``SHORT_LINE`` characters; a longer one, such as a text without line
breaks, only if phrases are ``MIN_PHRASE_SHARE`` of it). Failing lines are
removed; a document that loses more than ``MAX_LOST`` of its word characters
is rejected, as is one that fails the document rules (fewer than 50 words,
or more than half of its words inside repeated three-word windows).

Repeated windows are found inside each row: windows become 64-bit hashes,
equal neighbours of the sorted hashes are the repeated ones, and the sorted
positions of those give the words they cover: n log n in the length of the
text, no shuffle. (Two different windows of one text share a hash with a
chance of about n * n / 2^65.)

Defined results: a null text has no words and is rejected; a text without
line break is one line; repeated rows are judged alike; an empty table gives
an empty result; extra columns are kept by ``clean`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import SPACE, WORD, whole

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOST = 0.4
#: share of a line's characters that may be symbols (#*$%&|<>)
MAX_SYMBOL_SHARE = 0.1
#: share of a line's words that may end in doubled marks
MAX_SHOUT_SHARE = 0.3
#: a line of at most so many characters fails with one boilerplate phrase
SHORT_LINE = 200
#: share of a longer line's characters that phrases must make up to fail it
MIN_PHRASE_SHARE = 0.1
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "click here", "sign up for our", "subscribe to our", "enable javascript", "licensed under the",
    "released under the", "this work is licensed under", "lorem ipsum", "back to top", "read more",
)


_MARKED = r"[#*$%&|<>\u00BB\u203A\u2022\u00B7]|[!?]{2}"
_FEW = 32


def _any(text: Column, parts) -> Column:
    """True if lower-case text has one of the parts (the phrase pattern ignores the case of A-Z only)."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column, marked: Column, boiler: Column) -> Column:
    """True if the line is removed. A line without a visible character stays.

    ``marked`` and ``boiler`` say whether the text has a mark or a phrase (in
    any case) anywhere, so that clean texts skip the tests.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    symbols = count(r"[#*$%&|<>]") > MAX_SYMBOL_SHARE * F.char_length(line)
    shouts = count(r"[^\x20\x09-\x0D!?]+(!{2,}|\?{2,}|[!?]{3,})(?=[\x20\x09-\x0D]|$)") > MAX_SHOUT_SHARE * count(WORD)
    separators = count(r"(^|[\x20\x09-\x0D])[|\u00BB\u203A\u2022\u00B7>](?=[\x20\x09-\x0D]|$)")
    phrases = f"(?i)(?:{'|'.join(BOILERPLATE)})"
    without = F.char_length(F.regexp_replace(line, phrases, ""))
    mostly = (F.char_length(line) <= SHORT_LINE) | (
        F.char_length(line) - without >= MIN_PHRASE_SHARE * F.char_length(line))
    return ((marked & (symbols | shouts | (separators >= F.greatest(F.lit(3), 0.2 * count(WORD)))))
            | (boiler & line.rlike(phrases) & mostly)
            | (~line.rlike(r"\p{L}") & line.rlike(WORD)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct ``__q`` of counts, the cleaned text and the verdict."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    t = F.col("__t")
    df = docs.select(*cols, whole(text_col).alias("__t"))
    df = df.withColumns({"__w": words(t), "__l": F.split(t, "\n"), "__m": t.rlike(_MARKED), "__low": F.lower(t)})
    df = df.withColumn("__b", _any(F.col("__low"), BOILERPLATE)).drop("__low")
    n = F.size("__w")
    # hash of the window that begins at each word; the last two are no windows
    h = F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    df = df.withColumns({"__n": n, "__wc": F.char_length(F.array_join("__w", "")).cast("long"),
                         "__h": F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0)))})
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array("__h")))
    df = df.withColumn("__d", F.array_distinct(F.filter("__s", lambda x, i: x == F.get("__s", i - 1)))).drop("__s")
    # positions of repeated windows: a short list is searched, a long one met by sorting (window, position)
    df = df.withColumn("__z", F.when(F.size("__d") > _FEW, F.sort_array(
        F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    found = F.when(F.size("__d") > _FEW, F.array_sort(F.transform(
        F.filter("__z", lambda x, i: (x["h"] == F.get("__z", i - 1)["h"]) | (x["h"] == F.get("__z", i + 1)["h"])),
        lambda x: x["p"]))).when(F.size("__d") > 0, F.array_compact(
            F.transform("__h", lambda x, i: F.when(F.array_contains("__d", x), i))))
    df = df.withColumn("__p", found).drop("__z", "__h", "__d", "__w")
    # words covered: 3 per window, less the overlap with the window before
    covered = F.aggregate(
        F.transform("__p", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("__p", i - 1)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumns({
        "__r": F.coalesce(covered, F.lit(0).cast("long")),
        "__lw": F.filter("__l", lambda x: x.rlike(WORD)),
        "__c": F.array_join(F.filter("__l", lambda x: ~line_fails(x, F.col("__m"), F.col("__b"))), "\n")}).drop("__p")
    n, chars = F.col("__n"), F.col("__wc")
    left = F.when(F.char_length("__c") == F.char_length(t), chars).otherwise(
        F.char_length(F.regexp_replace("__c", SPACE, ""))).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("__r") > MAX_REPEAT_PCT * n)
    # always true, and not deterministic: a filter on the verdict stays above this projection instead of
    # being rewritten down through all of the above, each time with every expression written out again
    here = F.monotonically_increasing_id() >= 0
    q = F.struct(
        n.cast("long").alias("n_words"), chars.alias("word_chars"),
        F.when(F.col("__m"), F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("__lw") - F.size(F.array_distinct("__lw"))).cast("long").alias("n_dup_lines"),
        F.col("__r").alias("n_repeat_words"), left.alias("left_chars"), failed.alias("base_failed"),
        (~failed & (left >= (1 - MAX_LOST) * chars) & here).alias("kept"), F.col("__c").alias("clean_text"))
    return df.select(*cols, q.alias("__q"))


def clean(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """Documents that pass, with their failing lines removed; same columns."""
    df = measured(docs, text_col).where("__q.kept")
    df = df.withColumn(text_col, F.col("__q.clean_text"))
    if count_col and count_col in docs.columns:
        df = df.withColumn(count_col, F.char_length(text_col).cast(docs.schema[count_col].dataType))
    return df.drop("__q")
