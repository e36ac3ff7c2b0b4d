"""Texts x phrases by their candidates (C6 for vocabularies of any size).

A phrase occurs in a text where it stands with no a-z letter directly before
or after it. Texts and phrases are cut into maximal letter runs and the gaps
between them, so an occurrence covers whole runs of the text with the gaps
between them, and ends and starts of the gaps beside them. All of that is
equality of strings: no regex per phrase, and the phrases stay a DataFrame.

1. Shapes: a phrase with letters has a number of runs and two outer gaps of
   some length. The distinct shapes of all phrases are one row.
2. Candidates: at every run of a text, the piece of each shape that starts
   there and stands alone. It is the phrase, if it is one.
3. Filter: every phrase sets one of ``FILTER_BITS`` bits by its hash, whatever
   their number; a candidate whose bit is not set is no phrase and goes no
   further. So no shuffle takes all words of the texts, only (row, candidate)
   of the hits and of a share of the rest, which grows with the phrases.
4. What is left meets the phrases by an equi join, once a text.
5. Phrases without letters lie inside one gap. Distinct gaps are cut into the
   substrings of the lengths that such phrases have and met on equality.
   Without such phrases the texts are not cut for them.

The work of a text is its runs times the shapes (times their runs), not the
phrases: 50,000 phrases of a few shapes cost as many candidates as one each.
A frequent phrase is a hot key of one plain join, so AQE splits it. Nothing is
collected and no job starts while the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RUN = "[a-z]+"
_PIECE = re.compile("[a-z]+|[^a-z]+")
FLUSH = 100_000  # candidates in a batch
FILTER_BITS = 1 << 24  # in words of 64: 6 MB at most


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(RUN), F.lit(0))


def _gaps(c: Column) -> Column:
    """One gap more than runs: before the first, between them, after the last."""
    return F.split(c, RUN, -1)


def phrase_shapes(terms: DataFrame) -> DataFrame:
    """One row: ``shapes``, the distinct (k, llen, rlen) of the phrases with letters, runs and lengths of the outer gaps."""
    t = terms.select(F.size(_runs(F.col("term"))).alias("k"), _gaps(F.col("term")).alias("gaps")).where("k > 0")
    shape = F.struct("k", F.length(F.get("gaps", F.lit(0))).alias("llen"), F.length(F.get("gaps", F.col("k"))).alias("rlen"))
    return t.agg(F.collect_set(shape).alias("shapes"))


def pieces_of(text: str, shapes: list[tuple[int, int, int]]) -> set[str]:
    """The piece of each shape at each run of the text that no letter touches."""
    parts = _PIECE.findall(text)
    if parts and "a" <= parts[0][0] <= "z":
        parts.insert(0, "")
    if len(parts) % 2 == 0:
        parts.append("")  # a gap, a run, a gap, ..., a gap
    runs, found = len(parts) // 2, set()
    for k, llen, rlen in shapes:
        cores = map("".join, zip(*(parts[1 + j::2] for j in range(2 * k - 1))))
        if not llen and not rlen:
            found.update(cores)
            continue
        for pos, (core, before, after) in enumerate(zip(cores, parts[::2], parts[2 * k::2])):
            # a letter stands before an outer gap as long as the text's, unless the text starts there
            if (not llen or len(before) >= llen + (pos > 0)) and (not rlen or len(after) >= rlen + (pos + k < runs)):
                found.add(before[len(before) - llen:] + core + after[:rlen])
    return found


def candidates(texts: DataFrame, shapes: DataFrame) -> DataFrame:
    """(row, term) of (row, text): the distinct pieces of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [(s["k"], s["llen"], s["rlen"]) for s in batch.column("shapes")[0].as_py()]
            at, terms = [], []
            for i, text in enumerate(batch.column("text")):
                found = pieces_of(text.as_py(), kinds)
                at += [i] * len(found)
                terms += found
                if len(terms) >= FLUSH or i == batch.num_rows - 1:
                    yield pa.record_batch({"row": batch.column("row").take(pa.array(at, pa.int64())), "term": pa.array(terms, pa.string())})
                    at, terms = [], []

    t = texts.crossJoin(F.broadcast(shapes)).where("size(shapes) > 0").select("row", "text", "shapes")
    return t.mapInArrow(run, StructType([t.schema["row"], StructField("term", StringType())]))


def _bits(c: str) -> dict[str, Column]:
    """Word and bit of a string in the filter."""
    return {"word": F.expr(f"pmod(shiftright(xxhash64({c}), 6), {FILTER_BITS // 64})"),
            "bit": F.expr(f"CAST(xxhash64({c}) & 63 AS INT)")}


def likely(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, term) of ``found`` whose bit is that of a phrase: all that are one, and a few that are none."""
    bits = terms.select(*[c.alias(k) for k, c in _bits("term").items()]).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))  # one row per word of the filter
    return found.withColumns(_bits("term")).join(F.broadcast(bits), "word").where("getbit(bits, bit) = 1").select("row", "term")


def _with_letters(texts: DataFrame, terms: DataFrame) -> DataFrame:
    with_letters = terms.where("letters").select("term")
    found = likely(candidates(texts, phrase_shapes(with_letters)), with_letters)
    return found.distinct().join(with_letters, "term").select("row", "term")


def _without_letters(texts: DataFrame, terms: DataFrame) -> DataFrame:
    terms = terms.where("NOT letters").select("term")
    lengths = F.broadcast(terms.agg(F.collect_set(F.length("term")).alias("lengths")))  # one row
    gaps = texts.crossJoin(lengths).where("size(lengths) > 0").select("row", "lengths", _gaps(F.col("text")).alias("gaps")).select(
        "row", "lengths", F.size("gaps").alias("m"), F.posexplode("gaps").alias("g", "gap")).where("length(gap) >= array_min(lengths)")
    gaps = gaps.select("row", "gap", (F.col("g") > 0).alias("left"), (F.col("g") < F.col("m") - 1).alias("right")).distinct()
    kinds = gaps.select("gap", "left", "right").distinct().crossJoin(lengths)
    cut = kinds.withColumn("size", F.explode("lengths")).where("size <= length(gap)")
    # a letter stands before the first character of a gap, unless the text starts there
    first = F.when(F.col("left"), 2).otherwise(1)
    last = F.length("gap") - F.col("size") + F.when(F.col("right"), 0).otherwise(1)
    cut = cut.withColumns({"lo": first, "hi": last}).where("lo <= hi")
    cut = cut.withColumn("at", F.explode(F.sequence("lo", "hi"))).select(
        "gap", "left", "right", F.expr("substr(gap, at, size)").alias("term")).distinct()
    found = cut.join(terms, "term")
    return gaps.join(found, ["gap", "left", "right"]).select("row", "term").distinct()


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str = "row", text: str = "text", term: str = "term") -> DataFrame:
    """(key, term): the phrases of ``phrases`` that occur in each text, once each.

    ``key`` may be any unique column, also a struct. Null texts and null or
    empty phrases have no hits.
    """
    t = texts.select(F.col(key).alias("row"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # an aggregate, so that both kinds read the same distinct phrases
    p = phrases.select(F.col(term).alias("term")).where("term <> ''").groupBy("term").agg(
        F.max(F.col("term").rlike(RUN)).alias("letters"))
    found = _with_letters(t, p).unionByName(_without_letters(t, p))
    return found.select(F.col("row").alias(key), F.col("term").alias(term))
