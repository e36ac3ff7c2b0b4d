"""Source divergence audit over run-length columns.

For every language the terms of at least ``MIN_DOCS`` of its documents are the
vocabulary. A (lang, source) group is a column: its count of each term, zeros
too. The vocabulary is reordered so that equal counts stand together (sorted
by the counts in the ``ORDER_COLUMNS`` smallest groups, one after the other,
then by the total) and cut into blocks of ``BLOCK`` positions. Each column of
a block is run-length encoded. Of two columns the run boundaries are
intersected, and what a run's two counts give is multiplied by its length, so
the work follows the runs, not the vocabulary.

``p`` of a count is 1 + floor(SCALE * (count + 5) / (N + 5 * V)), with N the
column's sum over the V terms of the vocabulary: whole numbers throughout.
``pairs`` sums abs(p - q) over all terms for every two sources of a language;
``terms`` holds the terms whose share in a source exceeds that in its
language most, by runs of the source's column against the language's.

Columns meet in tiles of some ``TILE`` sources each, by block: a task holds two
tiles of one block, whatever the number of rows, sources or terms. A source
with a third of all rows is one column like the others, and its counts are
summed by (source, term) after a sum in each task. Both directions of a pair
come from one comparison.

Defined results: null lang, source and text count as empty; a group without
terms is a column of zeros; a language without vocabulary has pairs of value
0 and no terms; repeated rows count again, ties go to the smaller item by
UTF-8; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import numbered, whole, written
from scoreplane.llm.packing import positions

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TERM_RANKS = 50
BLOCK = 8192
TILE = 64
ORDER_COLUMNS = 8
FLUSH_TERMS = 400_000
# letters A-Z, a-z and all beyond ASCII, in UTF-8 of which A-Z is lower-cased
TERM = re.compile(rb"[a-z\x80-\xff]+")


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences in the group; docs holds the language's documents with the term,
    spread over its groups in any way. A row with null term for every group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                d = seen.get((lang, source), {})
                yield pa.record_batch({
                    "lang": pa.array([lang] * (len(c) + 1), pa.string()), "source": pa.array([source] * (len(c) + 1), pa.string()),
                    "term": pa.array([None, *c], pa.binary()), "n": pa.array([0, *c.values()], pa.int64()),
                    "docs": pa.array([0, *(d[t] for t in c)], pa.int64())})
            n.clear()
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = TERM.findall(text.lower())  # bytes: A-Z alone are lower-cased
                n.setdefault((lang, source), Counter()).update(terms)
                seen.setdefault((lang, source), Counter()).update(set(terms))
            if sum(map(len, n.values())) > FLUSH_TERMS:
                yield from rows()
        yield from rows()

    cols = [whole(F.col(c).cast("string")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*cols, whole(text_col).cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn(
        "term", F.col("term").cast("string"))


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, pos): the kept terms, their count in the language and their place; a language's places are successive."""
    own = counts.where("term IS NOT NULL")
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # one row per group
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("size", "source"))
    first = sizes.withColumn("k", rank).where(F.col("k") <= ORDER_COLUMNS).select("lang", "source", "k")
    named = own.join(first, ["lang", "source"], "left")
    keys = [F.sum(F.when(F.col("k") == k + 1, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(ORDER_COLUMNS)]
    kept = named.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), *keys).where(
        F.col("docs") >= min_docs).drop("docs")
    kept = numbered(kept.withColumn("one", F.lit(1)), "divergence-terms")
    at = positions(kept, ["lang", *(f"k{k}" for k in range(ORDER_COLUMNS)), "n", "term", "row_id"], "one")
    return written(kept.join(at, "row_id").select("lang", "term", "n", "pos"), "divergence-vocabulary")


def encode(at: np.ndarray, n: list, width: int) -> tuple[np.ndarray, list]:
    """(ends, counts) of the runs of a column of ``width`` places with count n at the places ``at``, else 0."""
    ends, counts, last = [], [], 0

    def add(stop: int, value: int) -> None:
        if stop == (ends[-1] if ends else 0):
            return
        if counts and counts[-1] == value:
            ends[-1] = stop
        else:
            ends.append(stop)
            counts.append(value)

    for k in np.argsort(at, kind="stable"):
        add(int(at[k]), 0)
        last = int(at[k]) + 1
        add(last, int(n[k]))
    add(width, 0)
    return np.array(ends, np.int64), counts


def shares(counts: list, size: int, terms: int) -> np.ndarray:
    """p of each count, exact; Python numbers inside, as SCALE * count need not fit 64 bits."""
    return np.array([1 + SCALE * (c + SMOOTH) // (size + SMOOTH * terms) for c in counts], np.int64)


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run ends of two columns -> (ends, run of a, run of b) of their common runs."""
    ends = np.union1d(a, b)
    return ends, np.searchsorted(a, ends), np.searchsorted(b, ends)


def columns(counts: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Run-length columns: (lang, source, block, first, whole, ends, counts, p) of the language's places in each block,
    from its place ``first``; whole: the language's own column. A language without vocabulary has the block -1."""
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"), F.min("pos").alias("start"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, "lang", "left").fillna(0, ["terms"])
    at = [F.floor(F.col("pos") / block).alias("block"), F.col("pos"), F.col("n")]
    cells = counts.where("term IS NOT NULL").join(words.select("lang", "term", "pos"), ["lang", "term"]).select("lang", "source", *at)
    packed = F.collect_list(F.struct("pos", "n")).alias("cells")
    parts = cells.groupBy("lang", "source", "block").agg(packed, F.sum("n").alias("own"))
    parts = written(parts, "divergence-cells")
    own = parts.groupBy("lang", "source").agg(F.sum("own").alias("size"))
    end = F.col("start") + F.col("terms")
    blocks = F.when(F.col("terms") == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    every = groups.join(own, ["lang", "source"], "left").fillna(0, ["size"]).withColumn("block", F.explode(blocks))
    per_source = every.join(parts.drop("own"), ["lang", "source", "block"], "left").select(
        "lang", "source", "block", F.lit(False).alias("whole"), "terms", "size", "start", "cells")
    in_lang = words.select("lang", *at).groupBy("lang", "block").agg(packed).join(sizes, "lang").select(
        "lang", F.lit("").alias("source"), "block", F.lit(True).alias("whole"), "terms", F.col("total").alias("size"), "start", "cells")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            firsts, runs, shared = [], [], []
            for terms, size, no, start, pos, n in zip(pdf.terms, pdf["size"], pdf.block, pdf.start, pdf.pos, pdf.n):
                first = 0 if no < 0 else max(int(start), int(no) * block)
                stop = 0 if no < 0 else min(int(start) + int(terms), (int(no) + 1) * block)
                pos, n = ([], []) if pos is None else (pos, n)
                firsts.append(first)
                runs.append(encode(np.asarray(pos, np.int64) - first, n, stop - first))
                shared.append(shares(runs[-1][1], int(size), int(terms)))
            yield pd.DataFrame({"lang": pdf.lang, "source": pdf.source, "block": pdf.block, "first": firsts, "whole": pdf.whole,
                                "ends": [r[0] for r in runs], "counts": [np.array(r[1], np.int64) for r in runs], "p": shared})

    both = per_source.unionByName(in_lang).withColumns({"pos": F.col("cells.pos"), "n": F.col("cells.n")}).drop("cells")
    both = both.withColumn("start", F.coalesce("start", F.lit(0)))
    return both.mapInPandas(run, "lang string, source string, block long, first long, whole boolean, ends array<long>, "
                                 "counts array<long>, p array<long>")


def compared(cols: DataFrame, ranks: int = TERM_RANKS, tile: int = TILE) -> DataFrame:
    """(lang, kind, source, other, value, start, stop) of every pair of columns of a block.

    kind pair: value is the block's part of the sum. kind term: a run of the source's column against the
    language's, cut to those that can hold one of the ``ranks`` first terms.
    """
    tiles = cols.where("NOT whole").groupBy("lang").agg(F.ceil(F.count_distinct("source") / tile).alias("tiles"))
    cols = cols.join(F.broadcast(tiles), "lang")  # one row per language
    own = F.pmod(F.xxhash64("source"), F.col("tiles"))
    every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    cols = cols.withColumn("own", own).withColumn("t", F.explode(every))
    cols = cols.withColumns({"ta": F.when(F.col("whole"), F.col("t")).otherwise(F.least("own", "t")),
                             "tb": F.when(F.col("whole"), F.col("t")).otherwise(F.greatest("own", "t"))})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, ta, tb = key
        out, first = [], int(pdf["first"].iloc[0])
        total = next(((e, p) for e, p, w in zip(pdf.ends, pdf.p, pdf.whole) if w), None)
        own = pdf[~pdf.whole.astype(bool)]
        # by source: rows come in any order, and a pair must have the same two sides in every block
        rows = sorted(zip(own.own, own.source, own.ends, own["counts"], own.p), key=lambda r: r[1])
        for i, (t, source, ends, counts, p) in enumerate(rows):
            for t2, other, ends2, _, p2 in rows[i + 1:]:
                if ta == tb or t != t2:
                    cut, a, b = intersect(ends, ends2)
                    f = np.abs(p[a] - p2[b]) * np.diff(cut, prepend=0)
                    out.append(("pair", source, other, int(f.sum()), 0, 0))
            if ta == tb and total is not None:
                cut, a, b = intersect(ends, total[0])
                over, length = p[a] - total[1][b], np.diff(cut, prepend=0)
                good = np.nonzero((counts[a] > 0) & (over > 0))[0]
                good = good[np.argsort(-over[good], kind="stable")]
                if len(good):
                    reach = np.cumsum(length[good])
                    least = over[good][min(np.searchsorted(reach, ranks), len(good) - 1)]
                    good = good[over[good] >= least]
                out += [("term", source, "", int(over[k]), first + int(cut[k] - length[k]), first + int(cut[k]))
                        for k in good]
        got = pd.DataFrame(out, columns=["kind", "source", "other", "value", "start", "stop"])
        return got.assign(lang=lang)

    return cols.groupBy("lang", "block", "ta", "tb").applyInPandas(
        run, "kind string, source string, other string, value long, start long, stop long, lang string")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: its pairs, then its most raised terms."""
    counts = written(counted(docs, text_col, lang_col, source_col), "divergence-counts")
    words = vocabulary(counts, min_docs)
    found = written(compared(columns(counts, words, block), ranks, tile), "divergence-runs")
    sums = found.where("kind = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    side = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pairs = sums.withColumn("s", F.explode(F.array(side("source", "other"), side("other", "source")))).select(
        "lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    places = found.where("kind = 'term'").withColumn("pos", F.explode(F.sequence("start", F.col("stop") - 1))).select(
        "lang", "source", "value", "pos")
    terms = places.join(words.select("lang", "pos", F.col("term").alias("item")), ["lang", "pos"]).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= ranks))
