"""Near-duplicate classes by order MinHash and banded alignment.

A text is its sequence of words; its k-mers are runs of ``K`` words. A sketch
takes the ``PICKS`` distinct k-mers with the smallest hashes and keeps them in
the order of their first occurrence, so it is equal for texts that share those
k-mers in the same order. Texts with repeated k-mers have sketches in the
order of the last occurrences too. Texts that share one of ``SKETCHES``
sketches are candidates: at similarity 0.8 a pair of texts whose distinct
k-mers come in one order misses all of them with a chance of 1.2e-5 if they
are many, and 4e-5 at most above the ``SHORT`` k-mers where the next rule begins. (Not
covered by these rates: passages that both texts have in another order by
first and by last occurrence, and are similar by a copy between.)

Texts of few k-mers have an exact rule besides: k-mers are put in order of
their number of texts, and of n k-mers of a text the n - ceil(similarity * n)
+ 1 rarest are keys. Similar texts share one of them, whatever their order.
Every text that can be similar to one of up to ``SHORT`` k-mers has them.

Candidates are verified by a banded alignment of their words (furthest
reaching points, band as wide as the similarity still allows): the distinct
k-mers inside matched runs, over all distinct k-mers of both, must be at
least ``SIMILARITY``.

No bucket is expanded into pairs. Copies collapse first (equal word
sequences). Then each member of a bucket is compared with the bucket's leader
(the member whose buckets are largest), and links merge classes; that settles the usual groups. What is left
are links between members of different classes of one bucket. For them, the
groups that buckets connect and that hold more than one class are cut into
blocks of about ``BLOCK`` k-mers, those of the group's largest class apart.
Pairs of blocks (not of two blocks of the largest class) are compared as
incidence matrices, which gives the exact k-mer Jaccard of all their pairs;
those of different classes at ``SIMILARITY`` or more are kept, and of each
pair of classes the most similar pair is aligned, then the next if the
alignment refuses it, until no pair is left. A block pair is one bounded
task, so a large group costs many tasks, not a large one.

Defined results: null and empty texts and texts of spaces are equal (one
class); a text of fewer than ``K`` words has one k-mer, all its words;
repeated rows share a class; an empty table gives an empty result; extra
columns are kept by ``drop_near`` and never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import SPACE, placed, whole, written

K = 5
SKETCHES = 48
PICKS = 7
SHORT = 40
SIMILARITY = 0.8
MIN_AGREE = 2
BLOCK = 40_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def word_codes(text: str) -> np.ndarray:
    """32-bit codes of the words."""
    return np.fromiter(map(zlib.crc32, text.encode().split()), np.uint64)


def kmers(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of K codes; one hash of all codes if fewer."""
    if not len(codes):
        return np.empty(0, np.uint64)
    k = min(K, len(codes))
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ codes[i:len(codes) - k + 1 + i]) * _MIX
            h ^= h >> np.uint64(31)
    return h


def _in_order(h: np.ndarray) -> list[np.ndarray]:
    """The distinct k-mers by first occurrence and, if some occur again, by last occurrence."""
    first = h[np.sort(np.unique(h, return_index=True)[1])]
    if len(first) == len(h):
        return [first]
    back = h[::-1]
    return [first, back[np.sort(np.unique(back, return_index=True)[1])][::-1]]


def _sketch(x: np.ndarray) -> np.ndarray:
    """Order-MinHash sketches (SKETCHES hashes) of distinct k-mers in their order."""
    picks = min(PICKS, len(x))
    out = np.empty(SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, SKETCHES, 8):
            y = x[None, :] * _SEEDS[lo:lo + 8, None]
            y ^= y >> np.uint64(32)
            y *= _MIX
            at = np.sort(np.argpartition(y, picks - 1, axis=1)[:, :picks], axis=1) if picks < len(x) else \
                np.broadcast_to(np.arange(len(x)), (len(y), len(x)))
            chosen = x[at]  # in text order
            h = _SEEDS[lo:lo + 8].copy()
            for i in range(picks):
                h = (h ^ chosen[:, i]) * _MIX
                h ^= h >> np.uint64(29)
            out[lo:lo + 8] = h
    return out


def sketches(codes: np.ndarray) -> np.ndarray:
    """Sketches of a word sequence, each once."""
    found = [_sketch(x) for x in _in_order(kmers(codes))]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _slide(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the run of equal words from a[i], b[j]."""
    n, step, start = min(len(a) - i, len(b) - j), 16, 0
    while start < n:
        stop = min(n, start + step)
        differ = a[i + start:i + stop] != b[j + start:j + stop]
        k = int(differ.argmax())
        if differ[k]:
            return start + k
        start, step = stop, step * 4
    return n


def matched_runs(a: np.ndarray, b: np.ndarray, max_edits: int) -> list[tuple[int, int, int]] | None:
    """Runs (i, j, length) of equal words of a cheapest alignment; None: more than max_edits edits."""
    goal = len(b) - len(a)
    reach: list[dict[int, tuple[int, int]]] = []  # per number of edits: diagonal -> (end in a, run before it)
    for d in range(max_edits + 1):
        now: dict[int, tuple[int, int]] = {}
        before = reach[-1] if reach else {}
        # a diagonal further than the edits left from the goal cannot come back: the band
        left = max_edits - d
        for k in range(max(-d, goal - left), min(d, goal + left) + 1):
            if d == 0:
                i = 0
            else:
                i = max(before[k][0] + 1 if k in before else -1,
                        before[k - 1][0] if k - 1 in before else -1,
                        before[k + 1][0] + 1 if k + 1 in before else -1)
                i = min(i, len(a), len(b) - k)
                if i < 0 or i + k < 0:
                    continue
            run = _slide(a, b, i, i + k)
            now[k] = (i + run, run)
        reach.append(now)
        if goal in now and now[goal][0] == len(a):
            break
    else:
        return None
    runs, k = [], goal
    for d in range(len(reach) - 1, -1, -1):
        end, run = reach[d][k]
        i = end - run
        if run:
            runs.append((i, i + k, run))
        if d:
            before = reach[d - 1]
            for back, step in ((k, 1), (k - 1, 0), (k + 1, 1)):
                if back in before and min(before[back][0] + step, len(a), len(b) - k) == i:
                    k = back
                    break
    return runs


def similarity(a: list[bytes], b: list[bytes], least: float = SIMILARITY) -> float:
    """Distinct k-mers in matched runs of the alignment over all distinct k-mers; 0 if surely under ``least``."""
    code: dict[bytes, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a], np.uint64)
    y = np.array([code.setdefault(w, len(code)) for w in b], np.uint64)
    if len(x) == len(y) and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    kx, ky = kmers(x), kmers(y)
    ux, uy = set(kx.tolist()), set(ky.tolist())
    both, all_ = len(ux & uy), len(ux | uy)
    if both < least * all_:  # the alignment cannot find more than the k-mers in common
        return 0.0
    # an edit breaks K k-mers at most: more edits than broken k-mers cannot be
    broken = int((~np.isin(kx, ky)).sum() + (~np.isin(ky, kx)).sum())
    runs = matched_runs(x, y, max(abs(len(x) - len(y)), broken) + 2 * K)
    if runs is None:
        return 0.0
    k = min(K, len(x), len(y))
    found: set[int] = set()
    for i, _, n in runs:
        if n >= k:
            found.update(kx[i:i + n - k + 1].tolist())
    return len(found & ux & uy) / all_


def _sketched(docs: DataFrame, least: float) -> DataFrame:
    """(doc, doc_id, copy, sketches, short) of (doc, doc_id, copy, text); short: the distinct k-mers, if few."""
    most = int(SHORT / least + 1e-9)
    none = np.empty(0, np.int64)

    def few(codes: np.ndarray) -> np.ndarray:
        x = np.unique(kmers(codes))
        return x.view(np.int64) if len(x) <= most else none

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(sketches(c).view(np.int64), few(c)) if len(c) else (none, none) for c in map(word_codes, pdf.text)]
            yield pdf[["doc", "doc_id", "copy"]].assign(sketches=pd.Series([x[0] for x in found], dtype=object),
                                                        short=pd.Series([x[1] for x in found], dtype=object))

    return docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc long, doc_id string, copy string, sketches array<long>, short array<long>").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def _rare(sketched: DataFrame, least: float) -> DataFrame:
    """(doc, key): of the n k-mers of a text of few, the n - ceil(least * n) + 1 rarest, as far as another text has them."""
    flat = sketched.select("doc", F.size("short").alias("n"), F.explode("short").alias("kmer"))
    often = flat.groupBy("kmer").agg(F.count("*").alias("f")).where("f > 1")
    own = flat.join(often, "kmer").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("f", "kmer"))).alias("s"))
    # the k-mers of one text only are the rarest; they come before those in s
    take = F.size("s") + 1 - F.ceil(F.col("n") * least - 1e-9).cast("int")
    return own.select("doc", F.explode(F.slice("s", F.lit(1), F.greatest(take, F.lit(0)))).alias("k")).select(
        "doc", F.xxhash64(F.lit("rare"), "k.kmer").alias("key"))


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b): those at least ``least`` similar."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = [similarity(x.encode().split(), y.encode().split(), least) for x, y in zip(pdf.text_a, pdf.text_b)]
            pdf = pdf[["a", "b"]].assign(similarity=s)
            yield pdf[pdf.similarity >= least]

    a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similarity double")


def _kmer_sets(docs: DataFrame) -> DataFrame:
    """(doc, kmers) of (doc, text): distinct k-mers as 32-bit hashes."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sets = [np.unique((kmers(word_codes(t)) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in pdf.text]
            yield pd.DataFrame({"doc": pdf.doc, "kmers": pd.Series(sets, dtype=object)})

    return docs.mapInPandas(run, "doc long, kmers array<int>")


def _incidence(sets: list[np.ndarray], names: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Documents x k-mers names[lo:hi], 1 where a document has the k-mer."""
    out = np.zeros((len(sets), hi - lo), np.float32)
    for i, x in enumerate(sets):
        own = x[np.isin(x, names[lo:hi], assume_unique=True)]
        out[i, np.searchsorted(names[lo:hi], own)] = 1
    return out


def _across(docs: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, jaccard) of all pairs of a group (grp, doc, cls, kmers) in different classes, of least or more."""
    n = F.size("kmers")
    per_class = docs.groupBy("grp", "cls").agg(F.sum(n).alias("n"))
    main = per_class.groupBy("grp").agg(F.max(F.struct("n", "cls"))["cls"].alias("m_cls"), F.max("n").alias("m"),
                                        F.sum("n").alias("all_n"))
    main = main.select("grp", "m_cls", F.ceil(F.col("m") / block).alias("m_blocks"),
                       F.greatest(F.lit(1), F.ceil((F.col("all_n") - F.col("m")) / block)).alias("blocks"))
    d = docs.join(written(main, "near-blocks"), "grp")
    big = F.col("cls") == F.col("m_cls")
    own = F.when(big, F.col("blocks") + F.pmod(F.xxhash64("doc"), F.col("m_blocks"))).otherwise(
        F.pmod(F.xxhash64("doc"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.when(big, F.col("blocks")).otherwise(F.col("blocks") + F.col("m_blocks")) - 1)
    d = d.withColumn("own", own).withColumn("other", F.explode(others)).select(
        "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "cls", "kmers")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.own == pdf.lo], pdf[pdf.own == pdf.hi]
        cols = {"a": [], "b": [], "jaccard": []}
        if len(x) and len(y):
            sx, sy = list(x.kmers), list(y.kmers)
            names = np.intersect1d(np.concatenate(sx), np.concatenate(sy))
            both = np.zeros((len(sx), len(sy)), np.float32)
            for lo in range(0, len(names), 4096):
                hi = min(len(names), lo + 4096)
                both += _incidence(sx, names, lo, hi) @ _incidence(sy, names, lo, hi).T
            nx, ny = np.array([len(k) for k in sx]), np.array([len(k) for k in sy])
            jaccard = both / (nx[:, None] + ny[None, :] - both)
            ok = (jaccard >= least - 1e-6) & (x.cls.to_numpy()[:, None] != y.cls.to_numpy()[None, :])
            i, j = np.nonzero(ok)
            a, b = x.doc.to_numpy()[i], y.doc.to_numpy()[j]
            cols = {"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": jaccard[i, j].astype(float)}
        return pd.DataFrame(cols).drop_duplicates(["a", "b"])

    return d.groupBy("grp", "lo", "hi").applyInPandas(compare, "a long, b long, jaccard double")


def components(links: DataFrame) -> DataFrame:
    """(doc, cls): the smallest doc that links reach, for the docs that occur in links (a, b).

    Every round hooks a root to the smallest root beside it and then jumps
    pointers once; written after each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("cls")), "labels")
    while True:
        near = both.join(label.select(F.col("doc").alias("b"), F.col("cls").alias("other")), "b")
        best = near.groupBy(F.col("a").alias("doc")).agg(F.min("other").alias("best"))
        hooked = label.join(best, "doc").select("doc", "cls", F.least("cls", "best").alias("low"))
        # the class a doc had follows the smallest class any of its members sees
        root = hooked.groupBy(F.col("cls").alias("old")).agg(F.min("low").alias("root"))
        moved = hooked.join(root, F.col("cls") == F.col("old")).select(
            "doc", "cls", F.least("low", "root").alias("new"))
        jump = moved.select(F.col("doc").alias("j_doc"), F.col("new").alias("j_new"))
        jumped = moved.join(jump, F.col("new") == F.col("j_doc"), "left").select(
            "doc", "cls", F.least("new", F.coalesce("j_new", "new")).alias("now"))
        out = written(jumped, "labels")
        label = out.select("doc", F.col("now").alias("cls"))
        if out.where("cls <> now").isEmpty():
            return label


def _classes_of(docs: DataFrame, links: DataFrame) -> DataFrame:
    return written(docs.join(components(links), "doc", "left").select("doc", F.coalesce("cls", "doc").alias("cls")), "near-cls")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
                 row_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, class_id, kept) of every row; class_id is the smallest doc_id of the class.

    Of a class the row with the smallest doc_id is kept (null ids last, of
    repeated ids the first row). ``row_col`` names stored row ids, if docs has them.
    """
    normal = F.btrim(F.regexp_replace(whole(text_col), SPACE, " "), F.lit(" "))
    docs, row_col = (docs, row_col) if row_col else (placed(docs, "near-input", "__own_row"), "__own_row")
    base = docs.select(F.col(row_col).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), normal.alias("text"))
    marked = written(_sketched(base.withColumn("copy", F.sha2("text", 256)), least), "near-sketches")
    rows = marked.select(F.col("doc").alias("row_id"), "doc_id", "copy")
    # the first row of each group of copies stands for it; rows are numbered in table order
    groups = rows.groupBy("copy").agg(F.min("row_id").alias("doc"), F.count("*").alias("n"))
    groups = written(groups, "near-groups")
    sketched = written(marked.join(groups.select("doc"), "doc", "left_semi").select("doc", "sketches", "short"), "near-distinct")
    rare = written(_rare(sketched, least), "near-rare")
    keys = sketched.select("doc", F.explode("sketches").alias("key")).unionByName(rare)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.select("doc", "key").join(shared, "key"), "near-members")
    # the member with the largest buckets leads: the buckets of one group then have few leaders
    weight = members.groupBy("doc").agg(F.sum("n").alias("weight"))
    leads = members.join(weight, "doc").groupBy("key").agg(F.max(F.struct("weight", "doc"))["doc"].alias("lead"))
    candidates = members.select("doc").distinct()
    texts = written(base.select("doc", "text").join(candidates, "doc", "left_semi"), "near-texts")
    marks = sketched.join(candidates, "doc", "left_semi")

    # each member of a bucket meets the bucket's leader
    star = written(members.join(leads, "key").where("doc <> lead").select(
        F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b")).distinct(), "near-star")
    agree = F.size(F.array_intersect("sa", "sb"))
    few = (F.size("ka") > 0) & (F.size("kb") > 0)
    alike = F.size(F.array_intersect("ka", "kb")) >= least * F.size(F.array_union("ka", "kb")) - 1e-6
    likely = star.join(marks.select(F.col("doc").alias("a"), F.col("sketches").alias("sa"), F.col("short").alias("ka")), "a").join(
        marks.select(F.col("doc").alias("b"), F.col("sketches").alias("sb"), F.col("short").alias("kb")), "b").where(
        F.when(few, alike).otherwise(agree >= MIN_AGREE)).select("a", "b")
    links = tested = written(_aligned(likely, texts, least), "near-links").select("a", "b")
    cls = _classes_of(candidates, links)
    # groups that buckets connect and that hold several classes
    grp = components(star).select("doc", F.col("cls").alias("grp"))
    grouped = written(grp.join(cls, "doc"), "near-placed")
    still = grouped.groupBy("grp").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("grp")
    grouped = grouped.join(still, "grp")
    sets = written(_kmer_sets(texts.join(grouped.select("doc"), "doc", "left_semi")), "near-kmers")
    across = written(_across(grouped.join(sets, "doc"), least, BLOCK), "near-across")
    while True:
        named = across.join(cls.select(F.col("doc").alias("a"), F.col("cls").alias("ca")), "a").join(
            cls.select(F.col("doc").alias("b"), F.col("cls").alias("cb")), "b").where("ca <> cb")
        named = named.join(tested, ["a", "b"], "left_anti")
        best = named.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(
            F.max(F.struct("jaccard", "a", "b")).alias("w"))
        pairs = written(best.select("w.a", "w.b"), "near-pairs")
        if pairs.isEmpty():
            break
        tested = tested.unionByName(pairs)
        found = written(_aligned(pairs, texts, least), "near-links").select("a", "b")
        if not found.isEmpty():
            links = links.unionByName(found)
            cls = _classes_of(candidates, links)
    groups = groups.join(cls, "doc", "left").select("copy", F.coalesce("cls", "doc").alias("cls"))
    named = rows.join(groups, "copy").select("row_id", "doc_id", "cls")
    first = named.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("w"),
                                     F.count("*").alias("class_size"))
    first = first.select("cls", F.col("w.doc_id").alias("class_id"), F.col("w.row_id").alias("win_row"), "class_size")
    return written(named, "near-named").join(first, "cls").select(
        "row_id", "doc_id", "class_id", "class_size", (F.col("row_id") == F.col("win_row")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row per class, all columns."""
    docs = placed(docs, "near-input", "__own_row")
    kept = near_classes(docs, id_col, text_col, least, "__own_row").where("kept").select(F.col("row_id").alias("__kept_row"))
    return docs.join(kept, F.col("__own_row") == F.col("__kept_row"), "left_semi").drop("__own_row")
