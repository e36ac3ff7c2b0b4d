"""Language of whole texts and of their spans.

A word's letters lie in a script; only languages that use the script are
candidates for it. Each candidate scores the word by the log probabilities
of its letter trigrams (hashed to ``BUCKETS``, smoothed, less the mean over
the candidates). Viterbi decoding over the words with a penalty for every
switch labels spans of mixed text; a text's language is the one with most
letters in its spans.

Trigram counts come from at most about ``FIT_ROWS`` labelled texts per
language, chosen by hash; scripts from the same texts.

Defined results: null or letterless texts are ``und`` with score 0; ties go
to the language first by code point; a script that no learned language uses
says nothing about a word; with nothing learned all is ``und``; repeated
rows are treated alike; an empty table gives an empty result; extra columns
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import whole

BUCKETS = 1 << 15
FIT_ROWS = 3000
ALPHA = 0.1
PENALTY = 6.0
CACHE_WORDS = 200_000
# first and last code point of the ranges of common scripts
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF),
    ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(n for n, _, _ in SCRIPTS)) + ("other",)
_LETTERS = re.compile(r"[^\W\d_]+")


def script_of(letter: str) -> int:
    c = ord(letter)
    for name, lo, hi in SCRIPTS:
        if lo <= c <= hi:
            return SCRIPT_NAMES.index(name)
    return len(SCRIPT_NAMES) - 1


def words_of(text: str) -> list[str]:
    """Runs of letters; a number sign (a half sign, a circled one) is none."""
    words = _LETTERS.findall(text.lower())
    return words if "".join(words).isalpha() or not words else [w[a:b] for w in words for a, b in _alpha(w)]


def _alpha(word: str, at: int = 0) -> list[tuple[int, int]]:
    """Places of the runs of letters in a run of letters and number signs that begins at ``at``."""
    own = np.array([c.isalpha() for c in word])
    edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))) + at
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of every word with its edges marked, and where each word's begin."""
    x = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1]) * np.uint64(0x85EBCA77) + x[2:]
        h ^= h >> np.uint64(15)
        h = (h * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
    size = np.array([len(w) for w in words])
    first = np.r_[0, np.cumsum(size + 2)[:-1]]
    inside = np.ones(len(x), bool)
    inside[np.cumsum(size + 2) - 1] = False
    inside[np.cumsum(size + 2) - 2] = False
    return (h % np.uint64(BUCKETS)).astype(np.int64)[inside[:-2]], np.r_[0, np.cumsum(size)[:-1]]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: BUCKETS x languages; scripts: scripts x languages (letters)."""
        self.langs = langs
        c = counts + ALPHA
        self.log = np.log(c / c.sum(axis=0)).astype(np.float32) if langs else counts.astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=0))
        self.uses = share >= 0.01

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word by language; -1e4 where its script is not used."""
        buckets, first = trigrams(words)
        s = np.add.reduceat(self.log[buckets], first, axis=0)
        use = self.uses[[script_of(w[0]) for w in words]]
        known = use.any(axis=1, keepdims=True)
        n = np.maximum(1, use.sum(axis=1, keepdims=True))
        s = s - (s * use).sum(axis=1, keepdims=True) / n
        return np.where(known, np.where(use, s, -1e4), 0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels (texts x steps) of padded scores (steps x texts x languages); a switch costs ``penalty``."""
    steps, n, langs = scores.shape
    back = np.empty((steps, n, langs), np.int8 if langs < 128 else np.int16)
    v = scores[0].copy()
    own = np.arange(langs)
    for t in range(1, steps):
        top = v.argmax(axis=1)
        jump = np.take_along_axis(v, top[:, None], axis=1) - penalty
        switch = jump > v
        back[t] = np.where(switch, top[:, None], own)
        new = np.where(switch, jump, v) + scores[t]
        v = np.where((lengths > t)[:, None], new, v)
    out = np.zeros((n, steps), np.int16)
    state = v.argmax(axis=1)
    row = np.arange(n)
    for t in range(steps - 1, -1, -1):
        out[:, t] = state
        if t:
            state = np.where(lengths > t, back[t][row, state], state)
    return out


class Labeller:
    """Labels the words of texts; a bounded cache of word scores."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.langs)), np.float32)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._clear()
        new = list({w for t in texts for w in t if w not in self.index})
        if new:
            for w in new:
                self.index[w] = len(self.index)
            self.table = np.vstack([self.table, *(self.model.scores(new[i:i + 20_000]) for i in range(0, len(new), 20_000))])
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * max(1, len(texts[order[j]])) <= 400_000 and j - i < 512 \
                    and len(texts[order[j]]) <= 1.5 * len(texts[order[i]]) + 64:
                j += 1
            group = order[i:j]
            lengths = np.array([len(texts[k]) for k in group])
            s = np.zeros((max(1, int(lengths.max())), len(group), len(self.model.langs)), np.float32)
            for g, k in enumerate(group):
                if lengths[g]:
                    s[:lengths[g], g] = self.table[list(map(self.index.__getitem__, texts[k]))]
            labels = viterbi(s, lengths, self.penalty)
            for g, k in enumerate(group):
                out[k] = labels[g, :lengths[g]]
            i = j
        return out


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Model of the rows where ``train`` holds and the language is not null."""
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), whole(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / sizes[k]))]), F.col("lang"))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = {}
        for pdf in it:
            for lang, text in zip(pdf.lang, pdf.text):
                if w := words_of(text):
                    c = grams.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    c[:BUCKETS] += np.bincount(trigrams(w)[0], minlength=BUCKETS)
                    for x in w:
                        c[BUCKETS + script_of(x[0])] += len(x)
        for lang, c in grams.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "k": at, "n": c[at]})

    # at most BUCKETS and the scripts for each language
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    got = some.mapInPandas(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    at = {k: i for i, k in enumerate(langs)}
    counts[got.k.to_numpy("int64"), got.lang.map(at).to_numpy("int64")] = got.n.to_numpy("float64")
    return Model(langs, counts[:BUCKETS], counts[BUCKETS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are (start, end, lang) in code points of the lower-cased text."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller, langs = Labeller(model, penalty), model.langs
        for pdf in it:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo:lo + 1000]
                low = [t.lower() for t in part.text]
                found = [[m.span() for m in _LETTERS.finditer(t)] if langs else [] for t in low]
                texts = [[t[a:b] for a, b in f] for t, f in zip(low, found)]
                for k, words in enumerate(texts):
                    if words and not "".join(words).isalpha():
                        found[k] = [x for w, (a, _) in zip(words, found[k]) for x in _alpha(w, a)]
                        texts[k] = [low[k][a:b] for a, b in found[k]]
                labels = labeller.label(texts)
                pred, score, spans = [], [], []
                for f, lab in zip(found, labels):
                    if not len(f):
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    at = np.array(f)
                    letters = np.bincount(lab, weights=at[:, 1] - at[:, 0], minlength=len(langs))
                    pred.append(langs[int(letters.argmax())])
                    score.append(float(letters.max() / letters.sum()))
                    cut = np.flatnonzero(np.r_[True, lab[1:] != lab[:-1]])
                    stop = np.r_[cut[1:], len(lab)] - 1
                    spans.append([(int(at[a, 0]), int(at[b, 1]), langs[lab[a]]) for a, b in zip(cut, stop)])
                yield pd.DataFrame({"doc_id": part.doc_id, "lang_pred": pred, "score": score, "spans": spans})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double, "
                                 "spans array<struct<start:long,end:long,lang:string>>").withColumn(
        "doc_id", F.col("doc_id").cast("long"))
