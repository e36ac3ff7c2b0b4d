"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps tokens to symbols with weights: insult (stems and
words learned from labelled rows), threat, target, negation and reported
speech (short fixed lists), clause end; all else is dropped. Two small
transducers run after it: one marks what stands in the scope of a negation
or a report, one marks what is aimed at a target. Their composition is a
table that a text's symbols run through, clause by clause; the weights of
what it emits (plain, aimed, negated, reported insults and threats) are the
features of a logistic score.

Stems are prefixes of 3 to 8 letters and whole words of ``MIN_ROWS`` toxic
rows at least whose log odds among toxic rows are raised by ``MIN_ODDS`` at
least, two standard errors off. At most ``FIT_ROWS`` labelled rows (by hash)
are used, and all of them twice, by cross-fitting: they are dealt to ``FOLDS``
folds, the features of a fold come from a lexicon of the other folds, so that
accidental stems get no credit, and the logistic weights are fitted on the
features of all folds. The final lexicon is that of all rows.

Defined results: labels other than 0 and 1 count as no label; null and empty texts have no clause and get the score of
the intercept; with no labelled row the score is 0; repeated rows are
treated alike, of repeated labels of a document the highest counts; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import whole, written

FIT_ROWS = 20_000
FOLDS = 5
MIN_ROWS = 5
MIN_ODDS = 2.0
CUT = 0.3
CACHE_TOKENS = 200_000
SCOPE = 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# fixed word lists in four languages
WORDS = {
    THREAT: "kill hurt destroy punch stab burn shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes",
    NEGATION: "not no never nobody isn't aren't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says told called wrote quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
EMITS = ("insult", "aimed", "negated", "reported", "threat", "aimed_threat")
FEATURES = ("intercept", *EMITS, "strongest", "density", "clauses")
_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def compose(first: dict, second: dict, symbols) -> dict:
    """Composition of two deterministic transducers {(state, symbol): (state, emitted)} over ``symbols``; states pair up."""
    states, todo, out = {(0, 0)}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for s in symbols:
            p2, mid = first[p, s]
            q2, emitted = second[q, mid]
            out[(p, q), s] = ((p2, q2), emitted)
            if (p2, q2) not in states:
                states.add((p2, q2))
                todo.append((p2, q2))
    return out


def grammar() -> dict:
    """(state, symbol) -> (state, emitted) of scope and aim composed; emitted: (what, flag) or None."""
    # scope: 0 plain, 1..SCOPE symbols after a negation, -1 reported to the end of the clause
    scope = {}
    for state in (-1, *range(SCOPE + 1)):
        for s in range(7):
            if s == END:
                scope[state, s] = (0, (END, ""))
            elif s == REPORT:
                scope[state, s] = (-1, (s, ""))
            elif state == -1:
                scope[state, s] = (-1, (s, "reported"))
            elif s == NEGATION:
                scope[state, s] = (1, (s, ""))
            else:
                scope[state, s] = ((state + 1) % (SCOPE + 1) if state else 0, (s, "negated" if state else ""))
    aim = {}
    for state in (0, 1):  # 1: a target was named in this clause
        for s in range(7):
            for flag in ("", "negated", "reported"):
                now = 0 if s == END else 1 if s == TARGET else state
                what = None
                if s == INSULT:
                    what = flag or ("aimed" if state else "insult")
                elif s == THREAT:
                    what = flag or ("aimed_threat" if state else "threat")
                aim[state, (s, flag)] = (now, what)
    table = compose(scope, aim, range(7))
    number = {s: k for k, s in enumerate(sorted({s for s, _ in table}, key=lambda x: x != (0, 0)))}
    return {(number[s], c): (number[t], e) for (s, c), (t, e) in table.items()}


def stems(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in range(3, min(8, len(word)) + 1))]


class Scorer:
    """Runs texts through the lexical transducer and the grammar."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.grammar = lexicon, grammar()
        self.fixed = {w: s for s, ws in WORDS.items() for w in ws.split()}
        self.cache: dict[str, tuple | None] = {}

    def token(self, raw: str):
        """(symbol, weight, ends clause) of a token; None: nothing."""
        word = _STRIP.sub("", raw)
        end = raw[-1] in ".!?;:,"
        weight = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0
        symbol = INSULT if weight > 0 else self.fixed.get(word, OTHER)
        out = None if symbol == OTHER and not end else (symbol, weight or 1.0, end)
        if len(self.cache) >= CACHE_TOKENS:
            self.cache.clear()
        self.cache[raw] = out
        return out

    def features(self, text: str) -> list[float]:
        sums, strongest, hit_clauses, state, hit = dict.fromkeys(EMITS, 0.0), 0.0, 0, 0, False
        cache, tokens = self.cache, text.lower().split()
        for raw in tokens:
            try:
                t = cache[raw]
            except KeyError:
                t = self.token(raw)
            if t is None:
                continue
            symbol, weight, end = t
            if symbol:
                state, emitted = self.grammar[state, symbol]
                if emitted:
                    sums[emitted] += weight
                    strongest = max(strongest, weight if symbol == INSULT else 0.0)
                    hit = True
            if end:
                state, _ = self.grammar[state, END]
                hit_clauses += hit
                hit = False
        hit_clauses += hit
        insults = sums["insult"] + sums["aimed"] + sums["negated"] + sums["reported"]
        return [1.0, *(np.log1p(sums[e]) for e in EMITS), strongest,
                np.log1p(100 * insults / max(20, len(tokens))), np.log1p(hit_clauses)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weights by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], decay)
    shrink[0] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def lexicon_of(stems_: list[tuple[str, int, int]], no: int, yes: int) -> dict[str, float]:
    """Weights of the stems (stem, rows without, rows with the label) that tell, of ``no`` and ``yes`` rows."""
    out, rows = {}, {}
    for stem, n, y in stems_:
        odds = np.log((y + 0.5) / (yes + 1)) - np.log((n + 0.5) / (no + 1))
        if y >= MIN_ROWS and odds - 2 * np.sqrt(1 / (y + 0.5) + 1 / (n + 0.5)) >= MIN_ODDS:
            out[stem], rows[stem] = float(odds), y
    # a prefix that one longer telling stem explains says no more than that one
    longer: Counter = Counter()
    for stem, k in rows.items():
        for cut in range(3, len(stem)):
            longer[stem[:cut]] = max(longer[stem[:cut]], k)
    return {stem: odds for stem, odds in out.items() if longer[stem] < 0.9 * rows[stem]}


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> tuple[dict[str, float], np.ndarray | None]:
    """(lexicon, logistic weights) of the labelled rows where ``train`` holds."""
    own = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    # at most fit_rows ids and labels: a bounded side
    chosen = own.withColumn("h", F.xxhash64(F.col("l_id"), F.lit(5))).orderBy("h", "l_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("l_id")).select("text", "y", F.pmod("h", F.lit(folds)).cast("int").alias("fold"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(Counter(), Counter()) for _ in range(folds)]
        for pdf in it:
            for text, y, fold in zip(pdf.text, pdf.y, pdf.fold):
                words = {_STRIP.sub("", t) for t in set(text.lower().split())}
                seen[fold][y].update({s for w in words if w for s in stems(w)})
                seen[fold][y]["#rows"] += 1
        for fold, (no, yes) in enumerate(seen):
            keys = list(no.keys() | yes.keys())
            for lo in range(0, len(keys), 100_000):
                part = keys[lo:lo + 100_000]
                yield pd.DataFrame({"stem": part, "fold": fold, "no": [no[k] for k in part], "yes": [yes[k] for k in part]})

    counts = rows.mapInPandas(count, "stem string, fold int, no long, yes long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("no", "yes") for k in range(folds)]
    counts = counts.groupBy("stem").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"), *by_fold)
    total = written(counts.where((F.col("yes") >= MIN_ROWS) | (F.col("stem") == "#rows")), "toxicity-stems")
    sums = total.where("stem = '#rows'").first()
    if sums is None:
        return {}, None

    def tells(no: Column, yes: Column, n_no: int, n_yes: int) -> Column:
        odds = F.log((yes + 0.5) / (n_yes + 1)) - F.log((no + 0.5) / (n_no + 1))
        return (yes >= MIN_ROWS) & (odds - 2 * F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)) >= MIN_ODDS - 1e-9)

    some = tells(F.col("no"), F.col("yes"), sums.no, sums.yes)
    for k in range(folds):
        some = some | tells(F.col("no") - F.col(f"no{k}"), F.col("yes") - F.col(f"yes{k}"), sums.no - sums[f"no{k}"],
                            sums.yes - sums[f"yes{k}"])
    got = total.where((F.col("stem") != "#rows") & some).collect()  # stems that tell, of at most fit_rows rows
    lexicon = lexicon_of([(r.stem, r.no, r.yes) for r in got], sums.no, sums.yes)
    left = [lexicon_of([(r.stem, r.no - r[f"no{k}"], r.yes - r[f"yes{k}"]) for r in got], sums.no - sums[f"no{k}"],
                       sums.yes - sums[f"yes{k}"]) for k in range(folds)]

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(x) for x in left]
        for pdf in it:
            yield pd.DataFrame({"x": [scorers[k].features(t) for t, k in zip(pdf.text, pdf.fold)], "y": pdf.y})

    # at most fit_rows short feature vectors
    got = rows.mapInPandas(measure, "x array<double>, y int").toPandas()
    return lexicon, logistic(np.array(got.x.tolist()), got.y.to_numpy("float64"))


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for pdf in it:
            x = [scorer.features(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": (
                sigmoid(np.array(x) @ weights) if len(x) and weights is not None else np.zeros(len(x)))})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
