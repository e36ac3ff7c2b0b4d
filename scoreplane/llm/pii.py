"""Personal data: base patterns plus a semi-Markov conditional random field.

Base spans (e-mail, IP, card, phone) come from fixed patterns and always
stay. The semi-Markov model segments windows around digits and at-signs
(the two words before, up to ``BEFORE`` characters, the rest of the word, up
to ``WORD``, and the next one, up to ``AFTER``; windows that touch are one).
Every segment of at most ``MAX_TOKENS`` tokens is scored as a whole (shape,
digit count, check sum, separators, signs, cue words before it) for each
kind, and a dynamic program over token positions, bounded by that length,
picks boundaries and kinds together. A segment holds one at-sign or, without
any, at most ``MAX_DIGITS`` digits: no kind has more. The program holds a
score for each position and the segments that begin at one, so its memory
grows with the window's tokens, not with its segments. Segments that touch
no base span are added.

The weights are fitted by gradient ascent on the conditional likelihood
(forward and backward sums over segmentations) of at most ``FIT_WINDOWS``
windows of the corpus, chosen by hash. Base spans are their labels; each
window is also shown with its spans written another way (a phone without
its country code, an address with [at] and [dot]), so that such forms are
learned.

Every pattern runs in time linear in the text. Defined results: a null text
is empty and has no span; spans are in code points; repeated rows are
treated alike; an empty table gives an empty result (the model then has
weight 0 and adds nothing); extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
MAX_DIGITS = 19
BEFORE, WORD, AFTER = 80, 200, 40
FIT_CHARS = 400
FIT_WINDOWS = 300
EPOCHS = 60
RATE = 0.5
DECAY = 1e-3
MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match can begin inside a run of digits whose first digit does not begin one
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S", re.ASCII)
_TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")
_AT = re.compile(r"@|\[at\]|\(at\)")
_CUE = {"email": re.compile(r"(?i)(e-?mail|mail|contact|write)\W*$"), "ip": re.compile(r"(?i)\b(ip|host|server|addr\w*)\W*$"),
        "card": re.compile(r"(?i)(card|visa|mastercard|payment)\W*$"),
        "phone": re.compile(r"(?i)(tel|phone|call|mobile|fax|whatsapp)\W*$")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start, then kind."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def windows(text: str) -> Iterator[tuple[int, str]]:
    """(start, window): triggers with the two words before them, to the end of the word after the last one."""
    start = stop = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < stop:
            continue
        lo, hi = m.start(), m.end()
        for _ in range(3):
            while lo > 0 and not text[lo - 1].isspace() and m.start() - lo < BEFORE:
                lo -= 1
            while lo > 0 and text[lo - 1].isspace() and m.start() - lo < BEFORE:
                lo -= 1
        while hi < len(text) and (not text[hi].isspace()) and hi - m.end() < WORD:
            hi += 1
        more = hi
        while more < len(text) and text[more] == " ":
            more += 1
        while more < len(text) and not text[more].isspace() and more - hi < AFTER:
            more += 1
        if start >= 0 and lo <= stop:
            stop = max(stop, more)
            continue
        if start >= 0:
            yield start, text[start:stop]
        start, stop = lo, more
    if start >= 0:
        yield start, text[start:stop]


def cues(w: str, a: int) -> list[int]:
    """Indices of the features of the words before position a."""
    before = w[max(0, a - 24):a]
    return [N_TESTS + k for k, kind in enumerate(KINDS) if _CUE[kind].search(before)]


def features(w: str, a: int, b: int) -> list[int] | None:
    """Indices of the whole-span features of w[a:b], less its cues; None if it cannot be a span."""
    s = w[a:b]
    n = sum(map(s.count, "0123456789"))
    at = "@" in s or "[at]" in s or "(at)" in s
    if not (at or n >= 7) or not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        return None
    plain = not _OTHER.search(s)
    parts = s.split(".") if s.count(".") == 3 else ()
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    glued = (a > 0 and (w[a - 1].isalnum() or w[a - 1] in "_=+")) or (b < len(w) and (w[b].isalnum() or w[b] in "_@="))
    card = plain and 12 <= n <= 19
    valid = card and luhn("".join(c for c in s if "0" <= c <= "9"))
    ten = plain and n == 10
    tests = (
        True, "@" in s, at and ("[at]" in s or "(at)" in s), not plain and bool(_ENDS.search(s)),
        not plain and bool(_DOT_ENDS.search(s)), " " in s and at and "[" not in s and "(" not in s,
        at and bool(_ADDRESS.match(s)), octets, len(parts) == 4 and plain,
        card, valid, card and not valid,
        s[0] == "+", s[0] == "+" and 9 <= n <= 15, ten and bool(_BRACKETS.match(s)),
        ten and bool(_GROUPS.match(s)), ten, plain and n < 9, n > 19, not plain and not at,
        glued, b < len(w) and w[b] in "-." and b + 1 < len(w) and w[b + 1].isalnum(), "  " in s, s.isdigit(),
    )
    return [k for k, t in enumerate(tests) if t]


_OTHER = re.compile(r"[^0-9 ().+-]")
_ENDS = re.compile(r"\.[A-Za-z]{2,}$")
_DOT_ENDS = re.compile(r"(\[dot\]|\(dot\))\s?[A-Za-z]{2,}$")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+\s?(@|\[at\]|\(at\))")
_BRACKETS = re.compile(r"\(\d{3}\) ?\d{3}[ .-]\d{4}$")
_GROUPS = re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}$")
N_TESTS = 24
N_FEATURES = N_TESTS + len(KINDS)


def starts(w: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """For each token that candidate segments begin with: its number, and (token after, feature indices) of each."""
    signs = [m.start() for m in _AT.finditer(w)] + [len(w) + 1] * 2
    k = 0
    for i, (a, _) in enumerate(tokens):
        while signs[k] < a:
            k += 1
        if not (w[a].isalnum() or w[a] in "+("):
            continue
        last = min(len(tokens), i + MAX_TOKENS)
        near = signs[k] <= tokens[last - 1][1]  # an address is within reach
        out, plain, digits, cue = [], True, 0, None
        for j in range(i, last):
            lo, hi = tokens[j]
            if lo >= signs[k + 1]:
                break
            plain = plain and w[lo] in "0123456789().+-"
            digits += hi - lo if "0" <= w[lo] <= "9" else 0
            alone = hi <= signs[k]
            # neither digits and signs only, nor an address within reach
            if not near and (not plain or digits > MAX_DIGITS):
                break
            if alone and (not plain or not 7 <= digits <= MAX_DIGITS):
                continue
            if (f := features(w, a, hi)) is not None:
                cue = cues(w, a) if cue is None else cue
                out.append((j + 1, f + cue))
        if out:
            yield i, out


def segments(w: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Tokens of a window, and its candidate segments (first token, token after, feature indices)."""
    tokens = [m.span() for m in _TOKEN.finditer(w)]
    return tokens, [(i, j, f) for i, out in starts(w, tokens) for j, f in out]


def decode(w: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation: (start, kind, end) of the segments that are entities."""
    tokens = [m.span() for m in _TOKEN.finditer(w)]
    table = weights.T.tolist()
    kinds = range(len(KINDS))
    best, back = array("d", [0.0]) * (len(tokens) + 1), {}
    ahead: dict[int, tuple[float, int, int]] = {}  # best segment that ends at a token after the current one
    done = 0

    def settle(upto: int) -> None:
        nonlocal done
        while done < upto:
            done += 1
            best[done] = best[done - 1]
            if (got := ahead.pop(done, None)) is not None and got[0] > best[done]:
                best[done], back[done] = got[0], got[1:]

    for i, out in starts(w, tokens):
        settle(i)
        for j, f in out:
            of = [sum(table[x][kind] for x in f) for kind in kinds]
            kind = max(kinds, key=of.__getitem__)
            s = best[i] + of[kind] - MARGIN
            if j not in ahead or s > ahead[j][0]:
                ahead[j] = (s, i, kind)
    settle(len(tokens))
    found, j = [], len(tokens)
    while j:
        if j not in back:
            j -= 1
            continue
        i, kind = back[j]
        found.append((tokens[i][0], kind, tokens[j - 1][1]))
        j = i
    return found[::-1]


def added(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The field's spans of a text that touch none of its base spans (in order of their starts)."""
    begin, reach = [a for a, _, _ in base], []
    for _, _, b in base:
        reach.append(max(b, reach[-1]) if reach else b)
    out = []
    for start, w in windows(text):
        for a, kind, b in decode(w, weights):
            before = bisect_left(begin, b + start)  # base spans that begin before its end
            if not before or reach[before - 1] <= a + start:
                out.append((a + start, kind, b + start))
    return out


def _rewritten(w: str, spans) -> tuple[str, list]:
    """The window with its spans written another way, and those spans."""
    out, at, gold = "", 0, []
    for a, kind, b in spans:
        if a < at:
            continue
        s = w[a:b]
        if kind == 0:
            s = s.replace("@", " [at] ", 1)
            s = " [dot] ".join(s.rsplit(".", 1))
        elif kind == 3:
            s = re.sub(r"^\+[0-9]{1,3} ", "", s)
        out += w[at:a]
        gold.append((len(out), kind, len(out) + len(s)))
        out, at = out + s, b
    return out + w[at:], gold


def fit(samples: list[str]) -> np.ndarray:
    """Weights (kinds x features) of the highest penalised likelihood of the windows' labels."""
    data = []
    for w in samples:
        gold = base_spans(w)
        for text, spans in ((w, gold), _rewritten(w, gold)) if gold else ((w, gold),):
            tokens, segs = segments(text)
            if segs:
                at = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j, _) in enumerate(segs)}
                y = [(at[a, b], kind) for a, kind, b in spans if (a, b) in at]
                # only positions where a segment begins or ends matter
                edges = {e: k for k, e in enumerate(sorted({0, len(tokens), *(e for i, j, _ in segs for e in (i, j))}))}
                ij = np.array([(edges[i], edges[j]) for i, j, _ in segs])
                into = [np.flatnonzero(ij[:, 1] == e) for e in range(len(edges))]
                from_ = [np.flatnonzero(ij[:, 0] == e) for e in range(len(edges))]
                x = np.zeros((len(segs), N_FEATURES), np.float32)
                for k, (_, _, f) in enumerate(segs):
                    x[k, f] = 1
                data.append((len(edges) - 1, ij, x, into, from_, y))
    weights, speed = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    for _ in range(EPOCHS if data else 0):
        grad = -DECAY * len(data) * weights
        for n, ij, x, into, from_, y in data:
            s = x @ weights.T
            seg = np.logaddexp.reduce(s, axis=1)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                k = into[j]
                ahead[j] = np.logaddexp.reduce(np.r_[ahead[j - 1], ahead[ij[k, 0]] + seg[k]]) if len(k) else ahead[j - 1]
            for j in range(n - 1, -1, -1):
                k = from_[j]
                behind[j] = np.logaddexp.reduce(np.r_[behind[j + 1], behind[ij[k, 1]] + seg[k]]) if len(k) else behind[j + 1]
            p = np.exp(ahead[ij[:, 0], None] + s + behind[ij[:, 1], None] - ahead[n])
            for k, kind in y:
                p[k, kind] -= 1
            grad -= p.T @ x
        speed += grad ** 2
        weights += RATE * grad / np.sqrt(speed)
    return weights


def fitted(docs: DataFrame, text_col: str = "text", fit_windows: int = FIT_WINDOWS) -> np.ndarray:
    """Weights from at most ``fit_windows`` windows, of at most ``FIT_CHARS`` characters, those with the smallest hashes."""
    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = {w for t in pdf.text for _, w in windows(t) if len(w) <= FIT_CHARS}
            rows = sorted((hashlib.md5(w.encode()).hexdigest(), w) for w in found)[:fit_windows]
            yield pd.DataFrame(rows, columns=["h", "w"])

    some = docs.select(whole(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    top = some.mapInPandas(cut, "h string, w string").distinct().orderBy("h").limit(fit_windows)
    return fit([r.w for r in top.collect()])


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """(doc_id, base array, added array) of every row: spans (kind, start, end, value)."""
    weights = fitted(docs, text_col, fit_windows)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for t in pdf.text:
                base = base_spans(t)
                out.append((base, added(t, base, weights)))
            show = lambda spans, t: [(KINDS[k], a, b, t[a:b]) for a, k, b in spans]
            yield pd.DataFrame({"doc_id": pdf.doc_id,
                                "base": [show(b, t) for (b, _), t in zip(out, pdf.text)],
                                "added": [show(m, t) for (_, m), t in zip(out, pdf.text)],
                                "base_text": [_join(b) for b, _ in out],
                                "spans": [_join(sorted(b + m)) for b, m in out]})

    span = "array<struct<kind:string,start:long,end:long,value:string>>"
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id string, base {span}, added {span}, base_text string, spans string").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """docs with every found span replaced by [kind]; same columns. Overlapping spans are masked as one, by the first."""
    weights = fitted(docs, text_col, fit_windows)
    schema = docs.schema

    def one(t):
        if t is None:
            return t
        base, out, at = base_spans(t), [], 0
        more = [(a + s, k, b + s) for s, w in windows(t) for a, k, b in decode(w, weights)]
        for a, k, b in sorted(base + more):
            if a >= at:
                out += [t[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    masked = F.pandas_udf(lambda s: s.map(one), "string")
    return docs.withColumn(text_col, masked(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in schema.names])
