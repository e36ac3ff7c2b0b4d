"""Boundary-aware phrase matching of texts against a term dictionary.

A term occurs in a text when it appears with no a-z letter directly before
or after it. Every maximal letter run of such an occurrence is then also a
maximal letter run (token) of the text, so the test is done per row with
no shuffle and no row explosion:

1. the text's letter-run tokens are intersected (hash based) with the
   dictionary's runs: one pass over the text;
2. a term that is a single letter run (``python``) occurs exactly when it is
   one of those tokens, so all such terms are found with one more hash
   intersection, in compiled code;
3. the remaining terms (``node.js``, ``c++``, ``802.11``, multi-word
   phrases) are indexed by their longest run (the anchor) in a literal map;
   only the terms of anchors present among the tokens are fetched, and each
   needs all its runs among the tokens, then a ``contains`` test and the
   bounded regex confirm it. Terms without letters are always tested.

Hits are arrays of term strings. The dictionary is a Python list that the
caller holds, inlined into the plan as literals; a dictionary that is a
table is joined instead (``operators.phrase_join``).
Functions here return Spark SQL expression text over column names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from scoreplane.functions.sqltext import sql_str, str_array
from scoreplane.functions.text import phrase_pattern

_RUN = re.compile(r"[a-z]+")
_EXACT = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Dictionary:
    terms: tuple[str, ...]

    @staticmethod
    def of(terms) -> "Dictionary":
        return Dictionary(tuple(dict.fromkeys(terms)))

    def tid(self, term: str) -> int:
        """Position of a term (used by the relational oracle form)."""
        return self.terms.index(term)

    def tids(self, terms) -> list[int]:
        return [self.tid(t) for t in terms]

    @property
    def exact_terms(self) -> list[str]:
        return [t for t in self.terms if _EXACT.fullmatch(t)]

    @property
    def other_terms(self) -> list[str]:
        return [t for t in self.terms if not _EXACT.fullmatch(t)]

    @property
    def runs(self) -> list[str]:
        return list(dict.fromkeys(r for t in self.terms for r in _RUN.findall(t)))

    def _other_struct(self, t: str) -> str:
        return (f"named_struct('term', {sql_str(t)}, 'runs', {str_array(_RUN.findall(t))}, "
                f"'pat', {sql_str(phrase_pattern(t))})")

    def anchored_sql(self) -> tuple[str, str, str]:
        """(anchor list, anchor -> terms map, letterless terms) as SQL literals."""
        by_anchor: dict[str, list[str]] = {}
        free: list[str] = []
        for t in self.other_terms:
            runs = _RUN.findall(t)
            if runs:
                by_anchor.setdefault(max(runs, key=len), []).append(t)
            else:
                free.append(t)
        empty = "CAST(array() AS array<struct<term:string,runs:array<string>,pat:string>>)"
        pairs = ", ".join(f"{sql_str(a)}, array({', '.join(self._other_struct(t) for t in ts)})"
                          for a, ts in by_anchor.items())
        amap = f"map({pairs})" if pairs else "map()"
        free_sql = f"array({', '.join(self._other_struct(t) for t in free)})" if free else empty
        return str_array(list(by_anchor)), amap, free_sql


def tokens_sql(text: str, d: Dictionary) -> str:
    """Distinct letter-run tokens of ``text`` that occur in some dictionary term."""
    return f"array_intersect({str_array(d.runs)}, split({text}, '[^a-z]+'))"


def term_hits_sql(text: str, toks: str, d: Dictionary) -> str:
    """array<string>: dictionary terms present in ``text``.

    ``toks`` names a column holding ``tokens_sql(text)`` computed in an
    earlier projection; it is referenced twice, which keeps Catalyst from
    inlining the tokenisation into the per-term lambda.
    """
    exact = f"array_intersect({str_array(d.exact_terms)}, {toks})"
    if not d.other_terms:
        return exact
    anchors, amap, free = d.anchored_sql()
    if anchors.startswith("CAST"):
        candidates = free
    else:
        candidates = (f"concat(flatten(transform(array_intersect({toks}, {anchors}), "
                      f"a -> element_at({amap}, a))), {free})")
    others = (f"transform(filter({candidates}, x -> "
              f"forall(x.runs, r -> array_contains({toks}, r)) "
              f"AND contains({text}, x.term) AND regexp({text}, x.pat)), x -> x.term)")
    return f"concat({exact}, {others})"


def hit_count_sql(hits: str, terms) -> str:
    """How many entries of ``terms`` (a list; repeated entries count again) are in ``hits``."""
    terms = list(terms)
    if not terms:
        return "0"
    mult = Counter(terms)
    distinct = list(mult)
    expr = f"size(array_intersect({str_array(distinct)}, {hits}))"
    for t, m in mult.items():
        if m > 1:
            expr += f" + IF(array_contains({hits}, {sql_str(t)}), {m - 1}, 0)"
    return f"({expr})"


def any_hit_sql(hits: str, terms) -> str:
    """Any of ``terms`` present."""
    terms = list(terms)
    if not terms:
        return "false"
    return f"arrays_overlap({hits}, {str_array(terms)})"
