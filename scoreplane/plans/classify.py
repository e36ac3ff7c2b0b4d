"""Rule-based domain classification of (title, description) pairs.

Normalise, apply ordered replacements, find dictionary terms, score every
domain, take the arg-max in rule order. There are two forms with the same
results; which one runs follows from what the caller holds, not from a size:

* a ``RuleSet`` of Python lists is inlined into the plan (``operators.
  textmatch``): map-only, one scan with no exchange;
* a keyword table is a DataFrame of any size, joined with the texts by
  position (``operators.phrase_join``): ``classify_table``, ``keyword_hits``
  and ``best_scores`` with ``keywords``, or ``method="join"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.sqltext import sql_str
from scoreplane.functions.text import fewer_words_than, normalize
from scoreplane.operators.phrase_join import phrase_hits
from scoreplane.operators.textmatch import (Dictionary, any_hit_sql, hit_count_sql,
                                            term_hits_sql, tokens_sql)
from scoreplane.rules import RuleSet
from scoreplane.session import checkpoint_dir


def dictionary_terms(rs: RuleSet) -> list[str]:
    """Every term the rules look for: keywords, boosts and the fixed phrases."""
    terms = [k for _, k in rs.keywords]
    for ts in rs.boosts.values():
        terms += ts
    terms += FV.FULLSTACK_TERMS + FV.STRONG_PHRASES + [p for p, _ in FV.TITLE_OVERRIDES]
    return list(dict.fromkeys(terms))


def dictionary_for(rs: RuleSet) -> Dictionary:
    return Dictionary.of(dictionary_terms(rs))


def _fold(col: Column, rs: RuleSet) -> Column:
    """H2: ordered replacements on an already normalised column."""
    for old, new in rs.replacements:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def normalized(c, rs: RuleSet) -> Column:
    """Step 1: lower + strip, then the ordered replacements (H1 + H2).

    A NULL text is treated as empty.
    """
    c = F.col(c) if isinstance(c, str) else c
    return _fold(normalize(F.coalesce(c, F.lit(""))), rs)


def _kw_terms(rs: RuleSet) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for dom, kw in rs.keywords:
        out.setdefault(dom, []).append(kw)
    return out


def _ranked_count_sql(hits: str, rank: int) -> str:
    """Keyword hits of the domain at ``rank`` in an array<struct<term, ranks>> (repeats count again)."""
    return f"aggregate({hits}, 0, (acc, x) -> acc + size(filter(x.ranks, k -> k = {rank})))"


def scores_sql(rs: RuleSet, d: Dictionary | None, th="_th", dh="_dh", both="_both", short="_short",
               ranked: bool = False) -> str:
    """array<struct<rank, domain, score>> in rule order.

    ``th``/``dh``/``both`` are arrays of hit terms. With ``ranked`` the
    per-domain keyword counts come from columns ``th + 'r'`` etc., arrays of
    struct<term, ranks> (the join form); otherwise from the keyword lists
    inlined into the expression.
    """
    kw = _kw_terms(rs)
    rank_of = {dom: i for i, dom in enumerate(rs.domains, start=1)}

    def count(hits: str, dom: str) -> str:
        if ranked:
            return _ranked_count_sql(hits + "r", rank_of[dom]) if dom in rank_of else "0"
        return hit_count_sql(hits, kw.get(dom, []))

    fs = any_hit_sql(both, FV.FULLSTACK_TERMS)
    fe, be = FV.COMBO_DOMAINS
    combo = (f"({count(both, fe)} >= {FV.COMBO_MIN_HITS} AND "
             f"{count(both, be)} >= {FV.COMBO_MIN_HITS})")
    penalise = f"({short} AND NOT {any_hit_sql(both, FV.STRONG_PHRASES)})"
    items = []
    for rank, dom in enumerate(rs.domains, start=1):
        w = float(rs.weights.get(dom, 0))
        t_hits, d_hits = count(th, dom), count(dh, dom)
        score = f"({t_hits} * {FV.TITLE_FACTOR} + {d_hits} * {FV.DESC_FACTOR}) * {w}"
        if dom == FV.FULLSTACK_DOMAIN:
            score += (f" + CASE WHEN {fs} THEN {FV.FULLSTACK_BONUS} ELSE 0 END"
                      f" + CASE WHEN {combo} THEN {FV.COMBO_BONUS} ELSE 0 END")
        btids = rs.boosts.get(dom, [])
        if btids:
            score += (f" + CASE WHEN {any_hit_sql(th, btids)} THEN {FV.BOOST_TITLE} ELSE 0 END"
                      f" + CASE WHEN {any_hit_sql(dh, btids)} THEN {FV.BOOST_DESC} ELSE 0 END")
        score = (f"CASE WHEN {penalise} THEN greatest(0.0D, CAST({score} AS DOUBLE) - "
                 f"{d_hits} * {w} * {FV.SHORT_DESC_PENALTY}) ELSE CAST({score} AS DOUBLE) END")
        items.append(f"named_struct('rank', {rank}, 'domain', {sql_str(dom)}, 'score', {score})")
    return f"array({', '.join(items)})"


def best_sql(d: Dictionary, scores="_scores", th="_th") -> str:
    """D13 + threshold + title overrides: first maximum in rule order."""
    best = (f"aggregate({scores}, named_struct('rank', 0, 'domain', {sql_str(FV.UNCLASSIFIED)}, "
            f"'score', -1.0D), (acc, x) -> IF(x.score > acc.score, x, acc))")
    overrides = " ".join(f"WHEN array_contains({th}, {sql_str(p)}) THEN {sql_str(lbl)}"
                         for p, lbl in FV.TITLE_OVERRIDES)
    return (f"CASE WHEN {best}.score >= {FV.MIN_SCORE} THEN (CASE {overrides} ELSE {best}.domain END) "
            f"ELSE {sql_str(FV.UNCLASSIFIED)} END")


def _hits(staged: DataFrame, keep: list[str], d: Dictionary) -> DataFrame:
    """Add _th/_dh term-id arrays for the normalised _t/_d columns (kept as columns)."""
    staged = staged.select(*keep, "_t", "_d", F.expr(tokens_sql("_t", d)).alias("_tt"),
                           F.expr(tokens_sql("_d", d)).alias("_dt"))
    return staged.select(*keep, "_t", "_d", F.expr(term_hits_sql("_t", "_tt", d)).alias("_th"),
                         F.expr(term_hits_sql("_d", "_dt", d)).alias("_dh"))


def classify(df: DataFrame, rs: RuleSet, title: str | Column = "job_title",
             desc: str | Column = "job_description", out: str = "kw_domain",
             keep: list[str] | None = None, with_score: bool = False,
             method: str = "inline", key: str | None = None) -> DataFrame:
    """Append the keyword label of each row.

    ``method``: ``inline`` (the dictionary as plan literals, map-only) or
    ``join`` (the dictionary as a DataFrame, joined by position). Both give
    the same labels. ``key`` names a unique row key for the join form (see
    ``_join_hits``).
    """
    keep = keep if keep is not None else list(df.columns)
    if method == "join":
        return _label(_join_scores(df, rs, title, desc, keep, key=key), keep, out, with_score)
    d = dictionary_for(rs)
    staged = _hits(df.select(*keep, normalized(title, rs).alias("_t"),
                             normalized(desc, rs).alias("_d")), keep, d)
    staged = staged.select(*keep, "_th", "_dh", F.array_union("_th", "_dh").alias("_both"),
                           fewer_words_than(F.col("_d"), FV.SHORT_DESC_WORDS).alias("_short"))
    staged = staged.select(*keep, "_th", F.expr(scores_sql(rs, d)).alias("_scores"))
    return _label(staged, keep, out, with_score)


def _label(staged: DataFrame, keep: list[str], out: str, with_score: bool) -> DataFrame:
    cols = [*keep, F.expr(best_sql(None)).alias(out)]
    if with_score:
        cols.append(F.expr("array_max(transform(_scores, s -> s.score))").alias(out + "_score"))
    return staged.select(*cols)


def term_table(spark, rs: RuleSet) -> DataFrame:
    """The dictionary as rows (term, ranks).

    ``ranks`` lists the rule rank of every domain that names the term as a
    keyword (once per listing).
    """
    rank_of = {dom: i for i, dom in enumerate(rs.domains, start=1)}
    ranks: dict[str, list[int]] = {}
    for dom, kw in rs.keywords:
        ranks.setdefault(kw, []).append(rank_of[dom])
    return spark.createDataFrame([(t, ranks.get(t, [])) for t in dictionary_terms(rs)], "term string, ranks array<int>")


def _join_scores(df: DataFrame, rs: RuleSet, title, desc, keep: list[str], terms: DataFrame | None = None,
                 key: str | None = None) -> DataFrame:
    """keep + _th + _scores from the join form of the hits."""
    staged = _join_hits(df, rs, title, desc, keep, terms, key)
    staged = staged.select(
        *keep, "_thr", "_dhr", F.array_distinct(F.concat("_thr", "_dhr")).alias("_bothr"),
        F.expr("transform(_thr, x -> x.term)").alias("_th"), F.expr("transform(_dhr, x -> x.term)").alias("_dh"), "_short")
    staged = staged.withColumn("_both", F.array_union("_th", "_dh"))
    return staged.select(*keep, "_th", F.expr(scores_sql(rs, None, ranked=True)).alias("_scores"))


def keyword_term_table(rs: RuleSet, keywords: DataFrame) -> DataFrame:
    """``term_table`` built in Spark from a keyword table of any size.

    ``keywords(domain, keyword)``: the domain's rank comes from the rule
    order of ``rs`` (its weight table); a keyword of a domain without a
    weight scores nothing and is left out of the ranks. The fixed phrases
    and boost terms of ``rs`` are added with no ranks. Nothing is collected.
    """
    spark = keywords.sparkSession
    rank_map = F.create_map(*[x for i, dom in enumerate(rs.domains, start=1) for x in (F.lit(dom), F.lit(i))])
    kw = keywords.select(F.col("keyword").alias("term"), F.element_at(rank_map, F.col("domain")).alias("rank"))
    fixed = dictionary_terms(RuleSet(replacements=[], keywords=[], weights=rs.weights, boosts=rs.boosts))
    fixed_df = spark.createDataFrame([(t, None) for t in fixed], "term string, rank int")
    return kw.unionByName(fixed_df).groupBy("term").agg(F.collect_list("rank").alias("ranks"))


def classify_table(df: DataFrame, rs: RuleSet, keywords: DataFrame, title: str | Column = "job_title",
                   desc: str | Column = "job_description", out: str = "kw_domain",
                   keep: list[str] | None = None, with_score: bool = False,
                   key: str | None = None) -> DataFrame:
    """J1 with the keyword table kept as a DataFrame (no size bound): the join form.

    ``rs`` supplies the replacements, weights (domain order) and boosts;
    ``rs.keywords`` is not used. Same labels as ``classify`` with the
    keywords collected into ``rs``. ``key``: a unique row key, if any.
    """
    keep = keep if keep is not None else list(df.columns)
    return _label(_join_scores(df, rs, title, desc, keep, keyword_term_table(rs, keywords), key), keep, out, with_score)


def _join_hits(df: DataFrame, rs: RuleSet, title, desc, keep: list[str], terms: DataFrame | None = None,
               key: str | None = None) -> DataFrame:
    """keep + _short + _thr/_dhr (array<struct<term, ranks>> of the hits) by the positional join.

    Hits are gathered per row and joined back by a row id; the texts stay
    where they are. With a caller's unique ``key`` that column is the id and
    the texts are simply read twice; without one, the normalised texts get a
    generated id in a lazy checkpoint on the shared folder, so both sides of
    the join (and any retried task) agree on it.
    """
    spark = df.sparkSession
    terms = term_table(spark, rs) if terms is None else terms
    x = df.select(*keep, normalized(title, rs).alias("_t"), normalized(desc, rs).alias("_d"),
                  *([F.col(key).alias("_rid")] if key else []))
    if not key:
        checkpoint_dir(spark)
        x = x.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=False)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("_t").alias("text")),
                    F.struct(F.lit(1).alias("side"), F.col("_d").alias("text")))
    texts = x.select("_rid", F.explode(sides).alias("_s")).select(
        F.struct("_rid", "_s.side").alias("row"), "_s.text")
    hits = phrase_hits(texts, terms).join(terms, "term")
    hit = F.struct("term", "ranks")
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("row.side") == side, hit)))
    hits = hits.groupBy(F.col("row._rid").alias("_rid")).agg(of(0).alias("_thr"), of(1).alias("_dhr"))
    none = F.array().cast("array<struct<term:string,ranks:array<int>>>")
    return x.select(*keep, "_rid", fewer_words_than(F.col("_d"), FV.SHORT_DESC_WORDS).alias("_short")).join(
        hits, "_rid", "left").withColumns({"_thr": F.coalesce("_thr", none), "_dhr": F.coalesce("_dhr", none)})


def keyword_hits(df: DataFrame, rs: RuleSet, id_col: str = "id", title="job_title",
                 desc="job_description", method: str = "inline", unique_id: bool = False,
                 keywords: DataFrame | None = None) -> DataFrame:
    """Per (row, domain) the listed-keyword hit counts in title and description.

    ``method`` as in ``classify``; with a ``keywords(domain, keyword)`` table
    the join form runs on it. ``unique_id`` says ``id_col`` is unique, so the
    join form needs no checkpoint.
    """
    if method == "join" or keywords is not None:
        terms = None if keywords is None else keyword_term_table(rs, keywords)
        staged = _join_hits(df, rs, title, desc, [id_col], terms, key=id_col if unique_id else None)
        per_dom = ", ".join(
            f"named_struct('domain', {sql_str(dom)}, 'title_hits', {_ranked_count_sql('_thr', r)}, "
            f"'desc_hits', {_ranked_count_sql('_dhr', r)})" for r, dom in enumerate(rs.domains, start=1))
        return (staged.select(id_col, F.expr(f"inline(array({per_dom}))"))
                .where((F.col("title_hits") > 0) | (F.col("desc_hits") > 0))
                .select(id_col, "domain", F.col("title_hits").cast("bigint"), F.col("desc_hits").cast("bigint")))
    d = dictionary_for(rs)
    staged = _hits(df.select(id_col, normalized(title, rs).alias("_t"),
                             normalized(desc, rs).alias("_d")), [id_col], d)
    per_dom = ", ".join(
        f"named_struct('domain', {sql_str(dom)}, 'title_hits', {hit_count_sql('_th', t)}, "
        f"'desc_hits', {hit_count_sql('_dh', t)})" for dom, t in _kw_terms(rs).items())
    return (staged.select(id_col, F.expr(f"inline(array({per_dom}))"))
            .where((F.col("title_hits") > 0) | (F.col("desc_hits") > 0))
            .select(id_col, "domain", F.col("title_hits").cast("bigint"), F.col("desc_hits").cast("bigint")))


def best_scores(df: DataFrame, rs: RuleSet, title="job_title", desc="job_description",
                keep: list[str] | None = None, method: str = "inline", key: str | None = None,
                keywords: DataFrame | None = None) -> DataFrame:
    """First highest-scoring domain in rule order and its score (before threshold/overrides).

    ``method`` and ``keywords`` as in ``keyword_hits``.
    """
    keep = keep if keep is not None else list(df.columns)
    first_max = ("named_struct('rank', 0, 'domain', CAST(NULL AS STRING), 'score', -1.0D), "
                 "(acc, x) -> IF(x.score > acc.score, x, acc))")
    if method == "join" or keywords is not None:
        terms = None if keywords is None else keyword_term_table(rs, keywords)
        staged = _join_scores(df, rs, title, desc, keep, terms, key=key)
        return staged.select(*keep, F.expr(f"aggregate(_scores, {first_max}").alias("_b")).select(
            *keep, F.col("_b.domain").alias("best_domain"), F.col("_b.score").alias("best_score"))
    d = dictionary_for(rs)
    staged = _hits(df.select(*keep, normalized(title, rs).alias("_t"),
                             normalized(desc, rs).alias("_d")), keep, d)
    staged = staged.select(*keep, "_th", "_dh", F.array_union("_th", "_dh").alias("_both"),
                           fewer_words_than(F.col("_d"), FV.SHORT_DESC_WORDS).alias("_short"))
    best = f"aggregate({scores_sql(rs, d)}, {first_max}"
    return staged.select(*keep, F.expr(best).alias("_b")).select(
        *keep, F.col("_b.domain").alias("best_domain"), F.col("_b.score").alias("best_score"))
