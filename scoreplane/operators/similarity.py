"""Label-to-label similarity in 0..1 (C4 pair lookup, C5 alias, H24 groups).

The rule tables are small and bounded (checked), so each lookup is a
broadcast hash join and the labelled table streams through without a
shuffle; a caller's table above the bound is joined by shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane import rules as R
from scoreplane.functions.text import normalize


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """Broadcast a caller's rule table only when its row count is within the bound.

    A larger table is returned as is: the lookup becomes a shuffle join (AQE
    may still broadcast it after measuring it, and splits skewed labels), so
    the answer is the same either way.
    """
    if df.limit(R.MAX_RULE_ROWS + 1).count() > R.MAX_RULE_ROWS:
        return df
    return F.broadcast(df)


def resolve_alias(df: DataFrame, col: str, aliases: DataFrame, out: str) -> DataFrame:
    """One alias hop with identity default."""
    a = aliases.select(F.col("alias").alias(f"_{out}_k"), F.col("label").alias(f"_{out}_v"))
    return (df.join(a, F.col(col) == F.col(f"_{out}_k"), "left")
              .withColumn(out, F.coalesce(F.col(f"_{out}_v"), F.col(col)))
              .drop(f"_{out}_k", f"_{out}_v"))


def pair_lookup(df: DataFrame, a: str, b: str, pairs: DataFrame, out: str = "pair_sim") -> DataFrame:
    """C4: directed pair table, forward key first, then the reversed key."""
    fwd = pairs.select(F.col("a").alias("_fa"), F.col("b").alias("_fb"), F.col("similarity").alias("_fs"))
    rev = pairs.select(F.col("a").alias("_pra"), F.col("b").alias("_prb"), F.col("similarity").alias("_rs"))
    return (df.join(fwd, (F.col(a) == F.col("_fa")) & (F.col(b) == F.col("_fb")), "left")
              .join(rev, (F.col(b) == F.col("_pra")) & (F.col(a) == F.col("_prb")), "left")
              .withColumn(out, F.coalesce(F.when(F.col("_fs") != 0, F.col("_fs")),
                                          F.when(F.col("_rs") != 0, F.col("_rs"))))
              .drop("_fa", "_fb", "_fs", "_pra", "_prb", "_rs"))


def group_sets(groups: DataFrame) -> DataFrame:
    """label -> array of its groups (a label may sit in two groups)."""
    return groups.groupBy("label").agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _score(ra: Column, rb: Column, ps: Column, ga: Column, gb: Column) -> Column:
    """Equal -> pair -> same group -> cross-group rules -> default."""
    def cross(g1, g2):
        return ((F.array_contains(ga, g1) & F.array_contains(gb, g2))
                | (F.array_contains(ga, g2) & F.array_contains(gb, g1)))

    fallback = F.lit(FV.DEFAULT_SIMILARITY)
    for g1, g2, sc in reversed(FV.CROSS_GROUP_SCORES):
        fallback = F.when(cross(g1, g2), F.lit(sc)).otherwise(fallback)
    return (F.when(ra == rb, F.lit(FV.SAME_LABEL_SCORE))
            .when(ps.isNotNull(), ps)
            .when(F.arrays_overlap(ga, gb), F.lit(FV.SAME_GROUP_SCORE))
            .otherwise(fallback)).cast("double")


def similarity_fixed(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """J3 with the built-in tables inlined as literal maps (fixed, small size).

    No join and no broadcast job: each row does a few lookups in maps of at
    most a few dozen keys, inside one projection.
    """
    alias = _lit_map(FV.SIMILARITY_ALIASES)
    pairs = _lit_map({f"{x}\u0001{y}": float(v) for (x, y), v in FV.SIMILARITY_PAIRS.items()})
    memb: dict[str, list[str]] = {}
    for g, ls in FV.SIMILARITY_GROUPS.items():
        for lbl in ls:
            memb.setdefault(lbl, []).append(g)
    groups = F.create_map(*[x for k, v in memb.items()
                            for x in (F.lit(k), F.array(*[F.lit(g) for g in sorted(v)]))])
    na, nb = normalize(F.col(a)), normalize(F.col(b))
    x = df.withColumn("_na", na).withColumn("_nb", nb)
    x = (x.withColumn("_ra", F.coalesce(F.try_element_at(alias, F.col("_na")), F.col("_na")))
          .withColumn("_rb", F.coalesce(F.try_element_at(alias, F.col("_nb")), F.col("_nb"))))
    sep = F.lit("\u0001")
    ps = F.coalesce(F.try_element_at(pairs, F.concat(F.col("_ra"), sep, F.col("_rb"))),
                    F.try_element_at(pairs, F.concat(F.col("_rb"), sep, F.col("_ra"))))
    e = F.array().cast("array<string>")
    ga = F.coalesce(F.try_element_at(groups, F.col("_ra")), e)
    gb = F.coalesce(F.try_element_at(groups, F.col("_rb")), e)
    return x.withColumn(out, _score(F.col("_ra"), F.col("_rb"), ps, ga, gb)).drop("_na", "_nb", "_ra", "_rb")


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity",
               aliases: DataFrame | None = None, pairs: DataFrame | None = None,
               groups: DataFrame | None = None) -> DataFrame:
    """Append ``out`` = similarity of labels in columns ``a`` and ``b``.

    With no rule tables given the fixed tables are inlined (``similarity_fixed``);
    caller tables are size-checked and joined by broadcast, or by shuffle
    above ``rules.MAX_RULE_ROWS``.
    """
    if aliases is None and pairs is None and groups is None:
        return similarity_fixed(df, a, b, out)
    spark: SparkSession = df.sparkSession
    # built-in tables have a known, fixed size; caller tables are counted first
    aliases = _bounded(aliases, "aliases") if aliases is not None else F.broadcast(R.alias_table(spark))
    pairs = _bounded(pairs, "pairs") if pairs is not None else F.broadcast(R.pair_table(spark))
    gs = (_bounded(group_sets(groups), "groups") if groups is not None
          else F.broadcast(group_sets(R.group_table(spark))))
    x = df.withColumn("_na", normalize(F.col(a))).withColumn("_nb", normalize(F.col(b)))
    x = resolve_alias(x, "_na", aliases, "_ra")
    x = resolve_alias(x, "_nb", aliases, "_rb")
    x = pair_lookup(x, "_ra", "_rb", pairs, "_ps")
    ga = gs.select(F.col("label").alias("_gla"), F.col("groups").alias("_ga"))
    gb = gs.select(F.col("label").alias("_glb"), F.col("groups").alias("_gb"))
    x = (x.join(ga, F.col("_ra") == F.col("_gla"), "left")
          .join(gb, F.col("_rb") == F.col("_glb"), "left"))
    e = F.array().cast("array<string>")
    score = _score(F.col("_ra"), F.col("_rb"), F.col("_ps"),
                   F.coalesce(F.col("_ga"), e), F.coalesce(F.col("_gb"), e))
    return x.withColumn(out, score).drop(
        "_na", "_nb", "_ra", "_rb", "_ps", "_gla", "_ga", "_glb", "_gb")
