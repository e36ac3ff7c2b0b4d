"""Rule tables for the text classifier and the label similarity.

Rules are data: small DataFrames with an order column. The classifier's
keyword and replacement tables are supplied by the caller; ``sample_*``
below is a test vocabulary of words of the ``documents`` table. Domain weights, boost
terms and similarity tables default to the fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scoreplane import fixed_values as FV

# Upper bound on rule rows that are collected, inlined into a plan or broadcast.
MAX_RULE_ROWS = 200_000

# Sample ordered phrase replacements (seq, old, new), applied one after the
# other to substrings. Their words occur in the ``documents`` table. The first
# step makes a match for the second, the fourth one for the fifth; "her" also
# matches inside longer words.
SAMPLE_REPLACEMENTS = [
    ("thon ther", "thonther"),
    ("thonther", "anea"),
    ("nicht aulich", "aulich"),
    ("mit license", "open terms"),
    ("open terms", "licence grant"),
    ("her", "ther"),
    ("onnd the", "onnd"),
    ("dans les", "dedans"),
]

# Sample keyword lists per domain (domain order follows DOMAIN_WEIGHTS), of
# words and phrases that occur in the ``documents`` table.
SAMPLE_KEYWORDS = {
    "Data Science": ["anea", "tion the", "thing", "version 2.0", "eriner", "then"],
    "AI/Machine Learning": ["thble", "erin is", "attion", "onan", "thanea"],
    "Mobile Development": ["erer", "anon", "reou", "pour"],
    "Frontend Development": ["that", "ered", "thly", "onnd", "eron", "sich"],
    "Backend Development": ["with", "erat", "thea", "retion", "nicht", "dans", "anti"],
    "Full Stack Development": ["thnd", "that the", "onre"],
    "Cybersecurity": ["licence grant", "public license", "ernd", "token ="],
    "Cloud Engineering": ["from", "thou", "erble", "rean"],
    "DevOps/Infrastructure": ["this", "thst", "erly", "anea", "of."],
    "Quality Assurance": ["ther", "test", "is, the", "onin"],
    "Game Development": ["erth", "onwh", "thnt", "reen", "+1"],
    "Database Management": ["eres", "tion", "reing"],
    "Networking": ["mail1.example.com", "555", "erwh", "onou"],
    "Site Reliability Engineering": ["oned", "thor", "reer"],
    "Product Management": ["only", "heat", "para"],
}

# Titles and short phrases used to build posting fixtures.
SAMPLE_TITLES = [
    "Senior Anea Thing", "Thble Attion", "That Thly Onnd", "With Retion", "Thnd Onre", "Mit License Ernd",
    "From Erble", "This Thst", "Test Onin", "Erth Reen", "Anon Reou", "Only Heat",
    "Oned Reer", "Erwh Onou", "Unda Seco", "Thnd onre developer developer",
]
SAMPLE_PHRASES = [
    "anea thing with version 2.0 and eriner",
    "thble onan with thanea and attion",
    "that ered thly eron plus with erat thea retion",
    "erat and thea with anti retion",
    "from thou erble rean",
    "this thst erly",
    "test onin ther",
    "erth onwh reen +1",
    "anon reou pour",
    "only",
    "555 erwh onou mail1.example.com",
    "oned thor",
    "public license ernd",
    "thnd that the onre",
    "ai",
    "erat",
]


@dataclass
class RuleSet:
    """Plain-Python view of the classifier rules (all bounded in size)."""
    replacements: list[tuple[str, str]]
    keywords: list[tuple[str, str]]            # (domain, keyword), list order kept
    weights: dict[str, float] = field(default_factory=lambda: dict(FV.DOMAIN_WEIGHTS))
    boosts: dict[str, list[str]] = field(default_factory=lambda: dict(FV.DOMAIN_BOOSTS))

    @property
    def domains(self) -> list[str]:
        """Domains in tie-break order: weight table order, then any others."""
        order = list(self.weights)
        for d, _ in self.keywords:
            if d not in order:
                order.append(d)
        for d in self.boosts:
            if d not in order:
                order.append(d)
        return order


def sample_ruleset() -> RuleSet:
    kws = [(d, k) for d, ks in SAMPLE_KEYWORDS.items() for k in ks]
    return RuleSet(replacements=list(SAMPLE_REPLACEMENTS), keywords=kws)


def ruleset_from_tables(replacements: DataFrame, keywords: DataFrame,
                        weights: DataFrame | None = None,
                        boosts: DataFrame | None = None) -> RuleSet:
    """Collect rule tables (seq/rank ordered) after checking their size.

    replacements(seq, old, new); keywords(rank, domain, keyword[, pos]);
    weights(rank, domain, weight); boosts(domain, term).
    """
    for name, t in (("replacements", replacements), ("keywords", keywords),
                    ("weights", weights), ("boosts", boosts)):
        if t is not None and t.limit(MAX_RULE_ROWS + 1).count() > MAX_RULE_ROWS:
            raise ValueError(f"rule table {name} exceeds {MAX_RULE_ROWS} rows; "
                             "pass a large keyword table to plans.classify.classify_table instead")
    rep = [(r["old"], r["new"]) for r in replacements.orderBy("seq").collect()]
    order = ["rank"] + (["pos"] if "pos" in keywords.columns else [])
    kws = [(r["domain"], r["keyword"]) for r in keywords.orderBy(*order).collect()]
    rs = RuleSet(replacements=rep, keywords=kws)
    if weights is not None:
        rs.weights = {r["domain"]: r["weight"] for r in weights.orderBy("rank").collect()}
    if boosts is not None:
        b: dict[str, list[str]] = {}
        for r in boosts.collect():
            b.setdefault(r["domain"], []).append(r["term"])
        rs.boosts = b
    return rs


def replacements_table(spark: SparkSession, pairs=None) -> DataFrame:
    pairs = SAMPLE_REPLACEMENTS if pairs is None else pairs
    return spark.createDataFrame([(i + 1, o, n) for i, (o, n) in enumerate(pairs)],
                                 "seq int, old string, new string")


def keywords_table(spark: SparkSession, rs: RuleSet | None = None) -> DataFrame:
    rs = rs or sample_ruleset()
    rank = {d: i + 1 for i, d in enumerate(rs.domains)}
    rows = [(rank[d], d, float(rs.weights.get(d, 0)), k, i) for i, (d, k) in enumerate(rs.keywords)]
    return spark.createDataFrame(rows, "rank int, domain string, weight double, keyword string, pos int")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FV.SIMILARITY_ALIASES.items()), "alias string, label string")


def pair_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, float(s)) for (a, b), s in FV.SIMILARITY_PAIRS.items()],
                                 "a string, b string, similarity double")


def group_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lbl, g) for g, ls in FV.SIMILARITY_GROUPS.items() for lbl in ls],
                                 "label string, grp string")
