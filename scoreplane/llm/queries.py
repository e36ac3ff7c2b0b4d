"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreplane.llm import (ballkmeans, divergence, exact_dedup, langid, lm_score, mixing, near_dedup, packing, pii, quality,
                            toxicity, vptree, warc)
from scoreplane.llm.common import documents, remainder

QUERIES: dict = {}
ORACLE: dict = {}


def op1_exact_dedup(spark, sf_dir):
    g = exact_dedup.exact_groups(documents(spark, sf_dir))
    return g.select("doc_id", F.col("win_id").alias("keep_id"), "group_size",
                    (F.col("row_id") == F.col("win_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES["op1_exact_dedup"] = op1_exact_dedup
ORACLE["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.measured(docs).select(
        "doc_id", *[F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                "base_failed", "kept")])


QUERIES["op8_quality_rules"] = op8_quality_rules


def op5_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


QUERIES["op5_minhash_near_dedup"] = op5_minhash_near_dedup


def op6_mixing(spark, sf_dir):
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op6_mixing"] = op6_mixing
ORACLE["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
             (3 * source_size)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT rate AS common FROM r WHERE rate * w <= cap ORDER BY ratio, rate LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT common FROM c) * w), cap) AS target FROM r),
q AS (SELECT d.*, t.source_size, t.target, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, (sum(size) OVER (PARTITION BY source, epoch ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)
                 + epoch * source_size)::DOUBLE / target AS finish
      FROM (SELECT * FROM q WHERE size > 0), (SELECT unnest([0, 1, 2]) AS epoch)
),
e AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, h, doc_id ROWS UNBOUNDED PRECEDING) AS out
      FROM f),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM e WHERE out <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k USING (doc_id)
"""


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir)).drop("ids")


QUERIES["op9_packing"] = op9_packing


def op2_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.archive_and_read(spark, pages, min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")


QUERIES["op2_warc"] = op2_warc
ORACLE["op2_warc"] = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)),
        'string_agg', '') AS payload_digest,
      min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, '' AS fault FROM b
"""


def op7_pii(spark, sf_dir):
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.find(documents(spark, sf_dir)).select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(F.col("base_text").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES["op7_pii"] = op7_pii


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, remainder("doc_id", 3) != 1)
    out = langid.identify(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES["op4_language_id"] = op4_language_id


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon, weights = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, lexicon, weights)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


QUERIES["op10_toxicity"] = op10_toxicity


def op3_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = lm_score.score(docs, remainder("doc_id", 10) != 0)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


QUERIES["op3_lm_scoring"] = op3_lm_scoring


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir)).select("lang", "source", "part", "item", "value", "rank")


QUERIES["op11_source_divergence"] = op11_source_divergence
ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total
         FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
             1 + (1000000000::HUGEINT * (total + 5)) // (sum(total) OVER s + 5 * count(*) OVER s) AS q
      FROM cell WINDOW s AS (PARTITION BY lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def op12_vantage_point_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vptree.nearest(rows, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


QUERIES["op12_vantage_point_search"] = op12_vantage_point_search
ORACLE["op12_vantage_point_search"] = """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.id AS query_row, c.vec_id, c.id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST, id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op13_vector_codes(spark, sf_dir):
    rows, books = ballkmeans.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ballkmeans.with_label_error(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(ballkmeans.digest(books)).alias("codebooks_sha256"))


def _codes_sql(rounds: int = ballkmeans.ROUNDS) -> str:
    """Each round: distances to every entry, the nearest, the floor of the means."""
    ctes = ["""k AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            "p AS (SELECT id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM k, range(16) t(part))",
            "b0 AS (SELECT part, id - 1 AS entry, x AS c FROM p WHERE id <= 64)"]
    near = """a{k} AS (SELECT id, part, any_value(x) AS x, arg_min(struct_pack(entry := entry, d := d), d * 64 + entry) AS e
      FROM (SELECT id, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN b{k} b ON p.part = b.part) GROUP BY id, part)"""
    move = """b{n} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
      SELECT part, entry, list(floor(s::DECIMAL(38, 0) / n)::BIGINT ORDER BY i) AS c FROM (
        SELECT part, e.entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n
        FROM a{k}, range(1, 1025) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry) m
      ON m.part = b.part AND m.entry = b.entry)"""
    for k in range(rounds):
        ctes += [near.format(k=k), move.format(k=k, n=k + 1)]
    ctes += [near.format(k=rounds), f"""r AS (SELECT id, string_agg(printf('%02x', e.entry), '' ORDER BY part) AS code,
      sum(e.d)::BIGINT AS error FROM a{rounds} GROUP BY id)"""]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN r USING (id)"""


QUERIES["op13_vector_codes"] = op13_vector_codes
ORACLE["op13_vector_codes"] = _codes_sql()
