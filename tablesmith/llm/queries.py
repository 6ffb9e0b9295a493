"""Registered queries of the training-data operators, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import (archives, debruijn, embeddings, exact_dedup, filter_audit, hard_negatives, html_text, line_dedup,
               minhash, mixing, packing, quality, suffix_dedup)
from .common import stored

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1: best-fit packing ---------------------------------------------------------------------

@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = stored(packing.tokenized(docs, tokenizer_path("word_bpe_49k.json")), "pack-pieces")
    digests = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digests).drop("row_id")


# --- 4: quality rules ------------------------------------------------------------------------

def _rules_sql(rules) -> str:
    return " AND ".join(r.sql() for r in rules)


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS l FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
        len(list_filter(w, lambda x: suffix(x, '!!'))) AS n_bang_words,
        len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, NOT ({_rules_sql(quality.BASE_RULES)}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql(quality.RULES)} AS kept FROM j"""


@query("op4_quality_rules", _quality_sql())
def op4(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept")


# --- 6: legacy archive converter -------------------------------------------------------------

@query("op6_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""")
def op6(spark, sf_dir):
    path = scratch_path(spark, "warc")
    archives.pages_to_warc(_read(spark, sf_dir, "pages"), path)
    return archives.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to")


# --- 8: b-bit MinHash near-duplicates --------------------------------------------------------

@query("op8_minhash_near_dedup")
def op8(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 9: hierarchical mixing ------------------------------------------------------------------

def _mixing_sql(t: mixing.Targets = mixing.TARGETS) -> str:
    def weight(level):
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in getattr(t, level).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    ctes, parents = [], []
    for level in mixing.LEVELS:
        names = [*parents, level]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        up = f"JOIN b_{parents[-1]} USING ({', '.join(parents)})" if parents else "CROSS JOIN b_root"
        ctes.append(f"""
n_{level} AS (SELECT {', '.join(names)}, cap, b, w FROM (SELECT {', '.join(names)}, sum(cap) AS cap,
    {weight(level)} AS w FROM leaf GROUP BY {', '.join(names)}) {up}),
f_{level} AS (SELECT *, cap * coalesce(sum(w) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level}
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
    + w * sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS UNBOUNDED PRECEDING) <= b * w AS is_full
  FROM n_{level}),
b_{level} AS (SELECT {', '.join(names)}, CASE WHEN is_full THEN cap ELSE least(cap,
    (b - coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0)) * w
      // sum(w) FILTER (NOT is_full) OVER ({by})) END AS b FROM f_{level})""")
        parents = names
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {mixing.DOMAIN_SQL.format(source='source')} AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens,
    CAST(sum(n_tokens) * {t.max_epochs} AS HUGEINT) AS cap FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
b_root AS (SELECT sum(tokens) * {t.percent} // 100 AS b FROM leaf),{','.join(ctes)},
e AS (SELECT domain, lang, source, b // tokens AS epochs, b % tokens AS rest
      FROM leaf JOIN b_source USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{t.seed}|' || epochs || '|' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e USING (domain, lang, source))
SELECT * FROM (SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o) WHERE copies > 0"""


@query("op9_mixing", _mixing_sql())
def op9(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mixed(docs.withColumn("n", mixing.n_tokens("text")).drop("text"), mixing.TARGETS,
                        mixing.domain_of(), tokens=F.col("n")).drop("n")


# --- 10: fuzzy line dedup --------------------------------------------------------------------

@query("op10_line_dedup")
def op10(spark, sf_dir):
    return line_dedup.line_report(_read(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 3: main text of pages -------------------------------------------------------------------

@query("op3_html_extraction")
def op3(spark, sf_dir):
    return html_text.extracted(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


# --- 5: near-duplicate vectors ---------------------------------------------------------------

@query("op5_embedding_near_dedup", f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}),
r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(c) AS c FROM r GROUP BY n), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM v JOIN c ON c.n = vec_id LEFT JOIN d ON d.a = vec_id""")
def op5(spark, sf_dir):
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# --- 7: repeated word spans ------------------------------------------------------------------

@query("op7_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) > 19)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(g) ORDER BY doc_id, i) AS k FROM g)
      WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
      FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""")
def op7(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.without_repeats(docs).select("doc_id", "n_words", "n_removed",
                                                 F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# --- 2: repeated byte strings ----------------------------------------------------------------

@query("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                                     F.sha2("kept", 256).alias("kept_sha256"))


# --- 12: exact duplicates --------------------------------------------------------------------

@query("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
  doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""")
def op12(spark, sf_dir):
    return exact_dedup.duplicate_report(_read(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 13: filter interaction audit ------------------------------------------------------------

@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > least] AS f,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, f, good, toxic, count(*) AS n, len(list_filter(f, lambda x: x)) AS fails FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
k AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own,
        list_transform(range(1, step), lambda x: ascii(filter_order[x]) - 64) AS prior FROM s),
j AS (SELECT part, filter_order, step, n, good, toxic, fails, f[own] AS hit,
        len(list_filter(prior, lambda x: f[x])) > 0 AS gone FROM c, k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(fails, 0)) FILTER (hit), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step""")
def op13(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("part"), "text")
    return filter_audit.audit(filter_audit.masks(docs), _read(spark, sf_dir, "labels"))


# --- 11: hard negatives ----------------------------------------------------------------------

@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b
  ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s USING (anchor_id) WHERE p.k <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE k <= 5""")
def op11(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved))
