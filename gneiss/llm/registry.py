"""Queries of the operators for training data over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import audit, embeddings, langid, licenses, lines, mixing, passages, phrases, pieces, quality, simhash, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op1_simhash"] = op1_simhash


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_decode(docs, model_path or public_tokenizers.path("piece_bpe_32k.model")))


QUERIES["op8_sentencepiece"] = op8_sentencepiece


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.is_held_out("doc_id")
    model = langid.fit_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return langid.identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


QUERIES["op7_langid"] = op7_langid


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


QUERIES["op10_toxicity"] = op10_toxicity


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


QUERIES["op5_quality"] = op5_quality


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.junk_listing(pages))


QUERIES["op4_url_filter"] = op4_url_filter
ORACLES["op4_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM rest
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '/$', '') END AS curl FROM parts
), listed AS (
  SELECT DISTINCT curl FROM canon WHERE curl IS NOT NULL AND contains(regexp_extract(html, '<title>([^<]*)</title>', 1, 's'), ' | ')
), rules(rule, h, p, rule_verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fits AS (
  SELECT c.page_id, c.host, c.path, c.curl, r.rule, r.rule_verdict,
    row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM canon c LEFT JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.rule_verdict, CASE WHEN l.curl IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM fits f LEFT JOIN listed l ON f.curl = l.curl WHERE f.k = 1
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES["op3_embeddings"] = op3_embeddings
ORACLES["op3_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_duplicate_lines(docs, dropped_col="n_dropped")
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.rlike(lines.BLANK))).cast("long")
    return kept.select("doc_id", (left + F.col("n_dropped")).alias("n_lines"), "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES["op2_line_dedup"] = op2_line_dedup


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op6_suffix_dedup"] = op6_suffix_dedup


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix_to_targets(docs, mixing.label_domains(_table(spark, sf_dir, "labels")), mixing.TARGETS)
    shares = [F.round(F.col("posterior")[d], 6).alias(f"p_{d}") for d in sorted(mixing.TARGETS)]
    return mixed.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"))


QUERIES["op9_mixing"] = op9_mixing


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


QUERIES["op11_phrases"] = op11_phrases
ORACLES["op11_phrases"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM words, (VALUES (1), (2), (3)) t(k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j.cut, string_split(c.phrase, ' ') AS w, array_to_string(w[: j.cut], ' ') AS head, array_to_string(w[j.cut + 1 :], ' ') AS tail
  FROM counted c, (VALUES (1), (2)) j(cut) WHERE c.f >= 10 AND c.k > j.cut
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.k, c.phrase ORDER BY score, c.cut) AS weakest
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = c.tail
), inner_parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, f FROM counted, (VALUES (1), (2)) t(i) WHERE k = 3 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(f) AS g FROM inner_parts GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer o ON s.k = 2 AND o.lang = s.lang AND o.phrase = s.phrase
  WHERE weakest = 1 AND (o.g IS NULL OR 100 * o.g < 50 * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op12_audit"] = op12_audit
ORACLES["op12_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), sets AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS bits
  FROM docs LEFT JOIN marks USING (doc_id)
), held AS (
  SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM sets GROUP BY ALL
), letters(x, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, l.bit, (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE position(e.x IN o) < s) AS before
  FROM orders, range(1, 6) t(s), letters l WHERE l.x = substr(o, s::INT, 1)
), counted AS (
  SELECT part, o, s, bit,
    sum(CASE WHEN bits & before = 0 AND bits & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & before > 0 AND bits & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & before = 0 AND bits & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM held, steps GROUP BY ALL
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


QUERIES["op13_licenses"] = op13_licenses
