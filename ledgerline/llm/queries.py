"""Queries that apply the operators of this subpackage to the standard tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import id_crc, materialize, scratch_path
from .huffman import read_ids, write_ids
from .jaccard import jaccard_groups
from .negatives import mine_negatives
from .packing import pack_documents
from .pii import KINDS, find_personal_data
from .quality import ablations, apply_policy, ledger
from .resample import resample
from .simhash import near_duplicates
from .suffixes import remove_repeated
from .tokens import CachedEncoder
from .toxicity import ToxicityModel, fit_sample, score_toxicity
from .warc import captures_of, resolve_revisits
from .winnow import find_contamination

#: Texts of each language that the language model is fitted on, at most.
LANGUAGE_SAMPLE = 800
#: Labelled texts of each class that the toxicity model is fitted on, at most.
TOXICITY_SAMPLE = 3_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fitted on a bounded sample of the labels outside the held-out fold."""
    return fit_sample(docs, labels, F.pmod(id_crc("doc_id"), F.lit(4)) != 2, TOXICITY_SAMPLE)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    model = langid.fit(*langid.labelled_sample(docs, ~held_out, LANGUAGE_SAMPLE))
    found = langid.identify(docs, model, with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(materialize(ledger(_table(spark, sf_dir, "documents")), "ledger")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version removes, from the mask counts."""
    return ablations(materialize(ledger(_table(spark, sf_dir, "documents")), "ledger"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(4)) == 2).alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    encoder = CachedEncoder(public_tokenizers.path("word_bpe_49k.json"), "word")
    write_ids(_table(spark, sf_dir, "documents"), path, encoder, 49_408, end_id=2)
    return read_ids(spark, path, with_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures_of(_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "canonical_url", "captured_at", "response_id", "outcome", listed.alias("headers"), "n_bytes")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("found"), 256).alias("base_sha256"), joined(F.concat("found", "terms")).alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(_table(spark, sf_dir, "documents"), with_bytes=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    return pack_documents(_table(spark, sf_dir, "documents"), encoder, end_id=1, with_ids=False)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_LEDGER_SQL = r"""
words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 5)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM words)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM words LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
ledger AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (word_chars < 3 * n_words)::BIGINT + 8 * (word_chars > 14 * n_words)::BIGINT
    + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 64 * (2 * n_upper > n_letters)::BIGINT) AS failed FROM m)
"""
OP3_SQL = f"""WITH {_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept, failed FROM ledger"""
ABLATIONS_SQL = f"""WITH {_LEDGER_SQL},
rules(rule, rule_bit) AS (VALUES ('too_few_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8),
                                 ('symbols', 16), ('duplicate_lines', 32), ('shouting', 64)),
policies(policy, version, mask) AS (VALUES ('base', 1, 3), ('standard', 1, 31), ('standard', 2, 127))
SELECT policy, version::INT AS version, rule, count(*) FILTER (WHERE failed & rule_bit <> 0) AS n_failed,
       count(*) FILTER (WHERE failed & mask = rule_bit) AS n_failed_alone, count(*) FILTER (WHERE failed & mask = 0) AS n_kept,
       count(*) FILTER (WHERE (failed & mask & ~rule_bit) = 0) AS n_kept_without
FROM policies JOIN rules ON mask & rule_bit <> 0 CROSS JOIN ledger GROUP BY ALL"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT rid, i, m, item_id FROM dw JOIN bw USING (m, g)),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
       FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""

OP7_SQL = r"""
WITH v AS (SELECT page_id AS p, url AS u, html, unnest(range(0, page_id % 3 + 1)) AS k FROM pages),
c AS (SELECT p * 10 + k AS record_id, k = 0 AS first, (p + 37 * k) * 1000 AS captured_at, html, p, k,
        CASE WHEN k = 0 THEN u WHEN k = 1 THEN regexp_replace(u, '^http://', 'https://') || '#seen'
             ELSE regexp_replace(u, '#.*$', '') || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'utm_source=again' END AS url,
        CASE WHEN k = 0 THEN md5(html) WHEN (p + k) % 5 = 0 THEN md5(u) WHEN (p + k) % 7 = 0 THEN NULL ELSE md5(html) END AS etag,
        CASE WHEN p % 2 = 0 THEN 'day ' || (p % 365) END AS last_modified FROM v),
r AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '') AS rest FROM c),
n AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '')
        || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
        list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params FROM r),
f AS (SELECT *, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM n),
j AS (SELECT v.record_id, v.canonical_url, v.captured_at, v.etag AS tag, v.last_modified AS day, v.p, v.k, o.record_id AS response_id, o.etag, o.last_modified, o.html, o.p AS op
      FROM (SELECT * FROM f WHERE NOT first) v LEFT JOIN (SELECT * FROM f WHERE first) o
        ON v.canonical_url = o.canonical_url AND o.captured_at < v.captured_at
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY o.captured_at DESC NULLS LAST, o.record_id DESC) = 1),
g AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND tag IS NOT NULL THEN if(etag = tag, 'resolved', 'mismatch')
        WHEN last_modified IS NOT NULL AND day IS NOT NULL THEN if(last_modified = day, 'resolved', 'mismatch') ELSE 'unverified' END AS outcome FROM j)
SELECT record_id, canonical_url, captured_at, response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || strlen(html) || ';content-type=text/html;date=t' || (p + 37 * k) || ';server=s0' END AS headers,
       CASE WHEN outcome = 'resolved' THEN strlen(html) END AS n_bytes FROM g"""


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
e AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.rid <> b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM e JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(rid, near) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.near),
c AS (SELECT r.rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.near GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)"""

OP12_SQL = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
f AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM f WHERE rank <= 3"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_id, op3_quality_rules, quality_ablations, op4_toxicity, op5_token_files, op6_decontamination, op7_warc_revisits, op8_personal_data, op9_suffix_dedup, op10_packing, op11_jaccard_join, op12_hard_negatives, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "quality_ablations": ABLATIONS_SQL, "op6_decontamination": OP6_SQL, "op7_warc_revisits": OP7_SQL, "op11_jaccard_join": OP11_SQL, "op12_hard_negatives": OP12_SQL}
