"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import chat, langid, media, mixing, packing, paragraph_dedup, quality, simhash_mih, suffix_dedup, url_reputation
from loomspark.llm.common import table


def op1_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: what is left; where a cut goes through a character, its bytes are replaced by U+FFFD."""
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.read_digests(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id")
    model = langid.train(docs.where(~out & F.col("lang").isNotNull()).select("lang", "text"))
    got = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.concat_ws(",", "languages").alias("languages"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose id is the page's; bad is low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    got = url_reputation.judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(docs)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.simhash_components(table(spark, sf_dir, "documents"))


def op7_chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chats(turns.unionByName(probe)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *quality.COUNTS, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_runs": op1_suffix_runs,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_language_mixture": op3_language_mixture,
    "op4_host_reputation": op4_host_reputation,
    "op5_systematic_mix": op5_systematic_mix,
    "op6_simhash_multi_index": op6_simhash_multi_index,
    "op7_chat_blocks": op7_chat_blocks,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_paragraph_banding": op9_paragraph_banding,
    "op10_quality_rules": op10_quality_rules,
}

#: Words of DuckDB's regular expressions: white space is given as in the contract.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS most,
         sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN level * w < most THEN level END) OVER () * w, most)) AS target,
         ('0x' || substr(md5('0:' || coalesce(source, '\N')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(d.doc_id::VARCHAR)) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * least(floor((k + 1) * rate + u) - floor(k * rate + u), 3))::BIGINT AS taken FROM r
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), o AS (
  SELECT p.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad FROM p JOIN labels l ON p.page_id = l.doc_id WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL
), h0 AS (
  SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS name FROM o GROUP BY host
), h1 AS (
  SELECT *, string_split(name, '.') AS q, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two FROM h0
), h AS (
  SELECT host, n, k, CASE WHEN regexp_matches(name, 'ADDRESS') THEN name WHEN regexp_matches(name, 'LONG') THEN array_to_string(list_slice(q, -3, -1), '.') ELSE two END AS domain,
         CASE WHEN regexp_matches(name, 'ADDRESS') THEN name WHEN regexp_matches(name, 'LONG') THEN two ELSE q[-1] END AS suffix FROM h1
), d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY ALL
), t AS (SELECT (sum(sk) + 0.5::DOUBLE) / (sum(sn) + 1.0::DOUBLE) AS top FROM s
), ms AS (SELECT 1 / least(greatest(sum(pow(sk - sn * top, 2.0::DOUBLE) - sn * top * (1 - top)) / sum(sn * (sn - 1) * top * (1 - top)), 0.001::DOUBLE), 0.999::DOUBLE) - 1 AS m FROM s, t
), s2 AS (SELECT suffix, (sk + m * top) / (sn + m) AS smean FROM s, t, ms
), d2 AS (SELECT d.*, smean FROM d JOIN s2 USING (suffix)
), md AS (SELECT 1 / least(greatest(sum(pow(dk - dn * smean, 2.0::DOUBLE) - dn * smean * (1 - smean)) / sum(dn * (dn - 1) * smean * (1 - smean)), 0.001::DOUBLE), 0.999::DOUBLE) - 1 AS m FROM d2
), d3 AS (SELECT domain, suffix, (dk + m * smean) / (dn + m) AS dmean FROM d2, md
), h2 AS (SELECT h.*, dmean FROM h JOIN d3 USING (domain, suffix)
), mh AS (SELECT 1 / least(greatest(sum(pow(k - n * dmean, 2.0::DOUBLE) - n * dmean * (1 - dmean)) / sum(n * (n - 1) * dmean * (1 - dmean)), 0.001::DOUBLE), 0.999::DOUBLE) - 1 AS m FROM h2
), r AS (SELECT host, k + m * dmean AS a, n - k + m * (1 - dmean) AS b FROM h2, mh
), low AS (SELECT host, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM r
), f AS (
  SELECT page_id, p.host, path, lower, CASE
    WHEN (p.host = 'example.com' OR suffix(p.host, '.example.com')) AND prefix(path, '/en/7') THEN 'example.com/en/7'
    WHEN (p.host = 'example.net' OR suffix(p.host, '.example.net')) AND prefix(path, '/de/8') THEN 'example.net/de/8'
    WHEN (p.host = 'com' OR suffix(p.host, '.com')) AND prefix(path, '/en/') THEN 'com/en/'
    WHEN (p.host = 'net' OR suffix(p.host, '.net')) AND prefix(path, '/de/') THEN 'net/de/'
    WHEN (p.host = 'org' OR suffix(p.host, '.org')) AND prefix(path, '/es/') THEN 'org/es/' END AS rule
  FROM p LEFT JOIN low ON p.host = low.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN lower > 0.2::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM f
""".replace("LONG", url_reputation.LONG_SUFFIX).replace("ADDRESS", url_reputation.ADDRESS)

OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h') AS et, replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c') AS er,
         row_number() OVER w AS i, lag(role) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text))
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + 7 + CASE WHEN before IS NULL OR before <> role THEN length(er) + 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS times FROM g
), u AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE times > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words, len(l)::DOUBLE AS lines,
         len(list_filter(l, lambda x: suffix(x, '...')))::DOUBLE AS dots, len(list_filter(w, lambda x: lower(x) IN (STOPS)))::DOUBLE AS stops,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::DOUBLE AS uppers
  FROM d LEFT JOIN u USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 2.0::DOUBLE AND word_chars / n_words <= 12.0::DOUBLE AND n_symbols / word_chars <= 0.1::DOUBLE AND stops / n_words >= 0.06::DOUBLE
  AND n_dup_lines / lines <= 0.5::DOUBLE AND dots / lines <= 0.3::DOUBLE AND uppers / word_chars <= 0.4::DOUBLE AS kept FROM b
""".replace("STOPS", ", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS))))

ORACLES: dict[str, str] = {"op4_host_reputation": OP4_SQL, "op5_systematic_mix": OP5_SQL, "op7_chat_blocks": OP7_SQL, "op10_quality_rules": OP10_SQL}
