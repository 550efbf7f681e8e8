"""The thin queries over the operators, with production parameters, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import digest, fill_middle, harmonic, html_extract, language_id, line_dedup, packing, quality, sampled_pieces, shards, simhash, url_filter, whitening
from mnemoframe.llm.common import cut


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fixed values of the contract: (rule, verdict).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Hosts that the digest array blocks where no rule fits, with all their subdomains.
URL_HOSTS = [("spam-farm.example.org", "block"), ("cheap-pills.example.com", "block"), ("free-bets.example.com", "block")]


def op4_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, URL_HOSTS)


def op3_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest.with_groups(cut(digest.fingerprints(docs), "digests"), docs)


def op6_gumbel_topk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampled_pieces.sampled(docs, tokenizer_path("piece_bpe_32k.model"))


def op7_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages by their main text, the language that their markup declares and the host of their address.

    A document has a doc_id, a page a page_id and no doc_id (is_page tells them apart).  The text model is fitted on documents.
    """
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.lit(False).alias("is_page"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), "lang",
    )
    pages = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    pages = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.lit(True).alias("is_page"), "text", language_id.declared_language(F.col("html")).alias("declared"),
        language_id.host_of(F.col("url")).alias("host"), F.lit(None).cast("string").alias("lang"),
    )
    model = language_id.fit(docs)
    found = language_id.identify(docs.unionByName(pages), declared="declared", host="host", model=model, carry=["page_id", "is_page"])
    return found.select("doc_id", "carried.page_id", "carried.is_page", "language", "confidence", "text_language", "kept")


#: Words from which a line that several documents hold goes from the later ones, besides passages of 50 words wherever they stand.
LINE_WORDS = 5


def op9_pairwise_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), line_words=LINE_WORDS)
    return docs.select("doc_id", "text", F.col("_ld_blocks").alias("n_blocks"), F.col("_ld_words").alias("n_words_deleted"))


#: Bytes of a shard, small enough for an executor to shuffle many at once; every given table splits at it.
SHARD_BYTES = 1 << 20


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op10_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op11_overlapping_chunks_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restore(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return harmonic.pack(docs, tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_html_text_density": op1_html_text_density,
    "op2_simhash_pivot": op2_simhash_pivot,
    "op3_host_quality_rules": op3_host_quality_rules,
    "op4_url_digest_array": op4_url_digest_array,
    "op5_canonical_digest": op5_canonical_digest,
    "op6_gumbel_topk_pieces": op6_gumbel_topk_pieces,
    "op7_bayesian_language_id": op7_bayesian_language_id,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_pairwise_line_dedup": op9_pairwise_line_dedup,
    "op10_linear_grouping_packing": op10_linear_grouping_packing,
    "op11_overlapping_chunks_fim": op11_overlapping_chunks_fim,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_harmonic_packing": op13_harmonic_packing,
}

_OP4_SQL = r"""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(spam-farm\.example\.org|cheap-pills\.example\.com|free-bets\.example\.com)$') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, unnest(range(1, len(w) - 1)) AS i FROM d
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
           OR n_dup_lines * 2 > n_lines AS failed FROM m
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS bad FROM f GROUP BY source
), a AS (
  SELECT sum(n) AS docs, count(*) AS hosts, sum(bad) / sum(n) AS mu FROM h
), s AS (
  SELECT docs, hosts, mu, sum(n * pow(bad / n - mu, 2)) AS ss, sum(n * n) AS nn FROM h, a GROUP BY docs, hosts, mu
), b AS (
  SELECT mu, CASE WHEN docs > nn / docs THEN (ss - (hosts - 1) * mu * (1 - mu)) / (docs - nn / docs) END AS between_hosts FROM s
), p AS (
  SELECT mu, greatest(1.0, least(10000.0, CASE WHEN between_hosts > 0 THEN mu * (1 - mu) / between_hosts - 1 ELSE 10000.0 END)) AS nu FROM b
), r AS (
  SELECT source, mu, (bad + mu * nu) / (n + nu) AS rate FROM h, p
), v AS (
  SELECT source, CASE WHEN rate - mu > 0.5 * (1 - mu) THEN 'rejected' WHEN rate - mu > 1e-9 THEN 'watched' ELSE 'trusted' END AS host_verdict FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_verdict,
       CASE host_verdict WHEN 'rejected' THEN FALSE WHEN 'watched' THEN NOT failed ELSE NOT base_failed END AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

_OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents
), small AS (SELECT * FROM d WHERE bytes <= {SHARD_BYTES}), u AS (
  SELECT *, h >> (60 - CAST(depth AS INT)) AS prefix FROM small, range(61) r(depth)
), fits AS (
  SELECT depth, prefix FROM u GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES}
), leaf AS (
  SELECT doc_id, bytes, h, min(depth) AS depth FROM u JOIN fits USING (depth, prefix) GROUP BY ALL
), s AS (
  SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - CAST(depth AS INT))), CAST(depth AS INT), '0') END AS shard, CAST(depth AS INT) AS depth FROM leaf
  UNION ALL SELECT doc_id, bytes, '*' || upper(to_hex(h)), 60 FROM d WHERE bytes > {SHARD_BYTES}
)
SELECT doc_id, bytes, shard, depth, CAST(sum(bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes,
       count(*) OVER (PARTITION BY shard) AS shard_rows, bytes > {SHARD_BYTES} AS oversized FROM s
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || CAST(doc_id AS VARCHAR)) AS s FROM documents
), h AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h
), p AS (
  SELECT doc_id, t, n, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {"op11_overlapping_chunks_fim": _OP11_SQL, "op3_host_quality_rules": _OP3_SQL, "op4_url_digest_array": _OP4_SQL, "op8_extendible_shards": _OP8_SQL}
