"""One query for each operator, over whole tables; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import graphs, mixing, quality, rollups, rules, sentencepiece_sampling, simhash, substrings, toxicity, warc
from parchment.llm.store import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document's count by two tokenizers, delete exact copies, revise and move the counts of the first, and
    commit the deletes twice."""
    docs, one, two = table(spark, sf_dir, "documents"), "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    rollup.apply(1, rollups.counted(docs, one, rollups.default_ranks_path(one)))
    rollup.apply(2, rollups.counted(docs, two, rollups.default_ranks_path(two)))
    rollup.apply(3, rollups.copies(docs, one, two))
    rollup.apply(4, rollups.revised(rollup, one))
    rollup.apply(3, rollups.copies(docs, one, two))
    return rollup.totals()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document as piece ids, and the text that these ids decode to."""
    return sentencepiece_sampling.encoded(table(spark, sf_dir, "documents"), k=2, with_texts=True)


#: Targets of the mixture: languages and topics by name, the rest of them together; sources by their smoothed shares.
TARGETS = {"lang": {"en": 0.5, mixing.OTHERS: 0.5}, "topic": {"prose": 0.85, mixing.OTHERS: 0.15}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = mixing.mixed(docs, targets=TARGETS)
    return out.select("doc_id", "source", "lang", "mix.topic", F.col("mix.tokens").alias("n_tokens"), "mix.weight", "mix.probability", "mix.sampled")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(rules.ledger(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, and what it alone rejects, from one ledger."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"), digest_only=True)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity, op2_token_counts, op3_sentencepiece, op4_mixing, op5_quality_rules, op6_quality_classifier,
        op7_substring_dedup, op8_embeddings, op9_simhash, op10_warc, quality_ablations,
    ]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {cond} THEN {1 << k} ELSE 0 END" for k, cond in enumerate(rules.RULES.values()))} AS BIGINT) AS failed FROM m)
SELECT *, failed & {rules.mask(rules.BASE)} <> 0 AS base_failed, failed & {rules.mask(list(dict.fromkeys((*rules.BASE, *rules.POLICIES[rules.CURRENT]))))} = 0 AS kept,
    '{rules.CURRENT}' AS policy FROM f
"""

_ABLATIONS = f"""
WITH f AS (SELECT failed, count(*) AS n FROM ({_OP5}) GROUP BY 1),
p AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', {rules.mask([r])}, {rules.mask(list(rs))})" for v, rs in rules.POLICIES.items() for r in rs)}) t(policy, rule, bit, every))
SELECT policy, rule, CAST(coalesce(sum(n) FILTER (failed & bit <> 0), 0) AS BIGINT) AS n_failed, CAST(coalesce(sum(n) FILTER (failed & every = bit), 0) AS BIGINT) AS n_only
FROM f CROSS JOIN p GROUP BY policy, rule
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
hit AS (SELECT k.doc_id, i FROM k JOIN (SELECT g, min(doc_id) AS first FROM k GROUP BY g) USING (g) WHERE first < k.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d) x
    ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""

_OP10 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || sha[k // 4 * 5 + 1:k // 4 * 5 + 5] AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM p JOIN m USING (html)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can say the same; the rest (trained models, BPE, sampling, raking, XXH64) is tested by brute force."""
    return {"op5_quality_rules": _OP5, "quality_ablations": _ABLATIONS, "op7_substring_dedup": _OP7, "op8_embeddings": _OP8, "op10_warc": _OP10}
