"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.llm import arc, bpe, budget, eftrie, ivfpq, repetition, ring, simhash, tokenstore, toxicity
from clausula.llm.common import crc_bucket, table


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_report(table(spark, sf_dir, "documents"))


def op2_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: What the archives give back, from the pages alone.
OP10_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m"""

#: The mix of op5: domains are the sources by their number modulo 4.
DOMAIN_SQL = "'d' || try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4"
WEIGHTS = ({"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, {})


def document_mix(budget_share: float = 0.6, max_epochs: int = 2) -> budget.Mix:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return budget.Mix(WEIGHTS, budget_share, max_epochs, domain=F.concat(F.lit("d"), (number % 4).cast("string")))


def op5_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.mixture(table(spark, sf_dir, "documents"), document_mix())


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_rows(table(spark, sf_dir, "documents"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mph_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eftrie.model_scores(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 10) == 0)


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op10_arc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_repetition, op2_ivf_pq, op3_byte_bpe, op4_bounded_ring, op5_hierarchical_mix, op6_boosted_toxicity, op7_mph_token_store, op8_elias_fano_lm, op9_simhash_anchors, op10_arc_converter)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_hierarchical_mix": budget.mixture_sql("documents", DOMAIN_SQL, document_mix()),
        "op10_arc_converter": OP10_SQL,
    }
