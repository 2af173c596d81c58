"""Queries op1 to op10, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, langid, neardup, packing, quality, sp_encode, tokencount, topk, toxicity, warc
from .common import table

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


OP6_SQL = """
with v as (select cast(vec_id as bigint) vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) code from embeddings where len(embedding) > 0),
c as (select * from v where vec_id is not null qualify row_number() over (partition by vec_id order by len(code) desc, code desc) = 1),
p as (select q.vec_id query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.code) + 1), lambda i: abs(q.code[i] - v.code[i]))) as integer) distance
  from c q join c v on len(q.code) = len(v.code) where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by distance, vec_id) as integer) rank from p)
select query_id, rank, vec_id, distance from r where rank <= 10
"""

OP10_SQL = """
with p as (select cast(page_id as bigint) page_id, encode(coalesce(html, '')) payload from pages),
d as (select page_id, octet_length(payload) payload_bytes, sha256(payload) payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first_id from d)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first_id < page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and first_id < page_id then first_id end refers_to
from f
"""


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return sp_encode.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), model_path or public_tokenizers.path(PIECES))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), model_path or public_tokenizers.path(PIECES))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path or public_tokenizers.path(WORDS))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_fingerprints": op2_fingerprints, "op3_packing": op3_packing, "op4_near_duplicates": op4_near_duplicates, "op5_language_id": op5_language_id, "op6_topk": op6_topk, "op7_token_counts": op7_token_counts, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op10_warc": OP10_SQL}
