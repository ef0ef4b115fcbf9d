"""Queries of this subpackage, by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, merkle, packing, pii, quality, simhash, substring, toxicity, warc
from .common import table

#: Vocabulary file of the queries; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("language", "class_distance", "word_distance")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", offsets.alias("offending"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), PIECES)
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_personal_data": op7_personal_data,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
}

#: Digests in hexadecimal of payloads; archives come back as they were written.
OP3_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest, coalesce(html, '') as payload from pages),
k as (select payload, max(page_id) as kept from p where n >= 1000 group by payload)
select p.page_id, p.n::bigint as payload_bytes, p.digest as payload_digest,
    case when k.kept is null or k.kept = p.page_id then 'response' else 'revisit' end as record_type,
    case when k.kept <> p.page_id then k.kept end as refers_to
from p left join k using (payload)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_document_fingerprints": merkle.oracle_sql(),
    "op2_substring_dedup": substring.ORACLE_SQL,
    "op3_warc": OP3_SQL,
    "op4_quality_rules": quality.oracle_sql(),
    "op7_personal_data": pii.oracle_sql(),
}
