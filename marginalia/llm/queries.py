"""The registered queries of the operators, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, fingerprints, html_extract, langid, lexical, minhash, mixing, packing, periodic, sharding, token_counts, urls, vectors
from ._common import table


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"))


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).orderBy("finish_time", "at").select("doc_id", "size", "source_size", "target", "taken")


def op4_link_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"))


def op8_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Near(words=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op11_find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_digest(table(spark, sf_dir, "documents"))


def op12_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_rank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pack_best_fit, op2_format_chat, op3_mix_sources, op4_link_vectors, op5_filter_urls, op6_extract_html, op7_shard_documents, op8_identify_language, op9_near_duplicates, op10_fingerprint, op11_find_runs, op12_count_tokens, op13_rank_lexical)}
ORACLE_SQL = {"op3_mix_sources": mixing.ORACLE_SQL, "op4_link_vectors": vectors.ORACLE_SQL, "op5_filter_urls": urls.oracle_sql(), "op9_near_duplicates": minhash.ORACLE_SQL, "op13_rank_lexical": lexical.ORACLE_SQL}
