"""A training-data pipeline over the table ``documents``: language, near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import langid, minhash, mixing, packing
from marginalia.llm._common import columns, materialise, table

#: A document is rejected if it has no language, or if its best language holds less than this share of the likelihood.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without text or letters go, and those whose best language holds less than
    LEAST_SCORE of the likelihood: so few or so foreign words that no language stands out.

    Repeated rows stay or go together; ties go to the first language; null ids, languages and sources are allowed (a null
    language teaches nothing); of an empty table, or one without any language to learn, nothing is left.
    """
    found = langid.identify_documents(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*columns(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shares five-word shingles at 0.8 or more.

    Repeated rows stay once; rows of null id link as others do, and stay only where their group has no id; texts without words
    link with nothing and stay; an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs).select(*columns(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated up to three times, or left out beyond the total budget.

    The stream of all sources by virtual finish time is cut where it has given as many words as came in; the document there
    gives its leading words. Null is a source; documents without words give nothing and go; repeated rows queue one
    behind the other; an empty table stays empty.
    """
    return mixing.mix(docs).select(*columns(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and offset they are packed at: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated documents are packed as often as they come; null and empty texts are one closing id; an empty table gives no
    pieces.
    """
    return packing.packed_digest(docs)


STAGES = [("language ID", identify_language), ("MinHash near-dedup", drop_near_duplicates), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: Language models and token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
