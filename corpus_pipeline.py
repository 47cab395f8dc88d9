"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the last one
the packed pieces. Between stages the rows are written as Parquet and read again, so that a lost
executor costs at most a part of one stage.

Defined cases: a null or empty text has no toxic words; equal texts, null counting as empty, leave the row with
the largest doc_id; of near-duplicates the one with the least doc_id stays, and rows without a doc_id
are nobody's near-duplicate; a document without words stands once in the mix, others as often as its words are
taken, which may be never; very long texts are treated whole and packed in several pieces; repeated
rows are copies; an empty table gives no pieces; further columns pass through all stages but the last, unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import exact_dedup, minhash, mixing, packing, toxicity
from leafmill.llm.common import cut, input_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, input_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learnt toxicity scores and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
