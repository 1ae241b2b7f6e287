"""From raw documents to token files: toxicity, near copies, benchmark passages, source mix, token output.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet
and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from redressa.llm import decontaminate, mixing, near_duplicates, token_files, toxicity
from redressa.llm.common import shipped, table, written
from redressa.session import prepare

#: Parameters of the run.
NEAR_WORDS, NEAR_SHARE = 5, 80
MIX_SHARE, MIX_SEED = 0.8, 7
MIX_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
VOCABULARY = os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(shipped(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return near_duplicates.without_near_duplicates(docs, NEAR_WORDS, NEAR_SHARE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_SHARE, MIX_SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return token_files.token_output(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", write_tokens),
]
#: A fitted model and a tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
