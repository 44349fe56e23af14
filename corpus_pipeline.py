"""From raw documents to token shards, stage by stage. Each stage takes (spark, docs, sf_dir) and
all but the last return the columns of ``documents``; between stages the rows are written as Parquet
in the shared folder and read again, so a lost executor never reaches further back than one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadweave.llm import decontam, mixing, near_copies, token_store, toxicity
from roadweave.llm.common import materialise, passing, release_heaps, table
from roadweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest doc_id.
    Near copies are texts whose sets of five-word shingles are 0.8 alike or more."""
    release_heaps(spark)
    return near_copies.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    release_heaps(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    release_heaps(spark)
    return mixing.sample(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and from them each document's place, length and checksum."""
    release_heaps(spark)
    return token_store.token_table(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_shards),
]

#: SQL cannot express the toxicity model, SimHash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
