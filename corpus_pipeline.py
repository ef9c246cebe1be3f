"""The corpus pipeline: stages over `documents`, each written as Parquet and read again before the next.

A stage is (name, function); a function takes (spark, docs, sf_dir), works on all its predecessor kept, and
all but the last return the columns of documents. Documents that a stage rejects go.

Every stage takes an empty table and gives an empty one, takes nulls in any column, and hands on further columns of any
name as they are; only the last returns columns of its own choice. Rows that repeat are judged each for itself, and
near-dedup keeps one of them. Whole texts are read, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe, decontam, langid, quality, similar, simhash
from wayfold.llm.common import read_table, write_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Smaller than the encoder's own, as the stages before leave the executors' heaps large.
MEMO = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a calibrated probability of 0.5 or more. Null texts and texts without
    a letter have no language and go."""
    return langid.keep_identified(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Documents are near where their
    five-word shingles have a Jaccard similarity of 0.8 or more. They are sought by op8's fingerprints and links, and
    beside them by bands of MinHashes, as 3 bits would miss most of them; every pair is verified.
    Texts without words, null ones too, are one group; a null doc_id comes last."""
    return simhash.keep_one_each(docs, similar.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go. Null and empty texts have
    none and stay."""
    return decontam.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids of the whole text, their number, and whether they decode to the text. A null
    text is encoded as an empty one."""
    encoded = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], "ids", memo=MEMO)
    return encoded.select("doc_id", "lang", "source", "ids", "n_tokens", "decodes")


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: SQL can't express a learned model, fingerprints by XXH64 or byte-pair merges; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
