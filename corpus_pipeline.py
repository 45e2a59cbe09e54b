"""A corpus pipeline over the documents table: every stage writes Parquet that the next one reads.

1. quality: the byte-level network, trained on the labels of the documents that it gets, drops what it rejects.
2. near_duplicates: of each group at a Jaccard similarity of 0.8 or more on five-word shingles the smallest doc_id stays.
3. repeated_passages: strings of PASSAGE bytes or WORDS words that begin at two places or more go, at all their places; documents of which only
   white space is left go.
4. packing: what is left is packed into sequences of at most 2048 tokens, a row for each piece.

A null text is scored as an empty one in stage 1, links with nothing in stage 2, goes in stage 3 and has one token (the mark of its
end) in stage 4. Nulls in other columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import ngram_join, packing, quality, suffixes
from veilframe.llm.common import dropped, staged, table

PASSAGE, WORDS = suffixes.PASSAGE, suffixes.WORDS


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs, n=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs, PASSAGE, WORDS).filter(F.col("text").rlike(r"\S"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed_sequences),
]

#: Networks, components and packing are beyond SQL: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
