"""The document pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread for the next one.  All but the last return the columns of
``documents``.  No stage has an SQL equivalent as a whole (line and near-dedup
are closures over similarity links, packing needs a tokenizer).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.llm import line_dedup, minhash, mixing, packing, quality
from tablesmith.llm.common import WORD_RE, stored
from tablesmith.llm.queries import tokenizer_path

ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that pass every quality rule."""
    return quality.clean_documents(docs)


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without the lines that repeat an earlier one; those left without a word go."""
    return line_dedup.without_repeated_lines(docs).where(F.col("text").rlike(WORD_RE))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents by the target weights, a row for each epoch they are read in."""
    chosen = mixing.mixed(docs, mixing.TARGETS, mixing.domain_of())
    return mixing.repeated(chosen, docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents with their ids and places in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).drop("row_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
