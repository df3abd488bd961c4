"""Corpus pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame.

1. quality_rules: documents that the rules reject go; the others keep the lines that passed.
2. simhash_near_dedup: one document of each group of near copies stays, the one with the smallest id.
3. suffix_array_dedup: passages of 200 bytes or more that occur more than once are cut out of every text; rows stay.
4. mix_sources: each document is repeated by a Poisson draw with its source's rate, and all are shuffled.
5. sentencepiece: ids of each text and the text they decode to.

All but the last return the columns of documents; n_chars follows the text where a stage edits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, set to the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[F.char_length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_rules import clean_documents

    return _counted(clean_documents(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lectern.llm.simhash import one_of_each

    return one_of_each(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lectern.llm.suffixdedup import without_repeats

    return _counted(without_repeats(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(docs, alpha=0.5, copy_col="__mix_copy", key_col="__mix_key").select(*[F.col(f"`{c}`") for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lectern.llm.pieces import encode_documents
    from lectern.llm.registry import tokenizer_path

    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    from lectern.llm.common import Workspace, read_table, released

    space = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with released(spark):
            docs = space.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            space.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
