"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before kept; what it returns is written as Parquet and read again.  All but
the last return the columns of ``documents``.

1. quality rules: documents that the rules reject go
2. line dedup: repeated and near-repeated lines go out of the texts, and documents without another line go
3. SimHash near-dedup: one document of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more)
   stays; SimHash links first, each link is checked on whole shingle sets, and an exact join finds what 64 bits can't reach
4. mixing: sources are drawn to their target weights; a document has a row for each round that takes words of it
5. BPE: ids of each row's text, with a check that they decode to it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colframe.llm import bpe, lines, mixing, quality, resemblance
from colframe.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).mixed()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), ("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Stages 3 to 5 hash, draw and encode in ways that SQL can't express; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
