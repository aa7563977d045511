"""The corpus pipeline: STAGES over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import bpe, common, decontaminate, langid, simhash, toxicity

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("toxicity", toxicity.stage),
    ("simhash_near_duplicates", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("bpe_encoding", bpe.stage),
]
#: Fitted models, components and merges are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.written(stage(spark, docs, sf_dir), name)
    return docs
