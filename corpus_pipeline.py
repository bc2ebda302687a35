"""The corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from gaugeworks.llm.common import table
from gaugeworks.session import written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("best-fit packing", packing.stage),
]

#: Training a classifier and a public tokenizer are beyond SQL; tests/llm compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
