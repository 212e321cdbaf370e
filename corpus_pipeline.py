"""From documents to packed training sequences, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import decontaminate, near_dedup, packing, suffix_dedup, toxicity
from sedimenta.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_dedup.stage),
    ("repeated_passages", suffix_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A trained classifier and a tokenizer take part, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
