"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept; ``run`` writes every stage's result
to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayside.llm.stages import LEAST_KNOWN, drop_near_duplicates, identify_language, mix_domains, pack_sequences, redact_secrets
from wayside.llm.storage import stored

__all__ = ["LEAST_KNOWN", "ORACLE_SQL", "STAGES", "run"]

STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Learned models decide the first and the fourth stage, so the rows are held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
