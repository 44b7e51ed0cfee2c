"""The corpus pipeline: stages over documents, each on what its predecessor kept.

1. language_id drops documents without a recognised language.
2. near_duplicates keeps one document of each component of the n-gram Jaccard join, the one with the least id.
3. secret_scan replaces secrets in the texts that are left.
4. source_mixing repeats or drops documents so that sources reach their target weights.
5. packing packs the mixed corpus into token sequences; it alone returns pieces, not documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kernelfield.llm import jaccard_join, language_id, packing, secret_scan, source_mixing
from kernelfield.llm.common import shared_dir, table


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", jaccard_join.stage),
    ("secret_scan", secret_scan.stage),
    ("source_mixing", source_mixing.stage),
    ("packing", pack_stage),
]
#: No stage after the first can be told in SQL (trained models, random rounding); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{root}/{k}-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
