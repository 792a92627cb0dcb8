"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents:

1. quality: documents that fail the base rules or the likelihood ratio go;
2. near_dedup: one document of each class of near-duplicates stays;
3. secrets: spans are replaced by a mark;
4. mixing: documents come as often as the mix takes them (0 to 2 times);
5. packing: pieces in windows of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import mixing, near_dup, packing, quality, secrets
from weft.llm.common import materialize, read

STAGES = [
    ("quality", quality.stage),
    ("near_dedup", near_dup.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Encoding and order min hash are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
