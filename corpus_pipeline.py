"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Part of the corpus operators (kinetrail.llm); it may be removed with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrail.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from kinetrail.llm.common import documents, work_path
from kinetrail.storage import delete, scope

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id.language_stage),
    ("exact_dedup", exact_dedup.exact_stage),
    ("near_dedup", simhash.near_stage),
    ("mix_sources", mixing.mix_stage),
    ("byte_bpe", byte_bpe.encode_stage),
]
#: Language profiles, SimHash and byte-level BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind is deleted as soon as its result is written,
    and that result once the next stage's is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        target = work_path(spark, f"pipeline-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
        if before:
            delete(spark, before)
        before = target
    return STAGES[-1][1](spark, docs, sf_dir)
