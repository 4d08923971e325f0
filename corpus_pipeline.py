"""A training corpus from raw documents: quality rules, line and near-duplicate removal, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.llm.decontamination import decontaminate
from lumentide.llm.lines import dedup_lines
from lumentide.llm.neardup import drop_near_duplicates
from lumentide.llm.packing import crc_payload, pack
from lumentide.llm.quality import quality_filter
from lumentide.llm.shared import Shared, scope
from lumentide.session import visible_to_workers


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; a document that loses all its words goes."""
    out = dedup_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), payload=("ids_crc32", crc_payload, "long"))


def _stage(f):
    return lambda spark, docs, sf_dir: f(visible_to_workers(spark), docs, sf_dir)


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("line dedup", _stage(line_dedup)),
    ("MinHash near-dedup", _stage(near_dedup)),
    ("benchmark decontamination", _stage(benchmark_decontamination)),
    ("packing", _stage(packing)),
]

#: Suffix arrays, similarity components, edit distances and tokenizers aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    shared, docs = Shared(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        if k == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope(spark):
            docs = shared.write(stage(spark, docs, sf_dir), f"stage-{k}")
        shared.keep(f"stage-{k}")
