"""A corpus pipeline of five stages, each a thin call of one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``; each works on
everything that the stage before it kept.  Stages decide row by row, so null or repeated identifiers drag no clean row
along; rows with null texts, repeated rows, empty tables and further columns pass as the operators' docstrings say.
``ORACLE_SQL`` is None: a fitted classifier and fingerprints are beyond SQL, so
``tests/llm/test_pipeline.py`` holds every stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontam import drop_contaminated
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.packing import pack
from tidemark.llm.quality import drop_poor
from tidemark.llm.shared import stage
from tidemark.llm.simhash import drop_near_copies

SEQUENCE = 1024


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the longest stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest identifier stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, tokenised and packed along the curve."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=SEQUENCE, end_id=0)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
