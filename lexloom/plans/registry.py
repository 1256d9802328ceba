"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import documents, problems, reference

QUERIES = {**reference.QUERIES, **documents.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **documents.SQL, **problems.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over the chunks."""
    return reference.hybrid_retrieve(spark, sf_dir)
