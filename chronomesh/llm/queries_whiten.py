"""Query of embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import whiten
from chronomesh.llm.registry import query, table


@query("op12_whitened_embeddings")
def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
