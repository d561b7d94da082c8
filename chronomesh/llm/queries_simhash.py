"""Query of the SimHash near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import simhash
from chronomesh.llm.registry import query, table


@query("op10_simhash_covering")
def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
