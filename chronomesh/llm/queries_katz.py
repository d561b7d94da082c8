"""Query of the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import katz
from chronomesh.llm.registry import query, table


@query("op3_katz_backoff")
def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.fit_and_score(table(spark, sf_dir, "documents"), least=1)
