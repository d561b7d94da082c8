"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import toxicity
from chronomesh.llm.registry import query, table


@query("op7_toxicity_ftrl")
def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
