"""Query of the benchmark decontamination operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import decontaminate
from chronomesh.llm.registry import query, table


@query("op2_benchmark_leaks")
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
