"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import langid
from chronomesh.llm.registry import query, table


@query("op11_bigru_languages")
def op11_bigru_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.fit_and_predict(table(spark, sf_dir, "documents"))
