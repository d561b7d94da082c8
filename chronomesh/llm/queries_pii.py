"""Query of the pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import pii
from chronomesh.llm.registry import query, table

#: For these public tables only; elsewhere the key is a secret of the caller.
KEY = "public test key"


@query("op1_feistel_pseudonyms")
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY, counts=True)
