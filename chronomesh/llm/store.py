"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronomesh.operators.scaling import shared_dir


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share; whoever runs the application removes it afterwards."""
    return shared_dir(spark)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none of them is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
