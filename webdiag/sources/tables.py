"""Readers for the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webdiag.session import plain_unions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet table ``name`` of ``sf_dir``, with ``columns`` only. How finely
    it is split is the session's ``spark.sql.files.maxPartitionBytes``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    plain_unions(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if columns is None else df.select(*columns)
