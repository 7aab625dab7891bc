"""Pieces that several corpus operators share: tables, row keys and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.vector import let  # noqa: F401
from docloom.operators.graph import components  # noqa: F401
from docloom.operators.skew import meet, thinned  # noqa: F401
from docloom.sources.shared import cut, shared_folder, stored  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """64-bit key of a row. Rows alike in all the columns share the key and so the result; nulls are allowed."""
    return F.xxhash64(*[F.col(c) for c in cols])
