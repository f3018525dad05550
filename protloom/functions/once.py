"""Columns that are computed once, whatever filters and columns later ask of them, and by how many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a further column, made in a generator of one row.

    The optimiser moves filters on a projected column below the projection, into join conditions even, and computes the column
    anew in each. Filters on what a generator makes stay above it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def by_number(df: DataFrame, *keys: str) -> DataFrame:
    """df spread over tasks by keys and by number, for rows that are small in bytes and dear to compute with: adaptive
    execution, which goes by bytes, would put too many in a task."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *keys)
