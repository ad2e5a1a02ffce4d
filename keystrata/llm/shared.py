"""Shared-folder tables and small helpers used by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.storage import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a Python worker has freed to the system, for it lives on beside the workers of later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(made: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of a group that gives back what it took."""

    def of_group(frame: pd.DataFrame) -> pd.DataFrame:
        out = made(frame)
        give_back()
        return out

    return of_group


def ascii_lower(column: Column | str) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)
