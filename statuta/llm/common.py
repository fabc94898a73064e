"""Small helpers shared by the operators of this folder."""
from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.session import scratch_path

#: A character outside the white space of the word rules (space, tab to carriage return).
WORD_CHAR = r"[^\x20\x09-\x0D]"


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that Python workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Spark the real size of the
    result, so that it broadcasts it only where that size allows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none of them meets a column of ours in a join."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def row_columns(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``df`` out of their struct."""
    return [F.col(row)[c].alias(c) for c in df.columns]


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null or blank text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
