"""User functions: scalar, aggregate and table functions from Python callables, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, body: Callable, returns: str) -> Callable[..., Column]:
    """A vectorised scalar function: body takes and gives pandas Series. It can be called from SQL by name."""
    made = F.pandas_udf(body, returns)
    spark.udf.register(name, made)
    return made


def scalar_rows(spark: SparkSession, name: str, body: Callable, returns: str) -> Callable[..., Column]:
    """A scalar function whose body takes single values; rows still travel in Arrow batches."""

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([body(*row) for row in zip(*columns)])

    batch.__annotations__ = {"return": pd.Series}
    made = F.pandas_udf(batch, returns, F.PandasUDFType.SCALAR)
    spark.udf.register(name, made)
    return made


def aggregate(spark: SparkSession, name: str, body: Callable, returns: str) -> Callable[..., Column]:
    """An aggregate function: body takes a group's Series and gives one value. A group must fit one task; built-in aggregates need not."""
    made = F.pandas_udf(body, returns, F.PandasUDFType.GROUPED_AGG)
    spark.udf.register(name, made)
    return made


def table(spark: SparkSession, name: str, handler: type, returns: str):
    """A table function: handler has eval(*args) that yields rows."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made
