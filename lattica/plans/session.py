"""Named variables, evaluated text and user functions of a session, over Spark's catalog."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ndarray import NdArray


class Workspace:
    """Variables (arrays, tables, plain values) by case-sensitive names; arrays and tables are temporary views as well."""

    def __init__(self, spark: SparkSession):
        self.spark, self.values, self.stack, self.functions = spark, {}, [], {}

    def set(self, name: str, value) -> None:
        self.values[name] = value
        df = value.df if isinstance(value, NdArray) else value if isinstance(value, DataFrame) else None
        if df is not None:
            df.createOrReplaceTempView(name)

    def default(self, name: str, value) -> None:
        if name not in self.values:
            self.set(name, value)

    def get(self, name: str):
        return self.values[name]

    def delete(self, *names: str) -> None:
        for n in names:
            if isinstance(self.values.pop(n, None), NdArray | DataFrame):
                self.spark.catalog.dropTempView(n)

    def switch(self, a: str, b: str) -> None:
        x, y = self.values[a], self.values[b]
        self.set(a, y)
        self.set(b, x)

    def push(self, *names: str) -> None:
        self.stack.append({n: self.values[n] for n in names})

    def pop(self) -> None:
        for n, v in self.stack.pop().items():
            self.set(n, v)

    def defined(self, name: str) -> bool:
        return name in self.values

    def describe(self) -> list[tuple[str, str, object]]:
        """(name, class, dimensions or type) of each variable."""
        out = []
        for n, v in sorted(self.values.items()):
            out.append((n, "array", v.dims) if isinstance(v, NdArray) else (n, "table", v.columns) if isinstance(v, DataFrame) else (n, "scalar", type(v).__name__))
        return out

    def eval(self, text: str):
        """The value of a Spark SQL expression of constants."""
        return self.spark.range(1).select(F.expr(text)).first()[0]

    def execute(self, text: str) -> DataFrame:
        """A Spark SQL statement over the variables."""
        return self.spark.sql(text)

    def on_cells(self, name: str, text: str) -> NdArray:
        """An array with an expression of v and the index columns in each cell."""
        a = self.values[name]
        return NdArray(a.df.select(*a.axes, F.expr(text).alias("v")), a.dims)

    def define(self, name: str, fn: Callable, returns: str = "double") -> None:
        """A user function, for Python and for SQL text."""
        self.functions[name] = fn
        self.spark.udf.register(name, fn, returns)

    def call(self, name: str, *args):
        return self.functions[name](*args)

    def plan(self, name: str) -> str:
        v = self.values[name]
        return (v.df if isinstance(v, NdArray) else v)._jdf.queryExecution().toString()


def getenv(name: str) -> str:
    return os.environ.get(name, "")


def setenv(text: str) -> None:
    name, _, value = text.partition("=")
    os.environ[name] = value


def cputime() -> float:
    return time.process_time()


def systime() -> float:
    return time.time()
