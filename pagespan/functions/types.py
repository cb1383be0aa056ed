"""Small helpers for functions that take a column or its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def lit(x) -> Column:
    return F.lit(x)


def string(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


col = string


class Udf:
    """A Python function on single values, sent in Arrow batches. The return type is a DDL string, which needs a session only when the function is used."""

    def __init__(self, f: Callable, returns: str | DataType):
        self.f, self.returns = f, returns

    def __call__(self, *columns: Column | str) -> Column:
        return F.udf(self.f, self.returns, useArrow=True)(*columns)
