"""Media times: clock values and media fragments as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import lit, string


def clock_seconds(value: Column | str) -> Column:
    """hh:mm:ss, mm:ss (each with a fraction), or a number with ms, min, h, s or without a unit; null for anything else."""
    trim = lambda c: F.btrim(c, lit(" \t\n\r\f\x0b"))
    v = trim(string(value))
    part = F.split(v, ":")
    number = lambda c: F.expr("true") & c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    as_double = lambda c: F.when(number(c), c.try_cast("double"))
    unit = lambda n, k: as_double(trim(F.left(v, F.length(v) - lit(n)))) * lit(k)
    at = lambda i: as_double(F.get(part, lit(i)))
    return (
        F.when(F.size(part) == 3, at(0) * 3600.0 + at(1) * 60.0 + at(2))
        .when(F.size(part) == 2, at(0) * 60.0 + at(1))
        .when(F.size(part) > 3, lit(None).cast("double"))
        .when(v.endswith("ms"), as_double(trim(F.left(v, F.length(v) - 2))) / lit(1000.0))
        .when(v.endswith("min"), unit(3, 60.0))
        .when(v.endswith("h"), unit(1, 3600.0))
        .when(v.endswith("s"), unit(1, 1.0))
        .otherwise(as_double(v))
    )


def media_fragment(src: Column | str, begin: Column | str, end: Column | str) -> Column:
    """src with the temporal fragment of begin and end seconds; without both of them as it is, a missing begin is 0."""
    begin, end = string(begin), string(end)
    b = F.format_string("%.3f", F.coalesce(begin, lit(0.0)))
    t = F.when(end.isNull(), b).otherwise(F.concat(b, lit(","), F.format_string("%.3f", end)))
    return F.when(begin.isNull() & end.isNull(), string(src)).otherwise(F.concat(string(src), lit("#t="), t))
