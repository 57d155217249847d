"""Numbers that may be missing: safe conversion, division, arrays, correlations, JSON, and excess returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

TINY = 1e-9


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def number(x: Column | str, default: float = 0.0) -> Column:
    """x as a double; default where it is null, no number, NaN or infinite."""
    given = F.col(x) if isinstance(x, str) else x
    value = given.try_cast("double")
    return F.when(_finite(value), value).otherwise(F.lit(float(default)))


def divided(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """a / b; default where b is as good as 0."""
    below = number(b)
    return F.when(F.abs(below) < TINY, F.lit(float(default))).otherwise(number(F.try_divide(number(a), below), default))


def filled(xs: Column | str, fill: float = 0.0) -> Column:
    """An array of doubles with fill for nulls, NaN and infinities."""
    return F.transform(xs, lambda x: F.when(_finite(x), x).otherwise(F.lit(float(fill))))


def quality(xs: Column | str) -> Column:
    """total, nan_count, inf_count and valid_rate of an array of doubles (nulls count as NaN)."""
    total = F.size(xs)
    nans = F.size(F.filter(xs, lambda x: x.isNull() | F.isnan(x)))
    infinite = F.size(F.filter(xs, lambda x: F.abs(x) == float("inf")))
    valid = F.when(total == 0, 1.0).otherwise(F.round(1 - (nans + infinite) / total, 6))
    return F.struct(total.alias("total"), nans.alias("nan_count"), infinite.alias("inf_count"), valid.alias("valid_rate"))


def correlation(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """An aggregate: the correlation of a and b; default with fewer than two rows or without deviation."""
    spread = (F.stddev_pop(a) < TINY) | (F.stddev_pop(b) < TINY) | (F.count(F.lit(1)) < 2)
    return F.when(spread, F.lit(float(default))).otherwise(number(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), default))


def json_safe(x: Column | str, kind: DataType) -> Column:
    """to_json of a column of type kind (a struct, array or map) with NaN and infinite numbers, at any depth, as null.
    Texts stay as they are, also those that spell a number that is none."""
    return F.to_json(_without_odd_numbers(F.col(x) if isinstance(x, str) else x, kind), {"ignoreNullFields": "false"})


def _without_odd_numbers(x: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(_finite(x), x)
    if isinstance(kind, StructType):
        fields = [_without_odd_numbers(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields)) if fields else x
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: _without_odd_numbers(y, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, y: _without_odd_numbers(y, kind.valueType))
    return x


def excess_returns(rows: DataFrame, benchmark: DataFrame, fallback: bool = False) -> DataFrame:
    """rows(today, future, d, horizon, ...) with excess: the change in percent beyond the benchmark(d, close)'s, from the
    first session after d to the horizon-th. Without enough sessions or a positive close 0, or (fallback) the change.

    The benchmark's calendar is one row of arrays, a few thousand days, whatever the number of rows.
    """
    sorted_ = F.sort_array(F.collect_list(F.struct("d", F.col("close").cast("double").alias("close"))))
    one = benchmark.where("d is not null").agg(sorted_.alias("_s")).select(F.transform("_s", lambda x: x["d"]).alias("_days"), F.transform("_s", lambda x: x["close"]).alias("_closes"))
    x = rows.crossJoin(F.broadcast(one)).withColumn("_k", F.size(F.filter("_days", lambda y: y <= F.col("d"))))
    base, last = F.get("_closes", F.col("_k")), F.get("_closes", (F.col("_k") + F.col("horizon") - 1).cast("int"))
    today = F.greatest(F.col("today"), F.lit(0.01))
    own = (F.col("future") - today) / today * 100
    beyond = F.when((base > 0) & (last > 0), own - (last - base) / base * 100)
    return x.withColumn("excess", F.round(F.coalesce(beyond, own if fallback else F.lit(0.0)), 4)).drop("_days", "_closes", "_k")
