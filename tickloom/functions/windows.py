"""Rolling functions over a symbol's bars as window columns.

All are Column builders, so several of them over one DataFrame share one exchange and one sort. Frames count rows, the
current one included; partial frames at the head count unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_time():
    """A symbol's rows in order of time."""
    return Window.partitionBy("symbol").orderBy("d")


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def across():
    """The cross-section of a day."""
    return Window.partitionBy("d")


def back(n: int):
    return by_time().rowsBetween(1 - n, 0)


def ahead(first: int, last: int):
    return by_time().rowsBetween(first, last)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ref(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_time())


def full(x: Column, n: int) -> Column:
    """x where the frame of n rows is full, else null."""
    return F.when(F.count(F.lit(1)).over(back(n)) == n, x)


def ma(x, n: int) -> Column:
    """Mean of the last n rows, fewer at the head."""
    return F.avg(col(x)).over(back(n))


def sma(x, n: int) -> Column:
    """Mean of the last n rows, null until there are n."""
    return full(ma(x, n), n)


def total(x, n: int) -> Column:
    return F.sum(col(x)).over(back(n))


def highest(x, n: int) -> Column:
    return F.max(col(x)).over(back(n))


def lowest(x, n: int) -> Column:
    return F.min(col(x)).over(back(n))


def std(x, n: int) -> Column:
    """Sample standard deviation."""
    return F.stddev_samp(col(x)).over(back(n))


def std_pop(x, n: int) -> Column:
    return F.stddev_pop(col(x)).over(back(n))


def true(x: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(x, F.lit(False))


def count_true(x: Column, n: int) -> Column:
    return F.sum(true(x).cast("long")).over(back(n))


def cross(a, b) -> Column:
    """Whether a rises above b at this row."""
    return true((col(a) > col(b)) & (ref(a) <= ref(b)))


def row() -> Column:
    return F.row_number().over(by_time())


def bars_last(x: Column) -> Column:
    """Rows since the condition last held; 0 before it first did."""
    return F.coalesce(row() - F.last(F.when(true(x), row()), ignorenulls=True).over(so_far()), F.lit(0)).cast("long")


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def change(x, n: int = 1) -> Column:
    """Change over n rows in percent."""
    return (ratio(x, ref(x, n)) - 1) * 100


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ladder(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first step whose bound x lies below; rest beyond the last; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for bound, value in steps:
        out = out.when(x < bound, F.lit(value))
    return out.otherwise(F.lit(rest))
