"""Statistics as Column expressions, with the zero conventions of the reports.

An empty or degenerate input gives 0.0, never null: reports print numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean(x: Column | str) -> Column:
    return F.coalesce(F.avg(_col(x)), F.lit(0.0))


def percentile(x: Column | str, percent: float) -> Column:
    """Exact, with linear interpolation between neighbours."""
    return F.coalesce(F.percentile(_col(x).cast("double"), F.lit(percent / 100.0)), F.lit(0.0))


def median(x: Column | str) -> Column:
    return percentile(x, 50.0)


def coefficient_of_variation(x: Column | str) -> Column:
    """Sample standard deviation by the mean; 0.0 for fewer than two values or a mean of zero."""
    return F.coalesce(F.stddev_samp(_col(x)) / F.nullif(F.avg(_col(x)), F.lit(0.0)), F.lit(0.0))


def spread(x: Column | str) -> Column:
    """(max - min) / max."""
    return F.coalesce((F.max(_col(x)) - F.min(_col(x))) / F.nullif(F.max(_col(x)).cast("double"), F.lit(0.0)), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0.0 where b is zero or null."""
    return F.coalesce(_col(a).cast("double") / F.nullif(_col(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def rate(amount: Column | str, seconds: Column | str) -> Column:
    """Amount per second; 0.0 where no time passed."""
    return F.when(_col(seconds) > 0, _col(amount).cast("double") / _col(seconds)).otherwise(F.lit(0.0))


def mib_rate(num_bytes: Column | str, seconds: Column | str) -> Column:
    return rate(_col(num_bytes) / F.lit(1048576.0), seconds)


def percent_change(before: Column | str, after: Column | str) -> Column:
    """Null where there is nothing to compare with."""
    return (_col(after) - _col(before)) / F.nullif(_col(before).cast("double"), F.lit(0.0)) * 100.0


def ceil_div(a: Column | str, b: Column | str) -> Column:
    return F.floor((_col(a) + _col(b) - 1) / _col(b)).cast("long")


def number(x: Column | str) -> Column:
    """A measured number, 0.0 where it was not recorded."""
    return F.coalesce(_col(x).cast("double"), F.lit(0.0))
