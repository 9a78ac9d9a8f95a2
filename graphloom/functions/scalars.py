"""Column functions: exact rationals, clean-up and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rational(text: Column) -> Column:
    """An integer, a fraction "a/b" or a decimal as a double; null for anything else or a zero denominator."""
    parts = F.split(F.trim(text), "/")
    whole = F.trim(text).rlike(r"^[+-]?\d+\s*/\s*[+-]?\d+$")
    plain = F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(whole, F.try_divide(F.trim(parts[0]).try_cast("double"), F.trim(parts[1]).try_cast("double"))).when(plain, F.trim(text).try_cast("double"))


def nonzero(value: Column) -> Column:
    """1 or 0 for non-zero or zero; null stays null."""
    return (value != 0).cast("int")


def finite(value: Column) -> Column:
    """The value, or null if it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null if b is zero or either is null."""
    return F.when(b != 0, a.cast("double") / F.nullif(b, F.lit(0)).cast("double"))


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient of n and k as a double; null where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n.cast("double") - i) / (i + 1)
    return F.when(n >= k, out)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are set, as an aggregate; null (not an error) where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)
