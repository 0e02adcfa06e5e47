"""Statistics as Columns: Wilson intervals, nearest-rank percentiles, lead buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % score interval of a share; null without observations."""
    p, z2 = F.try_divide(hits.cast("double"), n), Z * Z
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value that at least this share of the values doesn't exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def lead_bucket(days: Column) -> Column:
    """Days ahead as 1-6, 7, 8-13, 14-20, 21-27, 28+."""
    out = F.when(days < 7, "1-6").when(days == 7, "7")
    for low, high in ((8, 13), (14, 20), (21, 27)):
        out = out.when(days <= high, f"{low}-{high}")
    return out.otherwise("28+")
