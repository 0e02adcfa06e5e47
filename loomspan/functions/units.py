"""Quantities of several units in the base unit of their family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_base_units(sums: DataFrame, units: DataFrame, quantities: list[str], unit: str = "uom") -> DataFrame:
    """``sums`` with its quantities in base units and the base unit's name.

    Conversion is linear, so it is done to sums by unit, never row by row. ``units`` (unit, base, factor, base_factor)
    is a list that people keep: what one of a unit is worth over what one of its base unit is worth. A unit that isn't
    listed, or whose base is worth nothing, gives null, not a wrong number.
    """
    joined = sums.join(units.select(F.col("unit").alias("__unit"), F.col("base").alias("base_unit"), "factor", "base_factor"), F.col(unit) == F.col("__unit"), "left")
    worth = F.try_divide(F.col("factor"), F.col("base_factor"))
    return joined.select(*[(F.col(c) * worth).alias(c) if c in quantities else F.col(c) for c in sums.columns], "base_unit")
