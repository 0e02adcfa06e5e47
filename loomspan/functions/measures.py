"""Measures: sums, and ratios that are ratios of sums, never averages of ratios. Portable SQL and Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(column: str) -> str:
    return f"CAST(sum({column}) AS bigint)"


def ratio(part: str, whole: str, digits: int = 2) -> str:
    """100 x sum(part) / sum(whole); null where there is nothing to divide by."""
    return f"round(100.0 * sum({part}) / nullif(sum({whole}), 0), {digits})"


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """The same for Columns."""
    return F.round(F.try_divide(100.0 * F.sum(part), F.nullif(F.sum(whole), F.lit(0))), digits)


def weighted(target: Column, worked: Column, session: Column) -> Column:
    """Sum of targets by the share of the session that was worked; the whole target where either is missing."""
    return F.sum(target * F.coalesce(F.try_divide(worked, F.nullif(session, F.lit(0))), F.lit(1.0)))


def date_label(dialect, column: str) -> str:
    """One day, or the first and the last."""
    low, high = dialect.text_of(f"min({column})"), dialect.text_of(f"max({column})")
    return f"CASE WHEN min({column}) = max({column}) THEN {low} ELSE {low} || ' to ' || {high} END"


#: The measures that a question may name, over a view with the columns of inspections.
MEASURES = {
    "checked": total("Checked"), "defects": total("Defects"), "rejected": total("Rejected"), "passed": total("Passed"), "defective": total("DefectivePcs"), "rectified": total("Rectified"),
    "dhu": ratio("Defects", "Checked"), "reject_pct": ratio("Rejected", "Checked"), "pass_pct": ratio("Passed", "Checked"), "defective_pct": ratio("DefectivePcs", "Checked"), "rectified_pct": ratio("Rectified", "DefectivePcs"),
    "days": "count(DISTINCT Day)",
}
