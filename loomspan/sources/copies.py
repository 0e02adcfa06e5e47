"""The copies that are refreshed every night: what each holds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Loaded
from .store import Copies, next_run

SPECS: dict[str, tuple[str, Callable[[Loaded], DataFrame]]] = {
    "pcd_history": ("ExportOrderID", lambda c: c.view("vw_PCDChangeHistory").select("ExportOrderID", "VersionNo", "Factory", "ShipDate", "UpdatedBy", "Flag")),
    "company_master": ("Factory", lambda c: c.view("vw_Company").select("Factory", "CompanyID", "Short")),
    "values_stores": ("name", lambda c: c.view("vw_Store").select(F.col("Store").alias("name"), F.col("StoreID").cast("string").alias("code"), "Factory").distinct()),
    "values_companies": ("name", lambda c: c.view("vw_Company").select(F.col("Factory").alias("name"), F.col("CompanyID").cast("string").alias("code"))),
    "values_item_categories": ("name", lambda c: c.view("vw_Item").select(F.col("Category").alias("name")).distinct()),
    "values_store_groups": ("name", lambda c: c.view("vw_Item").select(F.col("ItemGroup").alias("name")).distinct()),
    "values_issue_causes": ("name", lambda c: c.view("vw_StockIssue").groupBy(F.col("Cause").alias("name")).agg(F.count("*").alias("n"))),
    "values_prep_buyers": ("code", lambda c: c.view("b_order").groupBy(F.col("BuyerID").cast("string").alias("code")).agg(F.max("Buyer").alias("name")).where(F.length("name") > 2)),
}

SQL = {
    "pcd_history": "SELECT ExportOrderID, VersionNo, Factory, CAST(ShipDate AS varchar) AS ShipDate, UpdatedBy, Flag FROM vw_PCDChangeHistory",
    "company_master": "SELECT Factory, CompanyID, Short FROM vw_Company",
    "values_stores": "SELECT DISTINCT Store AS name, CAST(StoreID AS varchar) AS code, Factory FROM vw_Store",
    "values_companies": "SELECT Factory AS name, CAST(CompanyID AS varchar) AS code FROM vw_Company",
    "values_item_categories": "SELECT DISTINCT Category AS name FROM vw_Item",
    "values_store_groups": "SELECT DISTINCT ItemGroup AS name FROM vw_Item",
    "values_issue_causes": "SELECT Cause AS name, count(*) AS n FROM vw_StockIssue GROUP BY Cause",
    "values_prep_buyers": "SELECT CAST(BuyerID AS varchar) AS code, max(Buyer) AS name FROM b_order GROUP BY BuyerID HAVING length(max(Buyer)) > 2",
}


def refresh(loaded: Loaded, copies: Copies, now: dt.datetime, names: list[str] | None = None) -> dict[str, str]:
    """Refreshes copies; errors by name. A copy whose refresh fails stays as it was."""
    errors = {}
    for name in names or list(SPECS):
        key, make = SPECS[name]
        try:
            copies.write(name, make(loaded), now, sort=key)
        except Exception as e:  # noqa: BLE001  one copy's failure must not stop the others
            errors[name] = str(e).splitlines()[0]
    return errors


def daily_plan(now: dt.datetime, times: list[str], missing: list[str]) -> dt.datetime:
    """At once if a copy was never built, else at the next time."""
    return now if missing else next_run(now, times)


def seconds_until(now: dt.datetime, then: dt.datetime) -> float:
    return max(0.0, (then - now).total_seconds())
