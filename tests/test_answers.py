import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspan.operators import refine
from loomspan.operators.refine import Filter, RefinePlan, Refused
from loomspan.plans import answers, discovery
from loomspan.plans.toolset import BY_NAME
from loomspan.plans.views import CATALOG
from loomspan.sources import copies
from loomspan.sources.keyed import KeyedTable, files
from loomspan.sources.store import Copies

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shown(spark):
    df = spark.createDataFrame([(i, f"Buyer {i % 3}", "ASIA" if i % 2 else "EUROPE", i * 5, i / 7) for i in range(12)], "OrderID int, Buyer string, Factory string, OrderQty int, DHU double")
    return refine.ordered(df, F.col("OrderID"))


@pytest.mark.parametrize(
    "text,plan",
    [
        ("only ASIA", RefinePlan((Filter("Factory", "in", ("ASIA",)),))), ("group by buyer", RefinePlan(group_by="Buyer")), ("total of order qty where factory is europe", RefinePlan((Filter("Factory", "eq", "europe"),), scalar=("total", "OrderQty"))),
        ("how many", RefinePlan(scalar=("count", None))), ("how many different buyer", RefinePlan(scalar=("count", "Buyer"))), ("top 5 sorted by order qty desc", RefinePlan(sort=("OrderQty", True), limit=5)),
        ("with order qty more than 20", RefinePlan((Filter("OrderQty", "gt", 20.0),))), ("distinct buyer", RefinePlan(distinct="Buyer")), ("next page", RefinePlan(page=2)), ("last 3 rows", RefinePlan(limit=3, from_end=True)), ("thank you", None),
    ],
)
def test_follow_ups(shown, text, plan):
    assert answers.parse(text, shown) == plan


def test_rates_are_not_added(shown):
    with pytest.raises(Refused):
        answers.parse("total of dhu", shown)


def test_asking_again(spark):
    loaded, tool = CATALOG.load(spark, SF), BY_NAME["orders_by_factory_pcd_window"]
    assert answers.needs_requery(RefinePlan(page=2), [], False) and answers.needs_requery(RefinePlan(sort=("a", True)), ["a"], True) and answers.needs_requery(RefinePlan((Filter("b", "eq", 1),)), ["a"], False) == "no column b"
    assert answers.needs_requery(RefinePlan(limit=3), ["a"], True) is None
    first, second = (answers.requery(loaded, tool, {}, RefinePlan(page=n), 5).collect() for n in (1, 2))
    assert first == tool.frame(loaded).take(5) and second == tool.frame(loaded).take(10)[5:]
    assert answers.requery(loaded, tool, {}, RefinePlan((Filter("Factory", "eq", "EUROPE"),), scalar=("count", None))).first()[0] == loaded.view("vw_ExportOrder").where("Factory = 'EUROPE' AND PCD >= DATE '1997-01-01' AND PCD < DATE '1998-01-01'").count()


def test_repair(spark):
    loaded, tool = CATALOG.load(spark, SF), BY_NAME["orders_by_fileref"]
    name = loaded.view("vw_ExportOrder").where("FileNo NOT LIKE '?%'").first()["FileNo"]
    df, changed = answers.repair(loaded, tool, {"fr": name.lower()})
    assert changed == {"fr": name} and df.count() > 0
    assert answers.repair(loaded, tool, {"fr": name})[1] == {} == answers.repair(loaded, tool, {"fr": "nothing at all"})[1]


def test_answers():
    assert answers.blank([]) and answers.blank([(0,)]) and not answers.blank([(1,)]) and not answers.blank([(0, 0)])
    assert answers.unsupported("Line L-12 made 1,250 pieces and 7", [("L-12", 1250)]) == ["7"]
    assert [answers.cell_text(x) for x in (None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5), 2.50, 3, "a")] == ["—", "2024-01-01", "2024-01-01 05:00", "2.5", "3", "a"]
    assert answers.describe(BY_NAME["qc_summary_window"]).startswith("checked, defects, rejected, dhu, reject_pct, period by Factory of vw_LineDayQuality where Day from")
    turns = [{"rows": [1], "n": 1}, {"kind": "chat"}, {"rows": [2], "n": 2}]
    assert answers.anchor(turns)["n"] == 2 and answers.anchor(turns[:2]) is None
    assert answers.storable([1], "a", {"b"}) == [1] and answers.storable([1], "b", {"b"}) is None and answers.storable(["x" * 600_000], "a", set()) is None


def test_charts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert answers.chart_columns(df, df.collect()) == ("k", "v") and answers.chart_columns(df, df.collect() * 2) is None and answers.chart_columns(df, df.take(1)) is None


def test_discovery(spark):
    found = discovery.assemble(spark, SF, ["region", "customer"])
    assert [t.rows for t in found] == [5, 150] and ("region", "r_name") in discovery.sample_candidates(found)
    assert discovery.sampled(CATALOG.load(spark, SF).table("region"), "r_name") == ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    assert discovery.sampled(CATALOG.load(spark, SF).table("customer"), "c_name") is None
    assert discovery.carried({"a": ["1"]}, {"a": ["0"], "b": ["2"], "c": []}, {"c"}) == {"a": ["1"], "b": ["2"]}
    log = spark.createDataFrame([("SELECT * FROM a JOIN b ON 1 = 1",), ("select x from a",)], "statement string")
    assert {r["table"]: r["n"] for r in discovery.usage(log).collect()} == {"a": 2, "b": 1}


def test_keyed_tables(spark, tmp_path):
    t, now = KeyedTable(Copies(spark, f"file://{tmp_path}"), "vectors", "id"), dt.datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame(r, "id int, source string, flag string")
    t.upsert(rows((1, "a", "x"), (2, "a", "x"), (3, "b", "x")), now)
    t.upsert(rows((2, "a", "new"), (4, "b", "x")), now)
    assert {(r["id"], r["flag"]) for r in t.read().collect()} == {(1, "x"), (2, "new"), (3, "x"), (4, "x")}
    t.replace_source(rows((9, "a", "x")), "a", now)
    t.set(F.col("id") == 3, now, flag="old")
    t.delete(F.col("id") == 4, now)
    assert {(r["id"], r["flag"]) for r in t.read().collect()} == {(9, "x"), (3, "old")} and t.get([3]).count() == 1


def test_files(spark, tmp_path):
    for name in ("a/x.pdf", "b/x.pdf", "b/y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    assert [(r["name"], r["size"]) for r in files(spark, str(tmp_path)).collect()] == [("x.pdf", 3)] * 2


def test_refresh(spark, tmp_path):
    kept = Copies(spark, f"file://{tmp_path}")
    assert copies.refresh(CATALOG.load(spark, SF), kept, dt.datetime(2024, 1, 1), ["company_master", "values_issue_causes"]) == {}
    assert kept.read("company_master").count() == 5 and kept.missing(list(copies.SPECS)) == [n for n in copies.SPECS if n not in ("company_master", "values_issue_causes")]
    assert copies.daily_plan(dt.datetime(2024, 1, 1), ["06:00"], []) == dt.datetime(2024, 1, 1, 6) and copies.seconds_until(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1)) == 60
