import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan import suite
from loomspan.functions import modifiers, periods
from loomspan.plans import routing
from loomspan.plans.guard import Denied, guard, read, scoped
from loomspan.plans.scope import NoAccess, Scope
from loomspan.plans.toolset import BY_NAME, TOOLS
from loomspan.plans.values import closest
from loomspan.plans.views import CATALOG, PUBLIC

SF = "/root/testdata/sf0.001"
T = dt.date(2024, 5, 15)  # a Wednesday
D = dt.date


def test_everything_is_listed():
    assert len(PUBLIC) == 41 and len([n for n in suite.queries() if n.startswith("tool_")]) == 73 and len([n for n in suite.queries() if n.startswith("dq_")]) == 34
    assert set(suite.oracle_sql()) <= set(suite.queries())


@pytest.mark.parametrize(
    "text,window",
    [
        ("output yesterday", (D(2024, 5, 14), D(2024, 5, 15))), ("today", (T, D(2024, 5, 16))), ("tomorrow", (D(2024, 5, 16), D(2024, 5, 17))),
        ("this week", (D(2024, 5, 13), D(2024, 5, 20))), ("next week", (D(2024, 5, 20), D(2024, 5, 27))), ("last week", (D(2024, 5, 6), D(2024, 5, 13))),
        ("last month", (D(2024, 4, 1), D(2024, 5, 1))), ("this month", (D(2024, 5, 1), D(2024, 6, 1))), ("next month", (D(2024, 6, 1), D(2024, 7, 1))),
        ("last 7 days", (D(2024, 5, 8), D(2024, 5, 16))), ("next 7 days", (T, D(2024, 5, 22))), ("anything", (T, D(2024, 5, 22))),
        ("on 3 May 2023", (D(2023, 5, 3), D(2023, 5, 4))), ("on 2024-02-29", (D(2024, 2, 29), D(2024, 3, 1))), ("on 20 May", (D(2023, 5, 20), D(2023, 5, 21))),
        ("from 2024-01-01 to 2024-01-31", (D(2024, 1, 1), D(2024, 2, 1))), ("1/2/2024", (D(2024, 2, 1), D(2024, 2, 2))),
        ("on wednesday", (T, D(2024, 5, 16))), ("last wednesday", (D(2024, 5, 8), D(2024, 5, 9))), ("monday", (D(2024, 5, 13), D(2024, 5, 14))),
        ("in march", (D(2024, 3, 1), D(2024, 4, 1))), ("in june", (D(2023, 6, 1), D(2023, 7, 1))), ("december 2020", (D(2020, 12, 1), D(2021, 1, 1))),
    ],
)
def test_periods(text, window):
    assert periods.window(text, T)[0] == window


def test_a_range_that_ends_before_it_begins():
    assert periods.window("2024-02-01 to 2024-01-01", T) is None and periods.wider("today") == ("yesterday", "this week")


@pytest.mark.parametrize(
    "text,rest,mods",
    [
        ("orders of ASIA sorted by order qty desc", "orders of ASIA", modifiers.Modifiers("order qty", True)), ("top 5 lines", "lines", modifiers.Modifiers(limit=5)),
        ("bottom 3 rows of the list", "of the list", modifiers.Modifiers(limit=3, from_end=True)), ("output last 7 days", "output last 7 days", modifiers.Modifiers()),
        ("only 4 rows, order by PCD", "", modifiers.Modifiers("PCD", False, 4)),
    ],
)
def test_modifiers(text, rest, mods):
    assert modifiers.strip(text) == (rest, mods)


def test_columns_by_loose_names():
    columns = ["ExportOrderID", "OrderQty", "ShipDate", "Buyer", "PCD"]
    assert [modifiers.resolve_column(x, columns, {"quantity": "OrderQty"}) for x in ("buyer", "order qty", "quantity", "ship", "shpi date", "order", "zzz")] == ["Buyer", "OrderQty", "OrderQty", "ShipDate", "ShipDate", None, None]


def test_sensitive_names():
    assert [modifiers.sensitive(x) for x in ("UserPassword", "BasicSalary", "NID", "nids", "unidentified", "Buyer", "email_address")] == [True, True, True, True, False, False, True]


GOOD = ["SELECT a FROM vw_x", "WITH c AS (SELECT a FROM vw_x) SELECT * FROM c ORDER BY a", "SELECT count(*) FROM vw_x WHERE a IN (SELECT b FROM vw_y)"]
BAD = ["DROP TABLE vw_x", "SELECT 1; SELECT 2", "SELECT a FROM secret", "SELECT 'drop' FROM vw_x", "DELETE FROM vw_x", "SELECT a -- c\nFROM vw_x", "SELECT @@version", "INSERT INTO vw_x VALUES (1)", "SELEC a", "SHOW TABLES", "SELECT a INTO b FROM vw_x", "SELECT x FROM information_schema.tables", "SET a = 1", "DESCRIBE vw_x"]


def test_the_guard(spark):
    for sql in GOOD:
        assert guard(spark, sql, {"vw_x", "vw_y"}).endswith("LIMIT 200")
    for sql in BAD:
        with pytest.raises(Denied):
            guard(spark, sql, {"vw_x", "vw_y"})
    assert guard(spark, "SELECT a FROM vw_x LIMIT 10", {"vw_x"}) == "SELECT a FROM vw_x LIMIT 10"
    assert read(spark, GOOD[1]).relations == ("vw_x",)
    with pytest.raises(Denied):
        guard(spark, "SELECT * FROM raw", {"raw"}, raw={"raw"})
    assert guard(spark, "SELECT count(*) FROM raw", {"raw"}, raw={"raw"})
    with pytest.raises(Denied):
        guard(spark, "SELECT a FROM big", {"big"}, rows={"big": 2_000_000})
    assert guard(spark, "SELECT a FROM big WHERE a > 1", {"big"}, rows={"big": 2_000_000})
    with pytest.raises(Denied):
        guard(spark, "SELECT Salary FROM raw", {"raw"}, columns={"raw": ["Salary"]})


def test_scope(spark):
    asia = CATALOG.load(spark, SF, Scope(("ASIA",)))
    assert {r[0] for r in asia.view("vw_LineDayQuality").select("Factory").distinct().collect()} == {"ASIA"}
    assert scoped(asia.view("vw_LineDayQuality"), "Factory", ("ASIA",)) and not scoped(CATALOG.load(spark, SF).view("vw_LineDayQuality"), "Factory", ("ASIA",))
    assert asia.sql("SELECT count(DISTINCT Factory) AS n FROM vw_Store").first()["n"] == 1
    with pytest.raises(NoAccess):
        CATALOG.load(spark, SF, Scope(())).view("vw_Store")
    with pytest.raises(ValueError):
        Scope(("x'; drop",))
    assert Scope(("a", "b")).key() == Scope(("b", "a")).key() != Scope(("a",)).key()


def test_scope_is_pushed_below_the_aggregation(spark):
    df = CATALOG.load(spark, SF, Scope(("ASIA",))).view("vw_LineDayQuality").groupBy("Factory").agg(F.sum("Checked"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("ASIA") > plan.rindex("Aggregate") and "PushedFilters: [" in df._jdf.queryExecution().executedPlan().toString()


def test_pasted_statements(spark):
    loaded = CATALOG.load(spark, SF, Scope(("ASIA",)))
    assert [r[0] for r in routing.run_pasted(loaded, "SELECT DISTINCT Factory FROM vw_Store").collect()] == ["ASIA"]
    with pytest.raises(Denied):
        routing.run_pasted(loaded, "SELECT * FROM orders")


def test_tools_take_only_listed_words(spark):
    loaded, tool = CATALOG.load(spark, SF), BY_NAME["quality_by_group_window"]
    assert tool.frame(loaded, dims=("Factory", "Line"), measures=("checked",)).columns == ["Factory", "Line", "period", "checked"]
    for bad in ({"dims": ("Password",)}, {"measures": ("1; drop",)}):
        with pytest.raises(ValueError):
            tool.frame(loaded, **bad)
    with pytest.raises(ValueError):
        BY_NAME["orders_by_factory_ship_window"].frame(loaded, order_by="Buyer; drop")
    with pytest.raises(ValueError):
        BY_NAME["orders_by_factory_pcd_window"].frame(loaded, factory="")


def test_an_optional_parameter_leaves_no_predicate(spark):
    loaded, tool = CATALOG.load(spark, SF), BY_NAME["fabric_bowing_by_roll"]
    plan = lambda **p: tool.frame(loaded, **p)._jdf.queryExecution().analyzed().toString()
    assert "Buyer#" in plan(buyer="x") and "= x" in plan(buyer="x") and "= x" not in plan()


def test_values_are_literals_not_text(spark):
    loaded = CATALOG.load(spark, SF)
    assert BY_NAME["eo_by_po"].frame(loaded, po="x' OR '1'='1").count() == 0
    assert "''" in BY_NAME["eo_by_po"].statement(CATALOG, po="x' OR '1'='1")


def test_every_tool_runs(spark):
    loaded = CATALOG.load(spark, SF)
    for tool in TOOLS:
        assert tool.frame(loaded).columns


MATCHES = [routing.Match(r"orders? (?:of|in) (\w+)", "orders_by_factory_ship_window", ("factory",), unless="cancel", needs_window=True, upper=("factory",)), routing.Match(r"\bEO (\d+)", "eo_by_id", ("eo",), whole=("eo",))]


def test_matching():
    tool, params, mods = routing.match_tool("top 3 orders in asia last month", MATCHES, BY_NAME, T)
    assert (tool.name, params["factory"], params["from"], mods.limit) == ("orders_by_factory_ship_window", "ASIA", D(2024, 4, 1), 3)
    assert routing.match_tool("EO 33 please", MATCHES, BY_NAME, T)[1] == {"eo": 33}
    assert routing.match_tool("cancelled orders in asia", MATCHES, BY_NAME, T) is None
    assert routing.match_tool("orders in asia 2024-02-01 to 2024-01-01", MATCHES, BY_NAME, T) is None


def test_routing():
    sources = [routing.Source("Inventory", ("stock", "store"), ("ItemName", "Balance"), ("ASIA",)), routing.Source("Quality", ("dhu", "defect"), ("Line", "Checked"), ("EUROPE",)), routing.Source("Other")]
    assert routing.pick("stock of item", sources) == ["Inventory"] and routing.pick("defect by line", sources, "EUROPE") == ["Quality"] and routing.pick("hello", sources) == []
    assert routing.pick_agent("late shipment", {"a": ("late",), "b": ("shipment",)}) is None and routing.pick_agent("late late", {"a": ("late",), "b": ("x",)}) == "a"
    assert routing.pick_agent("late shipment", {"a": ("late",), "b": ("shipment",)}, databases={"d": "b"}) == "b"


def test_tables():
    t = [routing.TableInfo("Order", ("Id", "BuyerId", "Qty"), ("Id",), {"BuyerId": "Buyer"}), routing.TableInfo("Buyer", ("Id", "Name"), ("Id",)), routing.TableInfo("Log", ("OrderId", "At"), ())]
    assert routing.neighbours(t, ["Buyer"]) == ["Order"] and routing.neighbours(t, ["Order"]) == ["Buyer"]
    assert routing.join_hints(t[0], t[1]) == [("BuyerId", "Id")] and routing.join_hints(t[0], t[2]) == [("Id", "OrderId")]
    assert routing.search_tables("quantity of order by buyer", t)[0] in ("Order", "Buyer")
    assert routing.suggestions("orders of asia", [("x", "orders of europe", ""), ("y", "stock", "")]) == ["x"]


def test_rewrites():
    assert routing.beyond(D(2024, 1, 1), (D(2024, 1, 1), D(2024, 1, 31))) and routing.beyond(D(2024, 1, 30), (D(2024, 1, 1), D(2024, 1, 31))) is None
    assert closest("byer house", ["Buyer House", "Other"]) == "Buyer House" and closest("abc", ["abd", "abe"]) is None and closest("X", ["x"]) == "x"


@pytest.mark.parametrize(
    "text,days",
    [
        ("may i see the orders", (D(2026, 11, 5), D(2026, 11, 12))), ("october 12 2026", (D(2026, 10, 12), D(2026, 10, 13))), ("12.10.2026", (D(2026, 10, 12), D(2026, 10, 13))),
        ("12-10-25", (D(2025, 10, 12), D(2025, 10, 13))), ("yesterdays report", (D(2026, 11, 4), D(2026, 11, 5))), ("toady", (D(2026, 11, 5), D(2026, 11, 6))), ("the 12th of October", (D(2026, 10, 12), D(2026, 10, 13))),
        ("Oct. 7th to 9 oct", (D(2026, 10, 7), D(2026, 10, 10))), ("line 3 and 4", (D(2026, 11, 5), D(2026, 11, 12))), ("today's output", (D(2026, 11, 5), D(2026, 11, 6))),
    ],
)
def test_written_days(text, days):
    assert periods.window(text, D(2026, 11, 5))[0] == days


def test_days_that_do_not_exist_are_refused():
    assert periods.window("31-02-2026", T) is None and periods.window("30 february", T) is None


def test_what_slipped_through_the_guard(spark):
    denied = ["WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM ok) SELECT * FROM a", "SELECT x, password FROM ok", "SELECT * FROM range(10)", "SELECT x FROM ok WHERE y IN (SELECT y FROM secret)", "SELECT original_login() FROM ok"]
    for sql in denied:
        with pytest.raises(Denied):
            guard(spark, sql, {"ok"})
    inner = "SELECT a.x FROM ok a CROSS JOIN (SELECT y FROM ok LIMIT 5) b"
    assert guard(spark, inner, {"ok"}).endswith("LIMIT 200") and guard(spark, "WITH a AS (SELECT x FROM ok) SELECT x FROM a LIMIT 7", {"ok"}).endswith("LIMIT 7")
    with pytest.raises(Denied):
        guard(spark, "SELECT a FROM big WHERE 1 = 1", {"big"}, rows={"big": 2_000_000})
    with pytest.raises(Denied):
        guard(spark, "SELECT * FROM staff", {"staff"}, columns={"staff": ["Name", "Salary"]})


def odd_star(folder):
    """A small star schema at ``folder`` with copies of rows, unknown keys and nulls; an engine that has its tables as views."""
    con = duckdb.connect()
    tables = {
        "region": "(VALUES (0, 'ASIA'), (1, 'EUROPE'), (2, 'ASIA')) t(r_regionkey, r_name)",
        "nation": "(VALUES (0, 'INDIA', 0), (1, 'FRANCE', 1), (2, 'CHINA', 2), (3, 'NOWHERE', NULL)) t(n_nationkey, n_name, n_regionkey)",
        "supplier": "(SELECT CAST(i AS bigint) AS s_suppkey, 's' || i AS s_name, CAST(i % 4 AS int) AS s_nationkey, 0.0::double AS s_acctbal FROM range(9) t(i))",
        "customer": "(SELECT CAST(i AS bigint) AS c_custkey, 'c' || i AS c_name, CAST(i % 5 AS int) AS c_nationkey, 0.0::double AS c_acctbal, 'x' AS c_mktsegment FROM range(9) t(i))",
        "part": "(SELECT CAST(i AS bigint) AS p_partkey, 'p' || i AS p_name, nullif('b' || i % 3, 'b2') AS p_brand, 't' AS p_type, CAST(i % 2 AS int) AS p_size, 1.5::double AS p_retailprice FROM range(20) t(i) UNION ALL SELECT 3, 'p3', 'b0', 't', 1, 1.5 UNION ALL SELECT 4, 'other', 'b1', 't', 0, 1.5 UNION ALL SELECT NULL, 'none', 'b1', 't', 0, 1.5)",
        "orders": "(SELECT CAST(i AS bigint) AS o_orderkey, CAST(i % 11 AS bigint) AS o_custkey, 'F' AS o_orderstatus, 1.0::double AS o_totalprice, TIMESTAMP '2000-01-01' + to_days(CAST(i AS int)) AS o_orderdate, '1' AS o_orderpriority FROM range(40) t(i) UNION ALL SELECT 7, 8, 'F', 1.0, TIMESTAMP '2000-01-01', '1')",
        "lineitem": "(SELECT CAST(i // 5 AS bigint) AS l_orderkey, nullif(CAST(i * 7 % 23 AS bigint), 5) AS l_partkey, CAST(i % 10 AS bigint) AS l_suppkey, CAST(i % 5 AS int) AS l_linenumber, nullif(CAST(i % 50 AS double), 13) AS l_quantity, 1.0::double AS l_extendedprice, 0.0::double AS l_discount, 0.0::double AS l_tax, nullif(['R', 'A', 'N', 'x'][i % 4 + 1], 'x') AS l_returnflag, ['F', 'O'][i % 2 + 1] AS l_linestatus, CASE WHEN i % 17 <> 3 THEN TIMESTAMP '2000-01-01' + to_days(CAST(i * 13 % 400 AS int)) END AS l_shipdate FROM range(300) t(i))",
    }
    for name, rows in tables.items():
        con.sql(f"COPY (SELECT * FROM {rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def agree(spark, con, folder, query):
    df, relation = suite.queries()[query](spark, str(folder)), con.sql(suite.oracle_sql()[query])
    got = Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    return bool(got) and got == Counter(tuple(map(str, r)) for r in relation.select(*[duckdb.ColumnExpression(c) for c in sorted(df.columns)]).fetchall())


def test_items_meet_a_factory_once(spark, tmp_path):
    assert agree(spark, odd_star(tmp_path), tmp_path, "view_Item")
    plan = CATALOG.load(spark, str(tmp_path)).view("vw_Item")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "p_name" in line and "Factory" in line]


def test_subjects_sum_up_days_not_orders(spark, tmp_path):
    con = odd_star(tmp_path)
    assert [q for q in ("settled", "final_window", "risk_levels", "open_predictions") if not agree(spark, con, tmp_path, q)] == []
    for query in ("settled", "final_window"):
        plan = suite.queries()[query](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
        grouped = [line for line in plan if "Aggregate [" in line]
        assert grouped and not [line for line in grouped if "o_orderkey" in line or "OrderID" in line]
        at = next(i for i, line in enumerate(plan) if "Window [max(Day" in line)
        assert "Aggregate [" in plan[at + 1] or "Aggregate [" in plan[at + 2]
