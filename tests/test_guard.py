import pytest

from loomspan.plans.catalog import Catalog, View
from loomspan.plans.guard import Denied, guard, lineage, read, validate_definition
from loomspan.plans.routing import run_pasted
from loomspan.plans.scope import Scope
from loomspan.plans.views import CATALOG

OK = {"ok": ["x", "y", "password"], "other": ["x", "z"]}
SF = "/root/testdata/sf0.001"


def passes(spark, sql, **more):
    return guard(spark, sql, set(OK), columns=OK, **more)


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System','getProperty','user.home') FROM ok", "SELECT java_method('java.lang.System','exit',1) FROM ok", "SELECT try_reflect('java.lang.System','getProperty','user.home') FROM ok",
    "SELECT x FROM IDENTIFIER('secr'||'et')", "SELECT x FROM IDENTIFIER('ok')", "SELECT IDENTIFIER('pass'||'word') FROM ok", "TABLE ok", "FROM ok |> LIMIT 900", "FROM ok", "SELECT input_file_name() FROM ok", "SELECT raise_error('x') FROM ok",
    "SELECT assert_true(x = 1) FROM ok", "SELECT current_user() FROM ok", "SELECT version() FROM ok", "SELECT spark_catalog.default.f(x) FROM ok", "SELECT ai(x) FROM ok", "SELECT * FROM ok LATERAL VIEW explode(array(1)) t AS e", "SELECT explode(array(x)) FROM ok",
    "SELECT x FROM ok TABLESAMPLE (1 PERCENT)", "SELECT x FROM ok VERSION AS OF 1", "SELECT TRANSFORM(x) USING 'cat' FROM ok", "SELECT :p FROM ok", "SELECT x FROM ok WHERE x = ?", "WITH RECURSIVE r AS (SELECT x FROM ok UNION ALL SELECT x FROM r) SELECT x FROM r",
    "EXPLAIN SELECT x FROM ok", "SHOW TABLES", "DESCRIBE ok", "CACHE TABLE ok", "SELECT x FROM parquet.`/root/testdata`", "SELECT x FROM ok WHERE x IN (TABLE secret)", "SELECT x, (SELECT max(a) FROM secret) FROM ok", "SELECT * FROM (VALUES (1)) v", "",
])
def test_what_is_not_listed_is_denied(spark, sql):
    with pytest.raises(Denied):
        passes(spark, sql)


@pytest.mark.parametrize("sql", [
    "WITH t AS (SELECT password AS p FROM ok) SELECT p FROM t", "WITH t(a, b, c) AS (TABLE ok) SELECT c FROM t", "SELECT c FROM (TABLE ok) AS t(a, b, c)", "SELECT a.c FROM ok AS a(x1, y1, c)", "SELECT t.c FROM (SELECT x, y, password FROM ok) t(a, b, c)",
    "SELECT length(`password`) AS n FROM ok", "SELECT x FROM ok WHERE password = 'a'", "SELECT x FROM ok ORDER BY password", "SELECT count(*) FROM ok GROUP BY password", "SELECT x FROM ok NATURAL JOIN (SELECT 'a' AS password) p", "SELECT x FROM ok o JOIN ok USING (password)",
    "TABLE ok UNION ALL SELECT x, x, x FROM other", "SELECT count(*) FROM (TABLE ok EXCEPT SELECT 1, 2, 'a') d(a, b, c)", "SELECT ok.* FROM ok JOIN other USING (x)", "SELECT x FROM ok WHERE (x, y, 'a') IN (TABLE ok)",
    "SELECT (SELECT max(c) FROM ok AS t(a, b, c)) FROM other", "SELECT x FROM other WHERE EXISTS (SELECT 1 FROM ok AS t(a, b, c) WHERE c = 'a')", "SELECT max(c) OVER () FROM ok AS t(a, b, c)", "SELECT c FROM ok AS t(a, b, c) GROUP BY ROLLUP(c)", "FROM ok AS t(a, b, c) |> SELECT c",
])
def test_hidden_columns_under_any_name(spark, sql):
    with pytest.raises(Denied):
        passes(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT x, count(*) AS n FROM ok GROUP BY x", "SELECT count(*) FROM ok", "WITH t AS (SELECT x, y FROM ok) SELECT * FROM t", "SELECT o.x, z FROM ok o LEFT JOIN other USING (x) WHERE y BETWEEN '1' AND '3'", "FROM ok |> SELECT x |> LIMIT 9", "SELECT * FROM other",
    "SELECT x, rank() OVER (PARTITION BY y ORDER BY x DESC) AS r FROM ok", "SELECT x FROM ok UNION SELECT z FROM other ORDER BY 1", "SELECT coalesce(x, 'a') || upper(y) FROM ok WHERE y LIKE 'a%' AND x IN (SELECT x FROM other)", "SELECT y, sum(x) FROM ok GROUP BY ROLLUP(y) HAVING sum(x) > 1",
    "SELECT x FROM ok WHERE EXISTS (SELECT 1 FROM other WHERE other.x = ok.x)", "SELECT CAST(x AS int), CASE WHEN y = '1' THEN 1 ELSE 2 END FROM ok WHERE NOT (x = '1' OR y IS NULL)", "SELECT string_agg(x, ',') FROM ok", "SELECT * EXCEPT (password) FROM ok", "SELECT a FROM ok AS t(a, b, c)",
])
def test_what_is_offered_passes(spark, sql):
    assert passes(spark, sql)


def test_a_large_table_needs_a_condition_on_its_own_columns(spark):
    big = {"ok": 2_000_000}
    for where in ("x = x", "1 = 1", "x = x || ''", "x LIKE '%'", "x IS NOT NULL", "x = '1' OR true", "NOT (x = x)"):
        with pytest.raises(Denied):
            passes(spark, f"SELECT x FROM ok WHERE {where}", rows=big)
    with pytest.raises(Denied):
        passes(spark, "SELECT ok.x FROM ok JOIN other USING (x) WHERE z = '1'", rows=big)
    for sql in ("SELECT x FROM ok WHERE x = '1'", "SELECT x FROM ok WHERE y BETWEEN '1' AND '2'", "WITH t AS (SELECT x, y AS k FROM ok) SELECT x FROM t WHERE k > '1'", "SELECT x FROM ok WHERE x IN (SELECT x FROM other)", "SELECT ok.x FROM ok JOIN other ON ok.x = other.x AND ok.y = '2'", "SELECT x FROM other"):
        assert passes(spark, sql, rows=big)


def test_lineage_goes_through_renames_and_sets(spark):
    traced = lineage(spark, "WITH t AS (SELECT x + y AS s FROM ok), u AS (SELECT s AS v FROM t UNION ALL SELECT z FROM other) SELECT max(v) AS m FROM u", {"ok": {"x": "int", "y": "int"}, "other": {"z": "int"}})
    assert traced.shown == {("ok", "x"), ("ok", "y"), ("other", "z")}


def test_definitions_of_views(spark):
    names = {"orders", "b_order"}
    validate_definition(spark, "SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY o_orderkey", names)
    for body in ("", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT k FROM orders ORDER BY k", "SELECT k FROM orders LIMIT 3", "SELECT k FROM elsewhere", "SELECT reflect('a','b') FROM orders", "SELECT k FROM orders WHERE k = :p", "TABLE orders", "DROP TABLE orders", "SELECT a FROM range(3)"):
        with pytest.raises(Denied):
            validate_definition(spark, body, names)


def test_bodies_are_validated_when_they_are_loaded(spark):
    view = lambda name, body: View(name, "one", ("k",), {"k": "int"}, lambda d: body, base=True)
    for body in ("SELECT reflect('java.lang.System','nanoTime') AS k FROM orders", "SELECT n_nationkey AS k FROM vw_later", "SELECT o_orderkey AS other FROM orders"):
        with pytest.raises(Denied):
            Catalog([view("vw_x", body), view("vw_later", "SELECT n_nationkey AS k FROM nation")]).load(spark, SF).view("vw_x")
    for name in CATALOG.views:
        CATALOG.load(spark, SF).view(name)


def test_pasted_statements_run_in_scope(spark):
    loaded = CATALOG.load(spark, SF, Scope(("ASIA",)))
    got = run_pasted(loaded, "WITH t AS (SELECT Factory AS f, Status AS s FROM vw_ExportOrder) SELECT f, s, count(*) AS n FROM t GROUP BY f, s")
    assert {r["f"] for r in got.collect()} == {"ASIA"}
    for sql in ("SELECT * FROM orders", "SELECT reflect('java.lang.System','nanoTime') FROM vw_ExportOrder", "TABLE b_order"):
        with pytest.raises(Denied):
            run_pasted(loaded, sql)
    assert read(spark, "FROM ok |> LIMIT 900").limit == 900
