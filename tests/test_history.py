import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.decisions import evaluation
from loomspan.operators import islands, ranks
from loomspan.plans.guard import Denied
from loomspan.plans.routing import run_pasted
from loomspan.plans.views import CATALOG
from loomspan.sources import footers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("buckets,few", [(4, 2), (7, 1), (1024, 4096)])
def test_order_statistics_by_sorting(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    monkeypatch.setattr(ranks, "FEW", few)
    r = random.Random(buckets)
    draw = {"even": lambda: r.random(), "one": lambda: 3.0, "skewed": lambda: math.exp(20 * r.random()), "ties": lambda: float(r.choice([0, 0, 0, 1, 7])), "wide": lambda: r.choice([-1.7e308, 1.7e308, 0.0, 1e-300]), None: lambda: r.gauss(0, 1)}
    rows = [(g, f()) for g, f in draw.items() for _ in range(r.randint(1, 400))]
    rows += [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x["g"]: x for x in ranks.nearest_ranks(df, ["g"], "v", shares).collect()}
    line = {x["g"]: x for x in ranks.interpolated(df.where("g <> 'wide'"), ["g"], "v", {"p1": 0.01, "p50": 0.5}).collect()}
    assert set(got) == set(draw)
    for g in draw:
        v = sorted(x for h, x in rows if h == g and x is not None and not math.isnan(x))
        assert got[g]["n"] == len(v)
        for name, s in shares.items():
            assert got[g][name] == v[max(1, math.ceil(round(s * len(v), 9))) - 1]
        for name, s in {"p1": 0.01, "p50": 0.5}.items() if g in line else ():
            at = s * (len(v) - 1)
            assert line[g][name] == pytest.approx(v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)))
    assert ranks.nearest_ranks(df.limit(0), ["g"], "v", shares).count() == 0
    assert [x["p50"] for x in ranks.nearest_ranks(df.where("g = 'one'"), [], "v", shares).collect()] == [3.0]


def test_carried_until_a_reset(spark):
    """t: a table, x: a reset, b: both, other: neither."""
    said = {1: "a t a x a t t a", 2: "x a t", 3: "t b x b a a a"}
    rows = [(c, i, k) for c, kinds in said.items() for i, k in enumerate(kinds.split())]
    df = spark.createDataFrame(rows, "c int, i int, k string").repartition(3)
    sets, resets = F.col("k").isin("t", "b"), F.col("k").isin("x", "b")

    def brute(most):
        out = {}
        for c, kinds in said.items():
            held = None
            for i, k in enumerate(kinds.split()):
                held = i if k in "tb" else None if k == "x" else held
                out[c, i] = held if held is None or most is None or i - held < most else None
        return out

    for most in (None, 1, 2):
        assert {(r["c"], r["i"]): r["carried"] for r in islands.carried(df, ["c"], ["i"], "i", sets, resets, most).collect()} == brute(most)
    after = islands.followed(df, ["c"], ["i"], F.col("k") == "t", then="i").collect()
    assert {(r["c"], r["i"]): r["then"] for r in after} == {(c, i): i + 1 if i + 1 < len(k.split()) and k.split()[i + 1] == "t" else None for c, k in said.items() for i in range(len(k.split()))}


def test_the_first_at_or_after(spark):
    r = random.Random(4)
    left = [(i, r.choice("ab"), r.randint(0, 30)) for i in range(60)]
    right = [(i, r.choice("abc"), r.randint(0, 30)) for i in range(40)]
    l, q = spark.createDataFrame(left, "i int, u string, at int"), spark.createDataFrame(right, "j int, u string, seen int")  # noqa: E741
    got = {x["i"]: (x["j"], x["when"]) for x in islands.next_of(l, q, ["u"], "at", "seen", {"j": "j", "when": "seen"}, "j").collect()}
    want = {i: min(((s, j) for j, v, s in right if v == u and s >= at), default=(None, None))[::-1] for i, u, at in left}
    assert got == want


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id string, case_id int, kind string, hit int, faithful int, correct int, citation_valid int, outage boolean")


def test_baseline_is_the_newest_whole_run_that_covers_all_cases(spark):
    row = lambda run, case, correct=1, kind="data", outage=False: (run, case, kind, 1, None, correct, 1, outage)
    rows = [row("r1", c) for c in range(5)] + [row("r2", c) for c in range(9)] + [row("r3", c) for c in (0, 1, 3, 9)] + [row("r4", c) for c in range(4)] + [row("r4", 7, None)] + [row("r6", c, 0) for c in range(4)] + [row("r9", c) for c in range(4)]
    df = runs(spark, rows)
    assert [r[0] for r in evaluation.baseline(df, "r6").collect()] == ["r2"]
    assert evaluation.baseline(df, "r1").count() == 0 and evaluation.compared(df, "r1").count() == 0
    again = runs(spark, rows + [row("r3", 2), row("r3", 2)])
    assert [r[0] for r in evaluation.baseline(again, "r6").collect()] == ["r3"]
    got = {r["score"]: (r["before"], r["after"], r["cases"], r["blocked"]) for r in evaluation.compared(df, "r6").collect()}
    assert got == {"hit_rate": (1.0, 1.0, 4, False), "correctness": (1.0, 0.0, 4, True), "citation_validity": (1.0, 1.0, 4, False)}


def test_gaps_and_redefined_cases_count_on_neither_side(spark):
    rows = [("a", 1, "data", 1, 1, 1, 1, False), ("a", 2, "data", 1, 1, 1, 1, False), ("a", 3, "not_found", 1, 1, 1, 1, False), ("b", 1, "data", 0, 1, 1, 1, False), ("b", 2, "refuse", 0, 0, 0, 0, False), ("b", 3, "not_found", 0, 0, 0, 0, True)]
    got = {r["score"]: (r["before"], r["after"], r["cases"]) for r in evaluation.compared(runs(spark, rows), "b").collect()}
    assert got == {"hit_rate": (1.0, 0.0, 1), "faithfulness": (1.0, 1.0, 1), "correctness": (1.0, 1.0, 1), "citation_validity": (1.0, 1.0, 1)}


def test_footers_answer_without_a_scan(spark):
    for name, columns in {"lineitem": ["l_orderkey", "l_shipdate", "l_quantity"], "events": ["ts", "event_id"], "orders": [], "customer": ["c_custkey"]}.items():
        found = footers.bounds(spark, f"{SF}/{name}.parquet", columns)
        assert footers.only_footers(found)
        scanned = spark.read.parquet(f"{SF}/{name}.parquet").agg(F.count("*"), *[f(c) for c in columns for f in (F.min, F.max)])
        assert tuple(found.first()) == tuple(scanned.first()) and not footers.only_footers(scanned)
    with pytest.raises(ValueError):
        footers.bounds(spark, f"{SF}/orders.parquet", ["o_orderstatus"])


def test_footers_of_several_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 3).alias("a"), F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00' + make_dt_interval(CAST(id AS int))").alias("at"), F.when(F.col("id") > 5, F.col("id")).alias("b"))
    df.repartition(7).write.parquet(f"{tmp_path}/t.parquet")
    assert tuple(footers.bounds(spark, f"{tmp_path}/t.parquet", ["b", "at", "a"]).first()) == (1000, 6, 999, dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1) + dt.timedelta(999), 0, 2997)


def test_horizons_are_kept_by_scope(spark):
    now = [0.0]
    kept = footers.Horizons(spark, 300, lambda: now[0])
    whole = kept.newest(SF, "orders", "o_orderdate")
    assert whole == spark.read.parquet(f"{SF}/orders.parquet").agg(F.max("o_orderdate")).first()[0].date()
    few = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 5")
    assert kept.newest(SF, "orders", "o_orderdate", "ASIA", few.select("o_orderdate")) <= whole
    assert kept.newest(SF, "orders", "o_orderdate", "ASIA", few.limit(0).select("o_orderdate")) is not None  # kept
    now[0] = 400
    assert kept.newest(SF, "orders", "o_orderdate", "ASIA", few.limit(0).select("o_orderdate")) is None


def test_pasted_statements_over_large_tables_need_a_condition(spark):
    class Large(footers.Horizons):
        def rows(self, folder, table):
            return 5_000_000 if table == "lineitem" else 10

    loaded = CATALOG.load(spark, SF)
    with pytest.raises(Denied):
        run_pasted(loaded, "SELECT Factory FROM vw_LineDayQuality", horizons=Large(spark))
    assert run_pasted(loaded, "SELECT Factory FROM vw_LineDayQuality WHERE Factory = 'ASIA'", horizons=Large(spark)).columns == ["Factory"]
    assert run_pasted(loaded, "SELECT Factory FROM vw_Store", horizons=Large(spark)).count() > 0
