import difflib
import random

from loomspan.plans import values
from loomspan.queries import text

SCHEMA = "entity string, value string, code string, factory string, alias string"


def entries(spark, names):
    return spark.createDataFrame([("buyer", n, str(i), None, None) for i, n in enumerate(names)], SCHEMA)


def brute(questions, names):
    """Every phrase against every name, as the reference compares them."""
    out = {}
    for q, asked in questions:
        w = asked.split()
        for name in names:
            n = len(name.split())
            grams = [" ".join(w[i : i + k]) for k in (n - 1, n, n + 1) if k for i in range(len(w) - k + 1)]
            score = 1.0 if f" {name} " in f" {asked} " else max((difflib.SequenceMatcher(None, name, g).ratio() for g in grams), default=0)
            if score >= values.CUTOFF:
                out[q, name] = round(score, 9)
    return out


def test_every_close_spelling_is_found(spark):
    r = random.Random(3)
    names = ["buyer house", "a b", "one two three four five six seven eight", "aaaa aaaa", *(" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(2, 9))) for _ in range(150))]

    def worn(name):
        return " ".join("".join(c for c in name if r.random() > 0.07).replace("a", r.choice("aaab")).split())

    questions = [(0, "orders of bayer hous today"), (1, "see one two three four five six seven eight now"), (2, "x"), *((3 + i, f"of {worn(r.choice(names))} now") for i in range(60))]
    got = values.lookup(spark.createDataFrame(questions, "question_id int, text string"), entries(spark, names)).collect()
    want = brute(questions, set(names))
    assert {(x["question_id"], x["value"]): round(x["score"], 9) for x in got} == want
    assert (0, "buyer house") in want and (1, names[2]) in want and len(want) > 60


def test_the_query_knows_all_customers(spark, tmp_path):
    spark.sql("SELECT CAST(id AS bigint) AS c_custkey, '' AS c_name, 0 AS c_nationkey, 0.0D AS c_acctbal, '' AS c_mktsegment FROM VALUES (1), (20), (33), (3333), (333) AS t(id)").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["question_id"]: (r["value"], r["score"]) for r in text.value_lookup(spark, str(tmp_path)).collect()}
    assert got[2] == ("Buyer House 20 Ltd", 1.0) and got[3][0] == "Buyer House 33 Ltd"
    spark.sql("SELECT CAST(id AS bigint) AS c_custkey, '' AS c_name, 0 AS c_nationkey, 0.0D AS c_acctbal, '' AS c_mktsegment FROM VALUES (333) AS t(id)").write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
    assert {r["question_id"]: r["value"] for r in text.value_lookup(spark, str(tmp_path)).collect()}[3] == "Buyer House 333 Ltd"


def test_no_task_holds_all_hits_of_a_question(spark):
    """Hits of one question are many; they are grouped, not ranked by a window, and names are dealt out before they are compared."""
    hits = values.lookup(spark.createDataFrame([(1, "orders of byer house 33")], "question_id int, text string"), entries(spark, [f"buyer house {i}" for i in range(40)]))
    plan = values.resolve(hits)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 2
    assert [(r["value"], round(r["score"], 6)) for r in values.resolve(hits).collect()] == [("buyer house 33", 0.962963)]
