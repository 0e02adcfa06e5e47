"""Queries of what came before and after: carried tables, later events, decisions, baselines, footers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..decisions import evaluation, playbook
from ..operators import islands
from ..sources import footers, scans
from ..sources.tables import table as _t
from ..sources.versions import scratch


def question_history(spark, sf):
    """Each question with the turn whose table is still on screen, and the turn that answers it. An answer shows a table,
    takes it away, or leaves it, by the length of its text."""
    answer, kind = F.col("role") == "assistant", F.length("text") % 3
    turns = _t(spark, sf, "conversations")
    carried = islands.carried(turns, ["conv_id"], ["turn"], "turn", answer & (kind == 0), answer & (kind == 1), name="table_turn")
    both = islands.followed(carried, ["conv_id"], ["turn"], answer, answer_turn="turn")
    return both.where("role = 'user'").select("conv_id", "turn", "table_turn", "answer_turn")


HISTORY = """WITH m AS (SELECT conv_id, turn, role, role = 'assistant' AND length(text) % 3 = 0 AS sets, role = 'assistant' AND length(text) % 3 = 1 AS resets FROM conversations),
i AS (SELECT *, sum(CASE WHEN resets THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m),
c AS (SELECT *, max(CASE WHEN sets THEN turn END) OVER (PARTITION BY conv_id, island ORDER BY turn) AS table_turn, lead(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS answer_turn FROM i)
SELECT conv_id, turn, table_turn, answer_turn FROM c WHERE role = 'user'"""


def next_view(spark, sf):
    """For each purchase the first view of the same user at or after it."""
    e = _t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    found = islands.next_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "seen", {"view_id": "view_id"}, "view_id")
    return found.select("event_id", "user_id", "view_id")


def decision_history(spark, sf):
    """Orders as predictions of their customer's order, decisions on every fifth, revised on every tenth."""
    o = _t(spark, sf, "orders")
    predictions = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_custkey") % 7).alias("Factory"), F.concat(F.lit("c"), F.col("o_custkey")).alias("FileNo"), F.col("o_orderstatus").alias("level"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 5 AS int))").alias("outcome_at"), F.col("o_orderpriority").alias("outcome_level"))
    advice = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").alias("at"))
    decided = lambda every, add, choice: advice.where(F.col("recommendation_id") % every == 0).select((F.col("recommendation_id") * 2 + add).alias("id"), "recommendation_id", F.lit(choice).alias("choice"), F.expr("at + make_dt_interval(2)").alias("decided_at"))
    out = playbook.decision_outcomes(decided(5, 0, "taken").unionByName(decided(10, 1, "dropped")), advice.drop("at"), predictions)
    return out.groupBy("choice", "level_then", "level_now", "after_decision").agg(F.count("*").alias("n"), F.sum("recommendation_id").alias("ids"))


DECISIONS = """WITH p AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS level, o_orderdate + to_days(CAST(o_orderkey % 5 AS int)) AS outcome_at, o_orderdate AS placed FROM orders),
d AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'dropped' ELSE 'taken' END AS choice, placed + INTERVAL 2 DAY AS decided_at FROM p WHERE id % 5 = 0)
SELECT choice, p.level AS level_then, (SELECT l.level FROM p l WHERE l.c = p.c AND l.id > p.id ORDER BY l.id DESC LIMIT 1) AS level_now, outcome_at >= decided_at AS after_decision, count(*) AS n, CAST(sum(d.id) AS bigint) AS ids
FROM d JOIN p ON p.id = d.id GROUP BY ALL"""

_RUN = """CASE WHEN doc_id % 5 = 0 THEN 'not_found' WHEN doc_id % 5 = 1 THEN 'refuse' WHEN run < 4 AND doc_id % 7 = 0 THEN 'other' ELSE 'data' END AS kind, CAST((doc_id * 7 + run) % 3 > 0 AS int) AS hit, CAST((doc_id + run) % 4 > 0 AS int) AS faithful,
CASE WHEN run = 6 AND doc_id % 33 = 0 THEN NULL ELSE CAST((doc_id * run) % 5 < 4 AS int) END AS correct, CASE WHEN doc_id % 2 = 0 THEN CAST((doc_id + 2 * run) % 6 > 0 AS int) END AS citation_valid, run = 4 AND doc_id = 3 AS outage"""


def eval_baseline(spark, sf):
    """Six runs over the documents as cases: the newest asks a third of them, the one before lacks some, the one before
    that has an outage; kinds are redefined after the third."""
    rows = _t(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("run"))
    rows = rows.where("(run < 6 OR doc_id % 3 = 0) AND NOT (run IN (2, 5) AND doc_id % 9 = 0)")
    rows = rows.selectExpr("concat('run', run) AS run_id", "doc_id AS case_id", *[e.strip() for e in _split(_RUN)])
    return evaluation.compared(rows, "run6").select("score", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "cases", "blocked")


def _split(text: str) -> list[str]:
    """Expressions at commas outside brackets and quotes."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


BASELINE = f"""WITH r AS (SELECT 'run' || run AS run_id, doc_id AS case_id, {_RUN} FROM (SELECT doc_id, unnest(range(1, 7)) AS run FROM documents) x WHERE (run < 6 OR doc_id % 3 = 0) AND NOT (run IN (2, 5) AND doc_id % 9 = 0)),
b AS (SELECT max(run_id) AS run_id FROM (SELECT DISTINCT run_id FROM r WHERE run_id < 'run6') e
      WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.run_id = 'run6' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.run_id = e.run_id AND o.case_id = c.case_id))
        AND NOT EXISTS (SELECT 1 FROM r o WHERE o.run_id = e.run_id AND (o.outage OR o.correct IS NULL))),
p AS (SELECT o.hit AS h0, o.faithful AS f0, o.correct AS c0, o.citation_valid AS v0, n.hit AS h1, n.faithful AS f1, n.correct AS c1, n.citation_valid AS v1, n.kind AS kind
      FROM r n JOIN r o ON o.case_id = n.case_id AND o.run_id = (SELECT run_id FROM b) WHERE n.run_id = 'run6' AND NOT n.outage AND n.correct IS NOT NULL AND n.kind = o.kind),
s AS (SELECT 'hit_rate' AS score, avg(h0) AS before, avg(h1) AS after, count(*) AS cases FROM p UNION ALL SELECT 'faithfulness', avg(f0), avg(f1), count(*) FROM p UNION ALL SELECT 'correctness', avg(c0), avg(c1), count(*) FROM p UNION ALL SELECT 'citation_validity', avg(v0), avg(v1), count(*) FROM p
      UNION ALL SELECT 'not_found_ok', avg(c0), avg(c1), count(*) FROM p WHERE kind = 'not_found' UNION ALL SELECT 'refuse_ok', avg(c0), avg(c1), count(*) FROM p WHERE kind = 'refuse')
SELECT score, round(before, 6) AS before, round(after, 6) AS after, cases, before - after > 0.05 + 1e-9 AS blocked FROM s WHERE before IS NOT NULL AND after IS NOT NULL"""

BOUNDED = {"orders": ("o_orderkey", "o_orderdate"), "lineitem": ("l_orderkey", "l_shipdate"), "events": ("event_id", "ts"), "documents": ("doc_id", None), "customer": ("c_custkey", None), "conversations": ("conv_id", None)}


def table_bounds(spark, sf):
    """Rows, keys and newest day of tables, from their footers."""
    out = None
    for name, (key, day) in BOUNDED.items():
        found = footers.bounds(spark, f"{sf}/{name}.parquet", [key] + [day] * (day is not None))
        newest = F.date_format(f"high_{day}", "yyyy-MM-dd") if day else F.lit(None).cast("string")
        one = found.select(F.lit(name).alias("name"), "n", F.col(f"low_{key}").alias("low"), F.col(f"high_{key}").alias("high"), newest.alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


BOUNDS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, min({k}) AS low, max({k}) AS high, {f'''strftime(max({d}), '%Y-%m-%d')''' if d else 'NULL'} AS newest FROM {n}" for n, (k, d) in BOUNDED.items())

SCANS = 4
_VERSION = "CASE WHEN page_id % 4 = 0 AND {s} >= 3 THEN 2 ELSE 1 END"
_THERE = "(page_id + {s}) % 6 <> 0 AND NOT (page_id % 40 = 3 AND {s} >= 2)"


def page_registry(spark, sf):
    """Pages as files in four scans: each is missing now and then, some go, some change, some can't be read."""
    kept = scans.Registry(spark, scratch(spark, "registry"))
    pages = _t(spark, sf, "pages")
    for s in range(1, SCANS + 1):
        version = F.expr(_VERSION.format(s=s))
        scan = pages.where(_THERE.format(s=s)).select(F.concat(F.lit("p"), "page_id").alias("path"), (F.length(F.coalesce("html", F.lit(""))) + version).cast("long").alias("size"), version.cast("long").alias("modified"), F.when(F.col("page_id") % 13 != 5, F.sha2(F.concat(F.coalesce("html", F.lit("")), version.cast("string")), 256)).alias("hash"))
        kept.apply(s, scan)
    return kept.state().groupBy("status", "attempts", "misses", "change").agg(F.count("*").alias("n"), F.sum(F.substring("path", 2, 20).cast("long")).alias("pages"))


def _fold() -> str:
    """The same, a full join for each scan. The pages that go are too few to be held."""
    steps = ["s0 AS (SELECT CAST(NULL AS bigint) AS page_id, NULL::bigint AS size, NULL::bigint AS modified, NULL::varchar AS hash, NULL::varchar AS status, 0 AS attempts, 0 AS misses, NULL::varchar AS change WHERE false)"]
    for s in range(1, SCANS + 1):
        v = _VERSION.format(s=s)
        steps.append(f"n{s} AS (SELECT page_id AS p, length(coalesce(html, '')) + {v} AS size, {v} AS modified, CASE WHEN page_id % 13 <> 5 THEN sha256(coalesce(html, '') || CAST({v} AS varchar)) END AS hash FROM pages WHERE {_THERE.format(s=s)})")
        steps.append(f"""j{s} AS (SELECT coalesce(page_id, p) AS page_id, o.size, o.modified, o.hash, status, coalesce(attempts, 0) AS attempts, coalesce(misses, 0) AS misses, n.size AS ns, n.modified AS nm, n.hash AS nh, p IS NOT NULL AS there, coalesce(status <> 'removed', false) AS known,
  coalesce(status = 'done' AND o.size = n.size AND o.modified = n.modified, false) AS same, CASE WHEN coalesce(status <> 'removed', false) THEN coalesce(attempts, 0) ELSE 0 END + 1 AS tried FROM s{s - 1} o FULL JOIN n{s} n ON p = page_id)""")
        steps.append(f"""s{s} AS (SELECT page_id, CASE WHEN there AND NOT same AND nh IS NOT NULL THEN ns ELSE size END AS size, CASE WHEN there AND NOT same AND nh IS NOT NULL THEN nm ELSE modified END AS modified, CASE WHEN there AND NOT same AND nh IS NOT NULL THEN nh ELSE hash END AS hash,
  CASE WHEN NOT there THEN CASE WHEN known AND misses + 1 >= 2 THEN 'removed' ELSE status END WHEN same OR nh IS NOT NULL THEN 'done' WHEN tried >= 3 THEN 'failed' ELSE 'retry' END AS status,
  CASE WHEN there AND NOT same AND nh IS NULL THEN tried WHEN there THEN 0 ELSE attempts END AS attempts, CASE WHEN there THEN 0 WHEN known THEN misses + 1 ELSE misses END AS misses,
  CASE WHEN NOT there THEN CASE WHEN NOT known THEN NULL WHEN misses + 1 >= 2 THEN 'removed' ELSE 'missing' END WHEN same THEN NULL WHEN nh IS NULL THEN CASE WHEN tried >= 3 THEN 'failed' ELSE 'retry' END WHEN NOT known OR hash IS NULL THEN 'new' WHEN nh <> hash THEN 'changed' END AS change FROM j{s})""")
    return f"WITH {', '.join(steps)} SELECT status, attempts, misses, change, count(*) AS n, CAST(sum(page_id) AS bigint) AS pages FROM s{SCANS} GROUP BY ALL"


QUERIES = {
    "page_registry": (page_registry, _fold()),
    "question_history": (question_history, HISTORY),
    "next_view": (next_view, "SELECT b.event_id, b.user_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = b.user_id AND v.ts >= b.ts ORDER BY v.ts, v.event_id LIMIT 1) AS view_id FROM events b WHERE b.event_type = 'purchase'"),
    "decision_history": (decision_history, DECISIONS),
    "eval_baseline": (eval_baseline, BASELINE),
    "table_bounds": (table_bounds, BOUNDS),
}
