import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomspan.decisions import backtest, playbook, quality, risk, watch
from loomspan.functions.stats import lead_bucket, nearest_rank, wilson
from loomspan.operators import joins, refine
from loomspan.operators.refine import Filter, Refused, RefinePlan
from loomspan.plans.views import CATALOG
from loomspan.retrieval import documents, search
from loomspan.sources import store
from loomspan.streaming.events import append_new, by_window

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shown(spark):
    rows = [(i, f"Style {i % 4}" if i % 7 else None, None if i % 5 == 0 else i * 10, "ok" if i % 2 else " OK ") for i in range(20)]
    return refine.ordered(spark.createDataFrame(rows, "OrderID int, Style string, OrderQty int, State string"), F.col("OrderID"))


def test_refine_filters(shown):
    ids = lambda *f: {r["OrderID"] for r in refine.apply(shown, RefinePlan(tuple(f))).collect()}
    assert ids(Filter("State", "eq", "OK")) == set(range(20))
    assert ids(Filter("Style", "neq", "style 1")) == {i for i in range(20) if i % 7 == 0 or i % 4 != 1}
    assert ids(Filter("OrderQty", "gt", 100)) == {i for i in range(11, 20) if i % 5}
    assert ids(Filter("OrderQty", "neq", 10)) == set(range(20)) - {1}
    assert ids(Filter("OrderQty", "between", (20, 40))) == {2, 3, 4}
    assert ids(Filter("OrderQty", "eq", "text")) == set() == ids(Filter("Style", "gt", 3))
    assert ids(Filter("Style", "in", ("STYLE 1", "style 2")), Filter("OrderQty", "lte", 60)) == {1, 2, 6}


def test_refine_order_and_ends(shown):
    got = lambda **p: [r["OrderID"] for r in refine.apply(shown, RefinePlan(**p)).collect()]
    assert got(sort=("OrderQty", True), limit=3) == [19, 18, 17] and got(sort=("OrderQty", False), limit=2) == [1, 2]
    assert set(got(sort=("OrderQty", False), limit=4, from_end=True)) == {0, 5, 10, 15}  # nulls stand last, both ways
    assert set(got(limit=3, from_end=True)) == {17, 18, 19} and got(limit=2) == [0, 1]


def test_refine_shapes(shown):
    groups = {r["Style"]: (r["Count"], r["OrderQty"]) for r in refine.apply(shown, RefinePlan(group_by="Style")).collect()}
    assert groups[None] == (3, 70 + 140) and "OrderID" not in refine.apply(shown, RefinePlan(group_by="Style")).columns
    assert refine.apply(shown, RefinePlan(scalar=("count", "Style"))).first()[0] == 4
    assert refine.apply(shown, RefinePlan((Filter("OrderQty", "gt", 10**6),), scalar=("total", "OrderQty"))).first()[0] == 0
    assert [r[0] for r in refine.apply(shown, RefinePlan(distinct="State")).collect()] == [" OK "]
    with pytest.raises(Refused):
        refine.apply(shown, RefinePlan(group_by="Style"), capped=True)
    with pytest.raises(Refused):
        refine.ordered(shown)
    assert refine.bare_filter(shown, ["style 1"]).column == "Style"
    with pytest.raises(Refused):
        refine.bare_filter(shown, ["nowhere"])
    assert refine.capped(shown, 5)[1] and not refine.capped(shown, 20)[1]
    with pytest.raises(Refused):
        refine.page(shown, [F.col("OrderID")], 100)


def test_as_of_against_all_pairs(spark):
    r = random.Random(1)
    left = [(i, r.randint(0, 3), r.randint(0, 50)) for i in range(60)]
    right = [(r.randint(0, 3), r.randint(0, 50), r.choice([None, i]), i) for i in range(40)]
    got = joins.as_of(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, at int, v int, tie int"), ["k"], "t", "at", "v", "tie")
    for row in got.collect():
        before = [x for x in right if x[0] == row["k"] and x[1] <= row["t"]]
        assert row["v"] == (max(before, key=lambda x: (x[1], x[3]))[2] if before else None)
    assert got.count() == 60


def test_companion_keeps_unmatched_rows_and_the_first_match(spark):
    main = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "FileNo int, Buyer string")
    extra = spark.createDataFrame([("1", "x", 2), ("1", "y", 1), ("2", "z", 1), ("9", "q", 1)], "FileNo string, Buyer string, n int")
    got = sorted(map(tuple, joins.companion(main, extra, ["FileNo"], ["n"], name="other").collect()))
    assert got == [(1, "a", "y", 1), (2, "b", "z", 1), (3, "c", None, None)]


def test_copies(spark, tmp_path):
    copies = store.Copies(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "Abc"), (2, "def")], "id int, name string")
    assert copies.missing(["a"]) == ["a"] and copies.copy_or_live("a", lambda: df)[1] is None
    copies.write("a", df, dt.datetime(2024, 1, 1))
    assert copies.lookup("a", "name", "ABC").count() == 1 and copies.meta("a")["rows"] == 2 and copies.has_column("a", "name")
    with pytest.raises(Exception):
        copies.write("a", df.select(F.raise_error(F.lit("broken"))), dt.datetime(2024, 1, 2))
    assert copies.meta("a")["as_of"] == "2024-01-01T00:00:00" and copies.read("a").count() == 2  # a failed refresh keeps the copy
    copies.write("a", df.limit(1), dt.datetime(2024, 1, 3))
    assert copies.read("a").count() == 1


def test_cache_and_schedule(spark):
    now = [0.0]
    cache = store.ResultCache(10, 2, lambda: now[0])
    df = spark.range(300).toDF("n")
    first = cache.run(df, "q", {"a": 1}, "s", now=dt.datetime(2024, 1, 1))
    assert len(first[0]) == 200 and cache.run(df, "q", {"a": 1}, "s", now=dt.datetime(2024, 1, 2)) is first
    assert cache.run(df, "q", {"a": 1}, "other", now=dt.datetime(2024, 1, 2)) is not first  # another scope
    now[0] = 11
    assert cache.get(("q", (("a", "1"),), "s")) is None
    assert store.next_run(dt.datetime(2024, 1, 1, 6), ["06:00", "18:00"]) == dt.datetime(2024, 1, 1, 18) and store.next_run(dt.datetime(2024, 1, 1, 18), ["06:00", "18:00"]) == dt.datetime(2024, 1, 2, 6)
    assert store.csv_bytes(df, 2) == b"\xef\xbb\xbfn\n0\n1\n" and store.csv_name("x", dt.datetime(2024, 1, 1, 5)) == "x_2024-01-01_0500.csv"


def test_ratios_come_from_sums(spark):
    daily = spark.createDataFrame([("A", "f", dt.date(2024, 1, d), c, x, 0, c and c - x, x, 0) for d, c, x in ((1, 40, 4), (2, 4000, 44), (3, None, None))], "Factory string, FileNo string, Day date, Checked int, Defects int, Rejected int, Passed int, DefectivePcs int, Rectified int")
    row = risk.evaluate(risk.collect(daily, dt.date(2024, 1, 3), 7)).first()
    assert row["Checked"] == 4040 and row["dhu"] == 1.19 and row["level"] == "green"
    with pytest.raises(ValueError):
        risk.collect(daily, dt.date(2024, 1, 3), 7, most_subjects=0)
    assert risk.evaluate(risk.collect(daily, dt.date(2024, 1, 1), 1)).first()["level"] == "info"  # too few were checked


def test_trailing_equals_single_windows(spark):
    daily = CATALOG.load(spark, SF).view("vw_PlanQualityDay")
    many = risk.trailing(daily, 28, dt.date(1999, 1, 1), dt.date(1999, 3, 1), 7)
    for day in (dt.date(1999, 1, 1), dt.date(1999, 2, 5)):
        assert sorted(map(tuple, many.where(F.col("RunDay") == F.lit(day)).drop("RunDay").collect())) == sorted(map(tuple, risk.collect(daily, day, 28).collect()))


def test_outcome_versions(spark):
    v = spark.createDataFrame([(1, 1, "red"), (1, 2, "red"), (1, 3, "green"), (2, 1, "amber")], "prediction_id int, written int, outcome_level string")
    assert sorted(map(tuple, risk.current_outcomes(v).collect())) == [(1, "green", 1), (2, "amber", 0)]


def test_levels_and_health(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,)], "v double")
    got = lambda *a: [r[0] for r in df.select(watch.level(F.col("v"), *a)).collect()]
    assert got(2.0, 3.0) == ["green", "green", "amber", "red"] and got(2.0, 1.0, True) == ["green", "red", "amber", "green"] and got(None, None) == ["info"] * 4
    signals = spark.createDataFrame([("ops", x, 1.0, 1, "F", "r", "m") for x in ("red", "amber", "green", "green", "info")] + [("data", "red", 1.0, 1, "F", "r", "m")], "kind string, level string, value double, weight int, Factory string, rule string, metric string")
    assert tuple(watch.health(signals).first()) == (62.0, 4, 1, 1)  # 62.5, half to even
    assert watch.stale("no date", dt.datetime(2024, 1, 1), 5) and not watch.stale("2024-01-01T00:00:00", dt.datetime(2024, 1, 1, 0, 5), 5)
    assert not watch.problems(watch.RULES) and not risk.problems(risk.RULES) and not playbook.problems(playbook.PLAYBOOKS)


def test_statistics(spark):
    low, high = spark.range(1).select(*wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)
    assert spark.range(1).select(wilson(F.lit(0), F.lit(0))[0]).first()[0] is None
    assert [r[0] for r in spark.createDataFrame([(d,) for d in (1, 6, 7, 8, 14, 21, 28, 99)], "d int").select(lead_bucket(F.col("d"))).collect()] == ["1-6", "1-6", "7", "8-13", "14-20", "21-27", "28+", "28+"]
    assert spark.range(1, 21).agg(nearest_rank("id", 0.95)).first()[0] == 19


def test_verdict_minima():
    levels = {"red": (15, 12), "amber": (15, 6), "green": (15, 1)}
    assert backtest.verdict(levels, 28, 60) == "SEPARATED" and backtest.verdict(levels, 27, 60) == backtest.verdict(levels, 28, 59) == backtest.verdict(levels | {"red": (14, 12)}, 28, 60) == "INSUFFICIENT"
    assert backtest.verdict({"red": (15, 1), "amber": (15, 6), "green": (15, 1)}, 28, 60) == "NOT ORDERED"


def test_backtest_steps(spark):
    at = lambda d, h=9: dt.datetime(2024, 1, d, h)
    runs = spark.createDataFrame([(1, at(1), 3, 0), (2, at(1, 15), 3, 1), (3, at(2), 0, 0), (4, at(3), 3, 0), (5, at(9), 3, 0), (6, at(20), 3, 0)], "id long, started timestamp, predictions long, errors long")
    assert [r["id"] for r in backtest.usable_runs(runs).orderBy("id").collect()] == [1, 4, 5, 6]
    assert backtest.missing_dates(runs).count() == 20 - 4
    row = lambda i, run, f, out=None, day=None, revised=0: (i, run, "F", f, "red", 7, 3.0, out, day, 5.0 if out else None, revised)
    rows = [row(1, 1, "good"), row(2, 4, "good", at(12), dt.date(2024, 1, 11)), row(3, 4, "revised", at(12), dt.date(2024, 1, 11), 1), row(4, 5, "own", at(9, 10), dt.date(2024, 1, 9)), row(5, 1, "open"), row(6, 4, "again", at(12), dt.date(2024, 1, 11)), row(7, 6, "again"), row(8, 1, "twice", at(12), dt.date(2024, 1, 11)), row(9, 4, "twice", at(13), dt.date(2024, 1, 12))]
    stored = spark.createDataFrame(rows, "id long, run_id long, Factory string, FileNo string, level string, window_days int, amber double, outcome_at timestamp, outcome_day date, outcome_dhu double, revised int")
    assert {r["id"]: r["settled_by"] for r in backtest.settling_run(stored, runs).collect()} == {2: 5, 3: 5, 4: 5, 6: 5, 8: 5, 9: 5}
    joined = backtest.compute(runs, stored)
    assert sorted((r["FileNo"], r["ahead"], r["adverse"]) for r in joined.collect()) == [("good", 8, 1), ("good", 10, 1)]
    assert [r["ahead"] for r in backtest.headline(joined).collect()] == [8]
    before = backtest.cut(runs, stored, at(10))
    assert before[0].count() == 5 and before[1].where("outcome_at IS NOT NULL").count() == 1
    assert backtest.lead_grid(joined).columns == ["level", "1-6", "7", "8-13", "14-20", "21-27", "28+"]


def test_playbooks(spark):
    a = playbook.Action("x", "quantity_x_rate", "Checked", {"share": (0, 1)})
    assert playbook.check_params(a, {}) == ["share is missing"] and playbook.check_params(a, {"share": 2}) == ["share is not within 0 to 1"] and not playbook.check_params(a, {"share": 1})
    p = spark.createDataFrame([(1, "F", "x", "red", None, None), (2, "F", "x", "amber", dt.datetime(2024, 1, 5), "green")], "id long, Factory string, FileNo string, level string, outcome_at timestamp, outcome_level string")
    rec = spark.createDataFrame([(7, 1), (8, 2)], "recommendation_id long, prediction_id long")
    d = spark.createDataFrame([(1, 7, "no", dt.datetime(2024, 1, 1)), (2, 7, "yes", dt.datetime(2024, 1, 2)), (3, 8, "yes", dt.datetime(2024, 1, 6))], "id long, recommendation_id long, choice string, decided_at timestamp")
    got = {r["recommendation_id"]: (r["choice"], r["level_now"], r["after_decision"]) for r in playbook.decision_outcomes(d, rec, p).collect()}
    assert got == {7: ("yes", "amber", None), 8: ("yes", None, False)}


def test_checks_fail_alone(spark):
    broken = quality.Check("broken", "count", 0, "SELECT nothing FROM nowhere")
    frame, errors = quality.report(CATALOG.load(spark, SF), [quality.CHECKS[0], broken, quality.CHECKS[3]])
    assert frame.count() == 2 and list(errors) == ["broken"]
    assert "| order_entries_fresh |" in quality.render(frame.collect())


def test_bm25_against_plain_python(spark):
    import math

    docs = [(1, "the cat sat"), (2, "cat cat dog"), (3, "dog"), (4, None), (5, "birds and cats")]
    got = {r["doc_id"]: r["score"] for r in search.bm25(spark.createDataFrame(docs, "doc_id int, text string"), "the cat", 10).collect()}
    assert search.query_terms("the cat") == ["cat"] and search.query_terms("the") == ["the"]
    lengths = {i: len((t or "").split()) for i, t in docs}
    avg, idf = sum(lengths.values()) / 5, math.log(1 + (5 - 2 + 0.5) / 2.5)
    score = lambda i, tf: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / avg)), 6)
    assert got == pytest.approx({1: score(1, 1), 2: score(2, 2)})


def test_fusion_ties(spark):
    df = lambda *rows: spark.createDataFrame(rows, "doc_id int, score double")
    got = [r["doc_id"] for r in search.fused(df((1, 9.0), (2, 8.0)), df((3, 9.0), (2, 8.0)), 5).collect()]
    assert got == [2, 1, 3]  # 1 and 3 tie; the first list goes first


def test_chunks():
    assert documents.is_heading("1.2 Cutting of fabric") and not documents.is_heading("12 pcs of cloth") and not documents.is_heading("this is plain prose")
    text = "1 First\n" + "word " * 600 + "\n2 Tiny\nshort\n3 Third\n" + "more " * 200
    chunks = documents.chunk_text(text, "Manual")
    assert all(c.startswith("Manual › ") for c in chunks) and len(chunks) == 3 and "short" in chunks[-1] and all(len(c) < 2600 for c in chunks)
    assert documents.chunk_text("tiny") == ["tiny"] and documents.chunk_text("") == []
    pieces = documents.split_long("abc " * 2000)
    assert all(len(p) <= documents.TARGET for p in pieces) and pieces[1][:3] == "abc"


def test_document_upkeep(spark):
    misses = spark.createDataFrame([(i, 2) for i in range(4)] + [(9, 1)], "doc_id int, misses int")
    gone, alarm = documents.removals(misses, 50)
    assert gone.count() == 4 and alarm and not documents.removals(misses, 100)[1]
    titles = spark.createDataFrame([("a", "Cutting SOP v1.9"), ("b", "Cutting SOP v1.10"), ("c", "Sewing Rev 2"), ("d", "Plain")], "source string, title string")
    assert [r["source"] for r in documents.superseded(titles).collect()] == ["a"]
    assert {r["id"] for r in documents.even_sample(spark.range(100), 4, "id").collect()} == {0, 25, 50, 75}


def test_an_even_sample_counts_the_ranges_that_it_takes_rows_from(spark):
    """Range bounds come from a random sample, which differs from job to job once a task has more rows than it samples."""
    rows = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).alias("id"))
    every = sorted(i * 7919 % 200_003 for i in range(200_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or ranges as small as these become one
    try:
        assert sorted(r["id"] for r in documents.even_sample(rows, 10, "id").collect()) == [every[i * 20_000] for i in range(10)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_events_arrive_once(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i), "a", 1.0) for i in range(10)], "event_id long, ts timestamp, event_type string, value double")
    for part in (events.where("event_id < 4"), events.where("event_id >= 4")):
        part.write.mode("append").parquet(source)
        append_new(spark, source, events.schema, sink, f"{tmp_path}/state")
    assert spark.read.parquet(sink).count() == 10
    assert [r["n"] for r in by_window(spark.read.parquet(sink)).orderBy("start").collect()] == [5, 5]


def test_the_last_rows_keep_their_order(spark):
    shown = refine.ordered(spark.createDataFrame([(i,) for i in (3, 1, 4, 2)], "OrderID int"), F.col("OrderID"))
    assert [r[0] for r in refine.apply(shown, refine.RefinePlan(limit=2, from_end=True)).collect()] == [3, 4]


def test_long_numbers_sort_by_value(spark):
    texts = ["a" + "9" * 25, "a1" + "0" * 25, "a02", "a10", "a2b", "", "total"]
    assert [r[0] for r in refine.natural_order(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 9).collect()] == ["a02", "a2b", "a10", texts[0], texts[1], "", "total"]


def test_rows_without_a_request_are_withheld_too(spark):
    log = spark.createDataFrame([(None, "hr", "q1"), (None, "ok", "q2"), (1, "hr", "q3"), (1, "ok", "q4"), (2, "ok", "q5")], "request_id int, database string, statement string")
    assert sorted(r["statement"] for r in store.redacted(log, ["hr"], ["statement"]).collect()) == ["(withheld)"] * 3 + ["q2", "q5"]


@pytest.mark.parametrize(
    "line,is_one",
    [
        ("3.2 Change after fabric in-house", True), ("1.7  Exceptions", True), ("4) Scope", True), ("10 minutes before the meeting", False), ("30 Days after delivery", False), ("2 Years for trend analysis", False),
        ("SOP-02 — New Joiner Setup", True), ("SOP-02", False), ("PART B — IT OPERATIONS POLICIES", True), ("Annexure F", True), ("Part A (Chapters 3–9) applies to all", False), ("Annexure A and may be updated", False),
        ("1.7.1", False), ("2.", False), ("12 pcs of cloth", False), ("3 Ends with a stop.", False), ("1.2.3.4.5 Too deep", False), ("5 " + "Word " * 12, False), ("", False), ("১.২ পরিধি", True),
    ],
)
def test_headings(line, is_one):
    assert documents.is_heading(line) == is_one


def test_long_bodies_are_cut_between_paragraphs_then_sentences():
    a, b, c = "Aa " * 50, "Bb " * 50, "Cc. " * 100
    assert documents.split_long(f"{a}\n\n{b}", 400, 20) == [f"{a.strip()}\n\n{b.strip()}"]
    assert documents.split_long(f"{a}\n\n{b}", 200, 20) == [a.strip(), " ".join(["Aa"] * 7) + "\n\n" + b.strip()]
    sentences = documents.split_long(c, 100, 10)
    assert all(len(x) <= 100 and x.endswith("Cc.") for x in sentences) and "".join(sentences).count("Cc.") >= 100
    assert documents.split_long("", 100, 10) == []


def test_a_heading_goes_on_to_the_next_page():
    body = "Text of it. " * 60
    first, heading = documents.chunk_page(f"1.1 Scope\n{body}", "Manual")
    second, last = documents.chunk_page(f"{body}\n2 Next\nshort", "Manual", heading)
    assert heading == "1.1 Scope" and last == "2 Next"
    assert [c.split("\n")[0] for c in first + second] == ["Manual › 1.1 Scope", "Manual › 1.1 Scope", "Manual › 2 Next"]
    assert second[-1] == "Manual › 2 Next\nshort"


def test_roman_page_numbers_in_contents(spark):
    lines = [(1, 0, i, t) for i, t in enumerate(["Scope ..... 3", "Preface . . . . iv", "Terms ....... 12", "Rules .... xii", "Ends ..... 9", "a | b | c"])] + [(1, 1, i, "a | b") for i in range(9)]
    got = documents.contents_pages(spark.createDataFrame(lines, "doc_id int, page int, line int, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 0, 5, 6)]


def test_a_summary_is_of_the_first_text_that_varies(spark):
    rows = spark.createDataFrame([("a", None, "x", 1), ("a", None, "y", 2), ("a", None, "y", 3)], "one string, none string, two string, Qty int")
    assert refine.summarize(rows).first()["values"] == 2 and refine.summarize(rows.limit(1)).first()["values"] == 1
    assert refine.summarize(rows.limit(0)).first()["values"] == 0


def test_old_copies_go_and_the_current_one_stays(spark, tmp_path):
    kept = store.Copies(spark, f"file://{tmp_path}/c")
    assert kept.prune("n") == []
    made = [kept.write("n", spark.range(i), dt.datetime(2000, 1, i))["version"] for i in (3, 2, 1)]
    assert kept.prune("n") == made[:1] and kept.prune("n", 1) == made[1:2] and kept.read("n").count() == 1
    assert kept.prune("n", 0) == [] and kept.read("n").count() == 1
