import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.queries import indexes
from loomspan.retrieval import postings as kept_postings
from loomspan.retrieval import search, vectors
from loomspan.retrieval.postings import Postings
from loomspan.retrieval.vectors import VectorIndex
from loomspan.sources.store import Copies
from loomspan.sources.tables import table
from loomspan.sources.versions import BucketedTable, LostRace, Manifest

SF = "/root/testdata/sf0.01"
NOW = dt.datetime(2000, 1, 1)


def test_recall_against_the_exact_way(spark):
    """Measured on the given vectors, and on ones that lie in groups, where few cells have to be searched."""
    exact = {(r["query_id"], r["vec_id"]) for r in indexes.knn_topk(spark, SF).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in indexes.ann_topk(spark, SF).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and len(exact) == 20 * table(spark, SF, "embeddings").where("vec_id % 20 = 0").count()


def test_grouped_vectors_need_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centers[0 if i % 3 == 0 else i // 20 % 20] + 0.1 * r.normal(size=16)]) for i in range(1500)]  # one group has a third of all
    df = spark.createDataFrame([*rows, (5000, None)], "vec_id long, embedding array<double>").repartition(4)
    index = VectorIndex(Copies(spark, f"file://{tmp_path}/v"), "grouped")
    index.build(df, NOW, cells=25, k=10)
    assert index.about["probes"] <= 15
    asked = df.where("vec_id % 20 = 0")
    got = {(r["query_id"], r["vec_id"]) for r in index.search(asked, 10).collect()}
    exact = [(r["query_id"], r["rank"], r["vec_id"]) for r in index.exact(asked, 10).collect()]
    x = vectors.unit(np.array([v for _, v in rows]))
    want = [(i, k, int(j)) for i in range(0, 1500, 20) for k, j in enumerate(np.lexsort((np.arange(1500), -np.round(x @ x[i], 12)))[:10], 1)]
    assert sorted(exact) == sorted(want)
    assert len(got & {(i, j) for i, _, j in want}) >= 0.9 * len(want)
    plan = index.search(asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_index_without_vectors(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    index = VectorIndex(Copies(spark, f"file://{tmp_path}/v"), "none")
    index.build(empty, NOW)
    assert index.search(empty).count() == 0


TEXTS = {1: "red fox runs", 2: "blue fox", 3: None, 4: "dog and dog and fox", 5: "the red dog", 6: "", 7: "owl", 8: "red red red fox dog owl"}


def postings(spark, tmp_path, rows):
    index = Postings(spark, f"file://{tmp_path}/p")
    for part in (rows.where("doc_id < 4"), rows.where("doc_id >= 4")):
        index.add(part)
    return index


def asked(spark, questions):
    return spark.createDataFrame([(q, t) for q, words in questions.items() for t in words.split()], "query_id long, term string")


def test_postings_score_as_the_scan_does(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in TEXTS.items()], "doc_id long, text string, source string")
    index = postings(spark, tmp_path, rows)
    questions = {1: "fox", 2: "red dog", 3: "owl fox dog red", 4: "nothing", 5: "fox fox"}
    for k in (1, 2, 20):
        got = index.search(asked(spark, questions), k).collect()
        for q, words in questions.items():
            want = [(r["doc_id"], r["score"]) for r in search.bm25(rows, words, k).collect()]
            assert [(r["doc_id"], round(r["score"], 6)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_removal_and_return(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in TEXTS.items()], "doc_id long, text string, source string")
    index = postings(spark, tmp_path, rows)
    assert index.remove("s1") == 4 and index.remove("none of these") == 0
    score = lambda docs: [(r["doc_id"], r["score"]) for r in search.bm25(docs, "red fox dog", 20).collect()]
    mine = lambda: [(r["doc_id"], round(r["score"], 6)) for r in index.search(asked(spark, {1: "red fox dog"})).orderBy("rank").collect()]
    assert mine() == score(rows.where("source = 's0'"))
    assert {r["term"]: r["df"] for r in index.terms().collect()} == {"fox": 3, "blue": 1, "dog": 2, "and": 1, "red": 1, "owl": 1}
    index.add(rows.where("source = 's1'"))
    assert mine() == score(rows)


def test_bounds_leave_documents_out(spark, tmp_path):
    """Of documents with a frequent term alone, none is a candidate once k others have reached more."""
    docs = [(i, "common " * (i % 5 + 1) + ("rare word" if i < 30 else ""), "s") for i in range(600)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    index = Postings(spark, f"file://{tmp_path}/p")
    index.add(rows)
    got = index.search(asked(spark, {1: "common rare word"}), 5)
    assert [(r["doc_id"], round(r["score"], 6)) for r in got.orderBy("rank").collect()] == [(r["doc_id"], r["score"]) for r in search.bm25(rows, "common rare word", 5).collect()]


def test_pairs_are_added_up_where_the_documents_are(spark, tmp_path, monkeypatch):
    """Nothing is dealt out by question and document; blocks of a few documents and several passes give the same."""
    monkeypatch.setattr(kept_postings, "BLOCK", 3)
    monkeypatch.setattr(kept_postings, "BROADCAST_TERMS", 2)
    rows = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in TEXTS.items()], "doc_id long, text string, source string")
    index = postings(spark, tmp_path, rows)
    index.remove("s1")
    index.add(rows.where("source = 's1'"))
    questions = {1: "fox", 2: "red dog", 3: "owl fox dog red", 4: "nothing"}
    found = index.search(asked(spark, questions), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\((query_id#\d+L?, doc_id|doc_id#\d+L?, query_id|term#\d+, doc_id)", plan)
    for q, words in questions.items():
        want = [(r["doc_id"], r["score"]) for r in search.bm25(rows, words, 2).collect()]
        assert [(r["doc_id"], round(r["score"], 6)) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_no_postings_and_no_pairs_as_rows(spark, tmp_path, monkeypatch):
    """Questions that many documents answer and ones that few do, with copies, removed documents and more answers than asked
    for: as a plain sum has it. Only documents are rows, once, and the questions are made once."""
    monkeypatch.setattr(kept_postings, "BLOCK", 2500)
    monkeypatch.setattr(kept_postings, "_MEETS", 50)
    r = np.random.default_rng(5)
    texts = {i: " ".join(f"w{int(x)}" for x in r.zipf(1.4, 1 + i % 9) if x < 300) for i in range(300)} | {i: "w1 w2 w7" for i in range(300, 360)}
    index = Postings(spark, f"file://{tmp_path}/p")
    rows = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in texts.items()], "doc_id long, text string, source string")
    index.add(rows)
    assert index.remove("s2") == 120
    left = {i: t.split() for i, t in texts.items() if i % 3 != 2}
    made = spark.sparkContext.accumulator(0)
    words = {q: sorted(set(t.split())) for q, t in texts.items() if q % 4 == 0}

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    questions = asked(spark, {q: " ".join(w) for q, w in words.items()}).mapInArrow(counted, "query_id long, term string")
    found = index.search(questions, 10)
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["doc_id"], round(row["score"], 6)))
    assert made.value == sum(map(len, words.values()))
    df = {t: sum(t in w for w in left.values()) for w in words.values() for t in w}
    avg = sum(map(len, left.values())) / len(left)
    part = lambda t, w: math.log(1 + (len(left) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
    want = {}
    for q, terms in words.items():
        scores = {d: sum(part(t, w) for t in terms if t in w) for d, w in left.items()}
        best = sorted((d for d in scores if scores[d]), key=lambda d: (-round(scores[d], 12), d))[:10]
        if best:
            want[q] = [(d, round(scores[d], 6)) for d in best]
    assert got == want
    made_rows = re.findall(r"Generate (\S+)\(arrays_zip\(([^)]*)\)", found._jdf.queryExecution().optimizedPlan().toString())
    assert made_rows and all("ids#" in columns for _, columns in made_rows)


def test_tokens_by_bytes_are_those_of_the_pattern(spark, tmp_path):
    odd = ["", "a", "Ab-9 c", "বাংলা text২৩x", "x২y", "İstanbul KELVIN\u212a Straße", "é\u0980\u09ff\u0a00z", "a\x00b\n\tc", "ঀ", "9", "日本 a日b", "\U0001f600a\U0001f600", "z" * 5000, None, "end", "end"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)], "doc_id long, text string, source string").coalesce(1)
    index = Postings(spark, f"file://{tmp_path}/p")
    index.add(rows)
    plain = rows.select("doc_id", search.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    want = {(r["doc_id"], t): (r["t"].count(t), len(r["t"])) for r in plain.collect() for t in r["t"]}
    assert {(r["doc_id"], r["term"]): (r["tf"], r["len"]) for r in index.postings().collect()} == want
    assert {r["doc_id"]: r["len"] for r in index.documents().collect()} == {r["doc_id"]: len(r["t"]) for r in plain.collect()}


def test_only_the_folders_of_the_terms_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i} w{i + 1}", "s") for i in range(300)], "doc_id long, text string, source string")
    index = Postings(spark, f"file://{tmp_path}/p")
    index.add(rows)
    plan = index.postings([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and math.isclose(index.postings([3]).select("bucket").distinct().count(), 1)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    kept = BucketedTable(spark, f"file://{tmp_path}/t", "id", 8)
    assert kept.read() is None and kept.get([1]) is None
    kept.upsert(spark.range(100).withColumn("v", F.lit("a")))
    before = kept.folders()
    touched = kept.upsert(spark.createDataFrame([(5, "b"), (200, "c")], "id long, v string"))
    after = kept.folders()
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == {str(b) for b in touched if str(b) in before}
    assert {r["id"]: r["v"] for r in kept.get([5, 6, 200, 999]).collect()} == {5: "b", 6: "a", 200: "c"}
    assert kept.delete(spark.createDataFrame([(6,), (6,), (777,)], "id long")) and kept.read().count() == 100
    at = kept.folders()
    assert kept.delete(spark.createDataFrame([(777,)], "id long")) == [] and kept.folders() == at
    kept.upsert(spark.createDataFrame([(5, "b", 1.5)], "id long, v string, more double"))
    assert {r["id"]: r["more"] for r in kept.get([5, 7]).collect()} == {5: 1.5, 7: None}
    with pytest.raises(ValueError):
        kept.upsert(spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string"))


def test_a_lost_race_is_refused(spark, tmp_path):
    kept = BucketedTable(spark, f"file://{tmp_path}/t", "id", 4)
    kept.upsert(spark.range(10).withColumn("v", F.lit("a")))
    began, content = kept.manifest.read()
    kept.upsert(spark.createDataFrame([(1, "b")], "id long, v string"))
    with pytest.raises(LostRace):
        kept._write(began, content, [0, 1, 2, 3], spark.range(3).withColumn("v", F.lit("late")))
    assert {r["id"]: r["v"] for r in kept.read().collect()} == {i: "b" if i == 1 else "a" for i in range(10)}
    assert Manifest(spark, f"file://{tmp_path}/t").read()[0] == 2
