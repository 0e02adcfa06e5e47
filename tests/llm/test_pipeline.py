from collections import Counter

import corpus_pipeline
from loomspan.llm import exact_dedup, quality, simhash

from . import cases


def test_stages_take_and_return_documents(spark, tmp_path):
    good = [" ".join(f"{a}{i}{j}" for j in range(70)) for i, a in enumerate("abcdefghij" * 3)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0].upper(), "en", "s0", 0), (101, good[1], "en", "s1", 0), (102, "too short", "en", "s0", 0), (103, None, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = f"{tmp_path}/documents.parquet"
    docs.write.parquet(path)
    frame = spark.read.parquet(path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near-dedup", "mixing", "packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert frame.columns == docs.columns
            frame.write.parquet(f"{tmp_path}/stage{k}")
            frame = spark.read.parquet(f"{tmp_path}/stage{k}")
            seen.append({r["doc_id"] for r in frame.collect()})
    upper_goes = quality.keep_good(docs.where("doc_id = 100")).count() == 0
    assert seen[0] == set(range(30)) | {101} | (set() if upper_goes else {100})
    assert seen[1] == set(range(30)) == seen[2]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, frame.collect())) and run.count() >= 20


def test_odd_documents_go_through(spark, tmp_path):
    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 10


def test_the_stages_are_the_operators(spark, tmp_path):
    docs = cases.frame(spark)
    names = lambda df: sorted(map(str, df.collect()))
    assert names(corpus_pipeline.exact_duplicates(spark, docs, "")) == names(exact_dedup.drop_exact_duplicates(docs))
    assert names(corpus_pipeline.near_duplicates(spark, docs, "")) == names(simhash.keep_one(docs, wide=True))
