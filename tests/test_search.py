import math
import re
from collections import Counter

from loomspan.queries import text
from loomspan.retrieval import search
from loomspan.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute(docs, vectors, query, vector):
    """Final six of all documents in scope, with or without a vector."""
    words = {i: Counter(re.findall("[a-z0-9]+|[\u0980-\u09ff]+", (t or "").lower())) for i, t in docs.items()}
    n, avg = len(docs), sum(sum(w.values()) for w in words.values()) / len(docs)
    score = dict.fromkeys(docs, 0.0)
    for t in search.query_terms(query):
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            score[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / avg))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    near = {i: sum(a * b for a, b in zip(vectors[i], vector)) / norm(vectors[i]) / norm(vector) for i in docs if i in vectors}
    top = lambda s: [i for x, i in sorted((-round(x, 6), i) for i, x in s.items())][:20]
    ranks = [{i: k for k, i in enumerate(top(s), 1)} for s in ({i: x for i, x in score.items() if round(x, 6) > 0}, near)]
    both = {i: round(sum(1 / (60 + r[i]) for r in ranks if i in r), 9) for i in {*ranks[0], *ranks[1]}}
    best = sorted(both, key=lambda i: (-both[i], ranks[0].get(i, math.inf), i))[:8]
    return {i: both[i] for i in sorted(best, key=lambda i: (-both[i], i))[:6]}


def test_documents_without_a_vector_are_searched_by_words(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect() if r["source"] in {f"src{i}" for i in range(1, 6)}}
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, SF, "embeddings").collect()}
    assert 0 < sum(i in vectors for i in docs) < len(docs)
    want = brute(docs, vectors, text.QUERY, text.VECTOR)
    assert {r["doc_id"]: r["score"] for r in text.hybrid_retrieve(spark, SF).collect()} == want
    assert any(i not in vectors for i in want)


def test_no_vector_at_all(spark):
    rows = spark.createDataFrame([(1, "red fox", None), (2, "blue fox", None), (3, "dog", None)], "doc_id long, text string, embedding array<float>")
    got = search.retrieve(rows, "fox", [1.0, 0.0], rows["doc_id"] > 0).collect()
    assert [r["doc_id"] for r in got] == [1, 2]
