"""Keyword search (BM25), vector search (cosine), and their fusion by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60
# Words that don't count in a question, unless it has no others.
STOP = frozenset(
    "a an the is are was were be been of in on at to for from by with and or not no it its this that these those what which who whom whose when where why how do does did can could should would will shall"
    " may might must have has had our we you your their they them there here as if than then so such any all each every per about into over under up down out".split()
)
TOKEN = r"[a-z0-9]+|[ঀ-৿]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: str) -> list[str]:
    """Distinct tokens without stop words, unless nothing else is left."""
    import re

    every = list(dict.fromkeys(re.findall(TOKEN.encode().decode("unicode_escape"), text.lower())))
    return [t for t in every if t not in STOP] or every


def bm25(docs: DataFrame, query: str, k: int = 20, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """Top k of the documents that pass ``where`` (applied before anything is counted), with positive scores.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Only the query's terms are counted, in one pass and without exploding
    the texts; the frequencies of terms are a row.
    """
    terms = query_terms(query)
    rows = docs if where is None else docs.where(where)
    base = rows.select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    counted = base.select(F.col(id_col), F.size("t").alias("len"), *[F.size(_only("t", t)).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = counted.repartition(id_col)  # one exchange of small rows, which the statistics and the scores both read: texts are tokenised once
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return scored.select(id_col, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def _only(column: str, term: str) -> Column:
    return F.filter(column, lambda x: x == F.lit(term))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact top k by cosine; the vectors are read once and k rows of each task are compared at the end."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def fused(first: DataFrame, second: DataFrame, k: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Sum of 1 / (60 + rank) over both lists (of a few rows each); ties go by the first list's rank, then by id."""
    ranks = []
    for n, df in enumerate((first, second)):
        by = Window.orderBy(F.desc("score"), id_col)
        ranks.append(df.select(id_col, F.row_number().over(by).alias("rank"), F.lit(n).alias("list")))
    both = ranks[0].unionByName(ranks[1])
    out = both.groupBy(id_col).agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.when(F.col("list") == 0, F.col("rank"))).alias("first_rank"))
    return out.orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), id_col).limit(k).select(id_col, "score")


def retrieve(chunks: DataFrame, query: str, vector: list[float], scope: Column, each: int = 20, candidates: int = 8, final: int = 6, rerank=None) -> DataFrame:
    """The whole search over chunks (doc_id, text, embedding, ...): scope first, both searches, fusion, re-ranking.

    A chunk whose embedding is null is found by its words alone.
    ``rerank`` takes and returns the candidates with a score; without one the fused order stands.
    """
    seen = chunks.where(scope)
    words = bm25(seen, query, each)
    near = nearest(seen, vector, each, id_col="doc_id", where=F.col("embedding").isNotNull())
    best = fused(words, near, candidates)
    best = rerank(best.join(seen, "doc_id")) if rerank else best
    return best.orderBy(F.desc("score"), "doc_id").limit(final)
