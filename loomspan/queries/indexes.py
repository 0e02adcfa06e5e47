"""Queries over kept indexes: vectors in cells, postings, tables by key. All rows whose id is divisible by 20 are asked
against all rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..retrieval.postings import Postings
from ..retrieval.vectors import VectorIndex
from ..sources.store import Copies
from ..sources.tables import table as _t
from ..sources.versions import BucketedTable, scratch

BUILT = dt.datetime(2000, 6, 30)
K, TERMS = 20, 8


def _vectors(spark, sf):
    index = VectorIndex(Copies(spark, scratch(spark, "vectors")), "embeddings")
    index.build(_t(spark, sf, "embeddings"), BUILT, k=K)
    return index, _t(spark, sf, "embeddings").where("vec_id % 20 = 0")


def ann_topk(spark, sf):
    """The cells that hold nineteen of twenty neighbours, as tried on the sample."""
    index, asked = _vectors(spark, sf)
    return index.search(asked, K).withColumn("score", F.round("score", 6))


def knn_topk(spark, sf):
    """All cells: exact."""
    index, asked = _vectors(spark, sf)
    return index.exact(asked, K).withColumn("score", F.round("score", 6))


KNN = f"WITH e AS (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q CROSS JOIN e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}"


def bm25_batch(spark, sf):
    """Documents like those with an id divisible by 20, by their eight rarest shared terms. The index is filled by
    language; one source is removed and added again."""
    docs = _t(spark, sf, "documents")
    index = Postings(spark, scratch(spark, "postings"))
    index.add(docs.where("lang = 'en'"))
    index.add(docs.where("NOT coalesce(lang = 'en', false)"))
    index.remove("src1")
    index.add(docs.where("source = 'src1'"))
    asked = index.rarest(docs.where("doc_id % 20 = 0"), TERMS)
    return index.search(asked, K).withColumn("score", F.round("score", 6))


BATCH = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[ঀ-৿]+') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM d),
p AS (SELECT doc_id, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) x GROUP BY doc_id, t, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT doc_id AS query_id, term, df FROM (SELECT p.doc_id, term, df, row_number() OVER (PARTITION BY p.doc_id ORDER BY df, term) AS place FROM p JOIN f USING (term) WHERE df >= 2 AND doc_id % 20 = 0) x WHERE place <= {TERMS}),
c AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM q JOIN p USING (term) CROSS JOIN s GROUP BY query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM c)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {K}"""


def keyed_orders(spark, sf):
    """Orders by key: all are put in, those of one customer in eleven are changed, those of one in thirteen deleted."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).alias("version"))
    kept = BucketedTable(spark, scratch(spark, "orders"), "o_orderkey", 16)
    kept.upsert(orders)
    kept.upsert(orders.where("o_custkey % 11 = 0").withColumns({"o_orderstatus": F.lit("X"), "version": F.lit(2)}))
    kept.delete(orders.where("o_custkey % 13 = 0").select("o_orderkey"))
    return kept.read().groupBy("o_orderstatus", "version").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


QUERIES = {
    "ann_topk": (ann_topk, None),
    "knn_topk": (knn_topk, KNN),
    "bm25_batch": (bm25_batch, BATCH),
    "keyed_orders": (keyed_orders, "SELECT o_orderstatus, version, count(*) AS n, CAST(sum(o_orderkey) AS bigint) AS keys FROM (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 1 END AS version FROM orders WHERE o_custkey % 13 <> 0) x GROUP BY 1, 2"),
}
