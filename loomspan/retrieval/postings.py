"""Keyword search over kept postings: (term, document, frequency), by term, added and removed by source.

An addition writes a segment: its postings in folders by a hash of the term, its documents, and how many of them each term
is in. Postings are kept in blocks of documents: a row has a term's documents of one block as lists. A removal writes which
documents go and how many of them each term was in, so counts stay exact without reading postings. A search reads the
folders of its terms alone and brings the lists of one block, with the questions that have their terms, to one task, which
adds up its documents' scores in arrays and hands on k of each question at most: neither postings nor pairs of questions and
documents are rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Manifest, scratch
from .search import K1, B, tokens

BUCKETS = 64
#: Bytes of text of a block, give or take a document.
BLOCK = 1 << 25
#: Terms of all questions (some 350 MB) that are broadcast, and that meet a block at once; of more, each block meets parts.
BROADCAST_TERMS = 1 << 21
#: The folder of the blocks' documents, beside those of the terms.
DOCUMENTS = -1
#: Postings that a task adds up at once, of questions that few of its documents answer.
_MEETS = 1 << 21
_SLACK = 1e-9  # scores that must be reached are compared with sums of floats
#: What ``search.tokens`` takes, by byte: a-z and 0-9; of the others only U+0980 to U+09FF, which are E0 A6 and E0 A7.
_PLAIN = bytes(b in b"abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256))


def _tokens(texts: pa.LargeBinaryArray) -> tuple[pa.StringArray, np.ndarray]:
    """The tokens of lower-cased texts, one after the other, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    found = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.frombuffer(bytearray(found.tobytes().translate(_PLAIN)), np.uint8)
    lead = np.flatnonzero(found == 0xE0)
    lead = lead[(found[lead + 1] & 0xFE) == 0xA6]
    for i in range(3):
        kind[lead + i] = 2
    first = np.empty(len(kind), bool)
    first[:1], first[1:] = True, kind[1:] != kind[:-1]
    first[ends[:-1][ends[:-1] < len(kind)]] = True  # no token goes on in the next text
    first = np.flatnonzero(first)
    sizes, taken = np.diff(np.append(first, len(kind))), kind[first] > 0
    starts = np.append(0, np.cumsum(sizes[taken])).astype(np.int32)
    number = np.diff(np.searchsorted(first[taken], ends))
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(found[kind > 0])), number


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, term, docs, counts, ids, sources) of (doc_id, source, text), the texts in lower case. A block's number is that of its
    first document, ``docs`` are numbers from there on, ``counts`` how often a term is in them. A row without a term has the
    block's documents: their lengths as ``counts``, ``ids`` and ``sources``."""

    def packed(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        ids, sources, texts = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in range(3))
        every, lens = _tokens(texts)
        every = every.dictionary_encode()
        n, terms = len(lens), every.dictionary
        places = np.sort(every.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens))
        at = _changes(places)
        term, doc = np.divmod(places[at], n)
        ends = np.append(_changes(term), len(term))
        whole = np.array([0, n])

        def rows(size: int, *columns: pa.Array | None) -> pa.RecordBatch:
            arrays = [pa.nulls(size, f.type) if c is None else c for c, f in zip(columns, layout)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *arrays], names=["block", *(f.name for f in layout)])

        layout = [pa.field("term", pa.string()), *(pa.field(c, pa.list_(pa.int32())) for c in ("docs", "counts")), pa.field("ids", pa.list_(ids.type)), pa.field("sources", pa.list_(sources.type))]
        for i in range(0, len(terms), 10_000):
            part = slice(ends[i], ends[min(i + 10_000, len(terms))])
            cut = ends[i : i + 10_001] - ends[i]
            yield rows(len(cut) - 1, terms[i : i + 10_000], _lists(cut, doc[part]), _lists(cut, np.diff(np.append(at, len(places)))[part]), None, None)
        yield rows(1, None, _lists(whole, np.arange(n)), _lists(whole, lens), *(pa.ListArray.from_arrays(pa.array(whole, pa.int32()), c) for c in (ids, sources)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            batch = batch.set_column(2, "text", texts)
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy() + 16), 0  # empty ones fill a block too
            while at < batch.num_rows:
                end = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(ends[end - 1] - (ends[at - 1] if at else 0))
                at = end
                if size >= BLOCK:
                    yield from packed(held, block)
                    held, size, block = [], 0, block + sum(b.num_rows for b in held)
        if held:
            yield from packed(held, block)

    numbers = T.ArrayType(T.IntegerType())
    kinds = {"block": T.LongType(), "term": T.StringType(), "docs": numbers, "counts": numbers, "ids": T.ArrayType(docs.schema["doc_id"].dataType), "sources": T.ArrayType(docs.schema["source"].dataType)}
    return docs.select("doc_id", "source", "text").mapInArrow(run, T.StructType([T.StructField(*f) for f in kinds.items()]))


def _best(k: int, avg: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query_id, doc_id, score), k of each question at most, of a block's lists, each with the questions that have its term,
    and the block's documents."""

    def run(lists: pa.Table, docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc_id")
        n, place = docs.num_rows, docs.column("pos").to_numpy()
        docs_of, counts, queries = (lists.column(c).combine_chunks() for c in ("docs", "counts", "queries"))
        if not n or not lists.num_rows:
            return pa.table({"query_id": queries.flatten()[:0], "doc_id": docs.column("doc_id")[:0], "score": pa.array([], pa.float64())})
        ends, pos, tf = np.append(0, np.cumsum(pc.list_value_length(docs_of).to_numpy())), docs_of.flatten().to_numpy(), counts.flatten().to_numpy()
        number, long = np.full(max(place.max(), pos.max()) + 1, n), np.zeros(n + 1)  # those that were removed share the last number
        number[place], long[:n] = np.arange(n), docs.column("len").to_numpy()
        doc = number[pos]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[doc] / avg))
        asked = queries.flatten().dictionary_encode()
        row, query = np.repeat(np.arange(len(queries)), pc.list_value_length(queries).to_numpy()), asked.indices.to_numpy()
        idf = lists.column("idf").to_numpy()
        by = np.lexsort((row, -idf[row], query))
        row, query = row[by], query[by]
        size = np.diff(ends)[row]
        dense = np.bincount(query, size) > n / 4
        out, whole, known = [], {}, {}

        def weights(r: int) -> np.ndarray:
            """A list that many documents are in, as one number a document."""
            if r not in whole:
                whole[r] = np.zeros(n + 1)
                whole[r][doc[ends[r] : ends[r + 1]]] = part[ends[r] : ends[r + 1]]
            return whole[r]

        def top(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score = np.zeros(n + 1)
            for r in rows.tolist():
                if ends[r + 1] - ends[r] > n / 4:
                    score += idf[r] * weights(r)
                else:
                    score[doc[ends[r] : ends[r + 1]]] += idf[r] * part[ends[r] : ends[r + 1]]
            score = score[:n]
            least = np.partition(score, n - k)[n - k] if n > k else 0
            hit = np.flatnonzero((score >= least - _SLACK) & (score > 0))
            hit = hit[np.argsort(-np.round(score[hit], 12), kind="stable")[:k]]
            return hit, score[hit]

        begins = np.append(_changes(query), len(query))
        for a, b in zip(begins, begins[1:]):
            if dense[query[a]]:
                key = row[a:b].tobytes()  # equal questions are answered once
                if key not in known:
                    known[key] = top(row[a:b])
                out.append((np.full(len(known[key][0]), query[a]), *known[key]))
        few = ~dense[query]
        row, query, size = row[few], query[few], size[few]
        begins = _changes(query)
        past = np.append(0, np.cumsum(size))
        while len(begins):
            after = np.searchsorted(past[begins], past[begins[0]] + _MEETS)  # whole questions
            a, b = begins[0], begins[after] if after < len(begins) else len(query)
            begins = begins[after:]
            at = np.arange(past[a], past[b]) + np.repeat(ends[row[a:b]] - past[a:b], size[a:b])
            pair = np.repeat(query[a:b].astype(np.int64), size[a:b]) * (n + 1) + doc[at]
            by = np.argsort(pair, kind="stable")
            pair = pair[by]
            first = _changes(pair)
            score = np.add.reduceat((np.repeat(idf[row[a:b]], size[a:b]) * part[at])[by], first) if len(first) else np.zeros(0)
            q, d = np.divmod(pair[first], n + 1)
            q, d, score = q[d < n], d[d < n], score[d < n]
            by = np.lexsort((d, -np.round(score, 12), q))
            q, d, score = q[by], d[by], score[by]
            new = _changes(q)
            kept = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < k
            out.append((q[kept], d[kept], score[kept]))
        q, d, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asked.dictionary.take(pa.array(q)), "doc_id": docs.column("doc_id").take(pa.array(d)), "score": pa.array(score)})

    return run


def _bucket() -> Column:
    return F.when(F.col("term").isNotNull(), F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")


class Postings:
    """``root`` holds segments and removals; the manifest says in which order they came."""

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)

    def _read(self, kind: str, what: str) -> DataFrame | None:
        """One table of all segments or removals, with their numbers as ``at``."""
        parts = [self.spark.read.parquet(f"{self.root}/{path}/{what}").withColumn("at", F.lit(at)) for at, (k, path) in enumerate(self.manifest.read()[1].get("steps", [])) if k == kind]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _commit(self, began: int, content: dict, kind: str, path: str) -> None:
        self.manifest.commit(began, {"steps": [*content.get("steps", []), (kind, path)]})

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        """Documents that the index doesn't hold, or no longer; a null text has no terms but counts as a document."""
        began, content = self.manifest.read()
        path = f"segment-{uuid.uuid4().hex}"
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
        rows = _blocks(texts).withColumns({"df": F.when(F.col("term").isNotNull(), F.size("docs")), "bucket": F.coalesce(_bucket(), F.lit(DOCUMENTS))})
        rows = rows.repartition("bucket", F.when(F.col("term").isNull(), F.col("block")))
        rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{path}/postings")
        terms = self.spark.read.parquet(f"{self.root}/{path}/postings").where(F.col("bucket") != DOCUMENTS)
        terms.groupBy("term").agg(F.sum("df").alias("df")).write.option("compression", "zstd").parquet(f"{self.root}/{path}/terms")
        self._commit(began, content, "add", path)

    def remove(self, source: str) -> int:
        """All documents of a source that are there now; returns how many."""
        began, content = self.manifest.read()
        gone = self._numbered()
        if gone is None:
            return 0
        path = f"removal-{uuid.uuid4().hex}"
        gone.where(F.col("source") == source).select("doc_id", "len", F.col("at").alias("segment"), "number").write.parquet(f"{self.root}/{path}/documents")
        gone = self.spark.read.parquet(f"{self.root}/{path}/documents")
        lost = None
        for at in [r[0] for r in gone.select("segment").distinct().collect()]:  # a number a segment; each by one key of 64 bits
            rows = self._rows().where(F.col("at") == at).select("term", "block", F.explode("docs").alias("pos")).select("term", (F.col("block") + F.col("pos")).alias("number"))
            rows = rows.join(gone.where(F.col("segment") == at).select("number"), "number", "left_semi").select("term")
            lost = rows if lost is None else lost.unionByName(rows)
        lost = self.spark.createDataFrame([], "term string") if lost is None else lost
        lost.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.root}/{path}/terms")
        self._commit(began, content, "remove", path)
        return gone.count()

    def _numbered(self) -> DataFrame | None:
        """(doc_id, source, len, at, block, pos, number) of all documents that are in the index. A removal names the segment of
        each document, so one that was added again stays."""
        rows, gone = self._read("add", "postings"), self._read("remove", "documents")
        if rows is None:
            return None
        rows = rows.where(F.col("bucket") == DOCUMENTS).select("at", "block", F.inline(F.arrays_zip("docs", "counts", "ids", "sources")).alias("pos", "len", "doc_id", "source"))
        rows = rows.select("doc_id", "source", "len", "at", "block", "pos", (F.col("block") + F.col("pos")).alias("number"))
        return rows if gone is None else rows.join(gone.select("number", F.col("segment").alias("at")), ["number", "at"], "left_anti")

    def documents(self) -> DataFrame | None:
        """(doc_id, source, len, at) of all documents that are in the index."""
        rows = self._numbered()
        return None if rows is None else rows.select("doc_id", "source", "len", "at")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("add", "postings")
        return rows.where(F.col("bucket") != DOCUMENTS if buckets is None else F.col("bucket").isin(buckets)).drop("ids", "sources")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, term, tf, len, at, bucket): a row for each document of the lists."""
        rows = self._rows(buckets).select("at", "block", "bucket", "term", F.inline(F.arrays_zip("docs", "counts")).alias("pos", "tf"))
        return rows.join(self._numbered(), ["at", "block", "pos"]).select("doc_id", "term", "tf", "len", "at", "bucket")

    def terms(self) -> DataFrame:
        """(term, df): in how many documents each term is."""
        rows, gone = self._read("add", "terms").drop("at"), self._read("remove", "terms")
        rows = rows if gone is None else rows.unionByName(gone.select("term", (-F.col("df")).alias("df")))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, doc_id, score) for questions (query_id, term), by BM25 as ``search.bm25`` has it."""
        docs = self._numbered()
        n, avg = docs.agg(F.count("*"), F.avg("len")).first()
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        path = scratch(self.spark, "asked")
        questions.select("query_id", "term").distinct().join(self.terms(), "term").select("query_id", "term", idf.alias("idf")).write.parquet(path)
        known = self.spark.read.parquet(path)
        buckets = sorted(r[0] for r in known.select(_bucket()).distinct().collect())  # BUCKETS numbers at most
        asked = known.count()
        parts = -(-asked // BROADCAST_TERMS)
        known = known.groupBy("term", F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).cast("int").alias("part")).agg(F.collect_list("query_id").alias("queries"), F.first("idf").alias("idf"))
        lists = self._rows(buckets).join(F.broadcast(known) if asked <= BROADCAST_TERMS else known, "term").select("at", "block", "part", "docs", "counts", "queries", "idf")
        docs = docs.select("at", "block", F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))).alias("part"), "pos", "doc_id", "len")
        schema = T.StructType([T.StructField("query_id", questions.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
        cell = ("at", "block", "part")
        found = lists.groupBy(*cell).cogroup(docs.groupBy(*cell)).applyInArrow(_best(k, avg), schema)
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def rarest(self, docs: DataFrame, most: int, least_df: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(query_id, term): the rarest terms of each given document that as many of the index have, as a question for alike ones."""
        words = docs.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
        by = Window.partitionBy("query_id").orderBy("df", "term")
        return words.join(self.terms().where(F.col("df") >= least_df), "term").withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("query_id", "term")
