"""Scores texts by a bigram model with deleted interpolation, learned from the corpus itself.

P(w | h) = l2 c(h, w)/c(h) + l1 c(w)/N + l0 1/(V + 1), with weights l for each bucket of context frequency c(h) (0, 1, 2,
3-4, 5-8, ...). Of the documents to learn from, those with remainder HELD are deleted from the counts, and the weights
are learned by expectation-maximisation on the counts of the deleted part; then all of them give the counts. Tokens are
the words and one end; the first word's context is the end of what was before.

How it is computed. Documents stand in chunks of about CHUNK tokens. A chunk sends each distinct word and bigram once,
as a 64-bit hash with its counts, to the bucket that the hash falls into; the bucket adds up and answers each chunk with
the totals. Buckets are as many as the bytes of the texts ask for, and a task takes its own one by one from rows that Spark
has sorted, so what it holds doesn't grow with the corpus. A word pair that stands in a third of all documents is one number
of each chunk, and no model is ever broadcast. A chunk and its answers meet in one task, which has all that its documents' scores need. Chunks are cut from
the input twice, once for what they send and once for what they keep; both cuts carry a checksum of the hashes, and an
input that isn't read equally both times is an error (write it first).

Defined cases: a null or empty text is the end token alone; repeated rows are scored and counted each; an empty table
gives no rows; without any document to learn from all counts are 0 and the weights equal, so each token has the
probability 1/3; a null id counts as the text ''; further columns are left out. A document is never cut, so a chunk is at least as long
as its longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole, written

FOLDS, OUT, HELD = 5, 1, 4
CHUNK, ROUNDS, BUCKETS = 1_500_000, 20, 40
#: Bytes of text for each bucket of keys that is in memory at once, and for each task of the shuffles at least.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 64 << 20
_END = np.uint64(xxhash.xxh64_intdigest(b" "))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, not symmetric (the finaliser of MurmurHash3)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1) if len(x) else b""


def _unpack(data: bytes | None, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel() if data else np.zeros(0, kind)


class _Chunk:
    """The tokens of some documents: ``ids`` of words (0 is the end), ``sizes`` and ``parts`` for each document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> None:
        self.ids, self.sizes, self.parts = ids, sizes, parts
        n = int(ids.max()) + 1
        before = np.concatenate((np.zeros(1, ids.dtype), ids[:-1])).astype(np.int64)
        self.pairs, self.of = np.unique(before * n + ids, return_inverse=True)
        self.first, self.second = np.divmod(self.pairs, n)


class _Hashed(_Chunk):
    """A chunk with its keys: the hashes of its words and bigrams, in their order."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> None:
        super().__init__(ids, sizes, parts)
        self.hashes = hashes
        part = np.repeat(parts, sizes)
        self.held = part == HELD
        self.learnt = part != OUT
        keys = np.concatenate((hashes, _mix(hashes[self.first], hashes[self.second])))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def count(self, which: np.ndarray) -> np.ndarray:
        """Of each key, in the order of keys."""
        words = np.bincount(self.ids[which], minlength=len(self.hashes))
        return np.concatenate((words, np.bincount(self.of[which], minlength=len(self.pairs))))[self.order].astype(np.uint32)

    def ordered(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals in the order of keys as those of the words and those of the pairs."""
        out = np.empty_like(totals)
        out[self.order] = totals
        return out[: len(self.hashes)], out[len(self.hashes) :]


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[int, pa.Array, _Hashed]]:
    """(number, ids, chunk) from batches (id, text, part); whole documents, cut alike each time the batches are alike."""
    number = TaskContext.get().partitionId() << 32
    known: dict[bytes, int] = {}
    ids: list[int] = []
    sizes: list[int] = []
    parts: list[int] = []
    rows: list[pa.Array] = []

    def done() -> tuple[int, pa.Array, _Hashed]:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)
        hashes[0] = _END
        return number, pa.concat_arrays(rows), _Hashed(hashes, np.array(ids, np.int32), np.array(sizes, np.int64), np.array(parts, np.int8))

    for batch in batches:
        start = 0
        for at, (text, part) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist())):
            if not known:
                known[b" "] = 0
            words = text.as_py().lower().split()
            ids += [known.setdefault(w, len(known)) for w in words]
            ids.append(0)
            sizes.append(len(words) + 1)
            parts.append(part)
            if len(ids) >= tokens:
                rows.append(batch.column(0).slice(start, at + 1 - start))
                yield done()
                start, number = at + 1, number + 1
                for x in (known, ids, sizes, parts, rows):
                    x.clear()
        rows.append(batch.column(0).slice(start))
    if sizes:
        yield done()


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_SENT = "bucket int, chunk long, keys binary, held binary, learnt binary"
_ANSWER = "chunk long, bucket int, checked long, held binary, learnt binary, owner binary"


def _send(docs: DataFrame, buckets: int, tokens: int) -> DataFrame:
    width = np.uint64((1 << 64) // buckets + 1)
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("held", pa.binary()), ("learnt", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, c in _chunks(batches, tokens):
            held, learnt = c.count(c.held), c.count(c.learnt)
            filled, starts = np.unique(c.keys // width, return_index=True)
            out: dict[str, list] = {x: [] for x in schema.names}
            for b, i, j in zip(filled.tolist(), starts, np.append(starts[1:], len(c.keys))):
                steps = np.diff(c.keys[i:j], prepend=np.uint64(0))
                for name, x in zip(schema.names, (b, number, _pack(steps), _pack(held[i:j]), _pack(learnt[i:j]))):
                    out[name].append(x)
            yield _rows(out, schema)

    return docs.mapInArrow(run, _SENT)


def _answer(sent: DataFrame) -> DataFrame:
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("checked", pa.int64()), ("held", pa.binary()), ("learnt", pa.binary()), ("owner", pa.binary())])

    def answered(b: int, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for _, k, _, _ in asked]
        _, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = lambda i: np.bincount(of, weights=np.concatenate([_unpack(x[i], np.uint32) for x in asked]))  # noqa: E731  exact below 2 ** 53
        held, learnt = total(2).astype(np.uint64), total(3).astype(np.uint64)
        owner = np.zeros(len(of), np.uint8)
        owner[first] = 1
        at = 0
        for (chunk, *_), k in zip(asked, keys):
            mine = of[at : at + len(k)]
            checked = int(np.bitwise_xor.reduce(k).view(np.int64))
            yield _rows({"chunk": [chunk], "bucket": [b], "checked": [checked], "held": [_pack(held[mine])], "learnt": [_pack(learnt[mine])], "owner": [_pack(owner[at : at + len(k)])]}, schema)
            at += len(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        for b, asked in groupby(rows, key=lambda row: row[0]):
            yield from answered(b, [row[1:] for row in asked])

    return sent.sortWithinPartitions("bucket", "chunk").mapInArrow(run, _ANSWER)


def _bucket(c: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3-4, 5-8, ... as 0, 1, 2, 3, 4, ..."""
    return np.where(c == 0, 0, np.minimum(np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1))


def _gathered(docs: DataFrame, answers: DataFrame, parts: int, tokens: int) -> DataFrame:
    """A row for each chunk: what it kept, the totals, and for the deleted part's bigrams what the weights are learned from."""
    id_field = docs.schema["id"]
    kept_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("row_ids", T.ArrayType(id_field.dataType))] + [T.StructField(n, T.BinaryType()) for n in ("sizes", "parts", "hashes", "ids")])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, c in _chunks(batches, tokens):
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            columns = [pa.array([number]), lists] + [pa.array([_pack(x)], pa.binary()) for x in (c.sizes, c.parts, c.hashes, c.ids)]
            yield pa.RecordBatch.from_arrays(columns, names=kept_schema.names)

    kept = docs.mapInArrow(keep, kept_schema).withColumns({"bucket": F.lit(-1), "checked": F.lit(None).cast("long")} | {n: F.lit(None).cast("binary") for n in ("held", "learnt", "owner")})
    # Numbered without gaps while input partitions hold equally many chunks, so that tasks get equally many.
    place = F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)) * kept.rdd.getNumPartitions()
    both = kept.unionByName(answers, allowMissingColumns=True).repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions("chunk", "bucket")
    binary = ["sizes", "parts", "ids", "words", "pairs", "e_bucket", "e_pair", "e_first", "e_second", "e_times"]
    schema = T.StructType([kept_schema["row_ids"]] + [T.StructField(n, T.BinaryType()) for n in binary] + [T.StructField(n, T.LongType()) for n in ("n_estimate", "n_learnt", "v_learnt")])

    def finish(row: dict, answers: list[tuple]) -> pa.RecordBatch:
        c = _Hashed(_unpack(row["hashes"], np.uint64), *_restored(row))
        if sum(len(a[1]) for a in answers) != len(c.keys) or np.bitwise_xor.reduce([a[0] for a in answers]) != np.bitwise_xor.reduce(c.keys).view(np.int64):
            raise ValueError("the documents were not read equally twice; write them to a table first")
        held, learnt, owner = (np.concatenate([a[i] for a in answers]) for i in (1, 2, 3))
        words, pairs = c.ordered(learnt - held)
        times = np.bincount(c.of[c.held], minlength=len(c.pairs))
        some = np.nonzero(times)[0]
        out = {n: row[n] for n in ("sizes", "parts", "ids")} | {n: _pack(x) for n, x in zip(("words", "pairs"), c.ordered(learnt))}
        out |= {"e_bucket": _pack(_bucket(words[c.first[some]]).astype(np.uint8)), "e_times": _pack(times[some].astype(np.uint32))}
        out |= {"e_pair": _pack(pairs[some]), "e_first": _pack(words[c.first[some]]), "e_second": _pack(words[c.second[some]])}
        new = c.ordered((owner == 1) & (learnt > 0))[0]
        values = [pa.array([out[n]], pa.binary()) for n in binary] + [pa.array([int(x)], pa.int64()) for x in ((c.learnt & ~c.held).sum(), c.learnt.sum(), new.sum())]
        return pa.RecordBatch.from_arrays([row["row_ids"], *values], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        answers: list[tuple] = []
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if get["bucket"][i].as_py() < 0:
                    if row:
                        yield finish(row, answers)
                    row, answers = {n: get[n][i].as_py() for n in ("chunk", "sizes", "parts", "hashes", "ids")} | {"row_ids": get["row_ids"].slice(i, 1)}, []
                elif row is None or get["chunk"][i].as_py() != row["chunk"]:
                    raise ValueError("the documents were not read equally twice; write them to a table first")
                else:
                    answers.append((get["checked"][i].as_py(), _unpack(get["held"][i].as_py(), np.uint64), _unpack(get["learnt"][i].as_py(), np.uint64), _unpack(get["owner"][i].as_py(), np.uint8)))
        if row:
            yield finish(row, answers)

    return both.mapInArrow(run, schema)


def _restored(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(row["ids"], np.int32), _unpack(row["sizes"], np.int64), _unpack(row["parts"], np.int8)


def _share(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def learned_weights(gathered: DataFrame, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, of pair / word / uniform) by expectation-maximisation; half an observation each keeps them above 0."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    columns = ["e_bucket", "e_pair", "e_first", "e_second", "e_times"]

    def step(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS, 4))
            for batch in batches:
                for packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    b, pair, first, second, times = (_unpack(x, k) for x, k in zip(packed, (np.uint8, np.uint64, np.uint64, np.uint64, np.uint32)))
                    if not len(b):
                        continue
                    p = weights[b] * np.stack((_share(pair, first), _share(second, float(n)), np.full(len(b), 1 / (v + 1))), axis=1)
                    total = p.sum(axis=1)
                    for k in range(3):
                        sums[:, k] += np.bincount(b, weights=times * p[:, k] / total, minlength=BUCKETS)
                    sums[:, 3] += np.bincount(b, weights=times * np.log(total), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *(pa.array(sums[:, k]) for k in range(4))], names=["bucket", "s0", "s1", "s2", "fit"])

        return gathered.select(*columns).mapInArrow(run, "bucket long, s0 double, s1 double, s2 double, fit double").groupBy("bucket").agg(*[F.sum(x).alias(x) for x in ("s0", "s1", "s2", "fit")]).collect()

    last = -np.inf
    for _ in range(rounds):
        sums = np.zeros((BUCKETS, 4))
        for r in step(weights):
            sums[r["bucket"]] = r["s0"], r["s1"], r["s2"], r["fit"]
        weights = (sums[:, :3] + 0.5) / (sums[:, :3].sum(axis=1, keepdims=True) + 1.5)
        weights[sums[:, :3].sum(axis=1) == 0] = (sums[:, :3].sum(axis=0) + 0.5) / (sums[:, :3].sum() + 1.5)  # as in all buckets together
        if (fit := sums[:, 3].sum()) - last < 1e-5 * abs(fit):
            break
        last = fit
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add 0.5), score (log10 of the text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(whole(text_col)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    buckets = parts * (size // (parts * BUCKET_BYTES) + 1)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("tinyint")
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), fold.alias("part"))
    answers = _answer(_send(rows, buckets, tokens).repartitionById(parts, F.col("bucket") % parts))
    gathered = written(_gathered(rows, answers, parts, tokens), compression="zstd")
    n_estimate, n, v = (x or 0 for x in gathered.agg(F.sum("n_estimate"), F.sum("n_learnt"), F.sum("v_learnt")).first())
    weights = learned_weights(gathered, n_estimate, v, rounds)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema.names) if f != "row_ids"}
                c, words, pairs = _Chunk(*_restored(row)), _unpack(row["words"], np.uint64), _unpack(row["pairs"], np.uint64)
                w = weights[_bucket(words[c.first])]
                p = w[:, 0] * _share(pairs, words[c.first]) + w[:, 1] * _share(words[c.second], float(n)) + w[:, 2] / (v + 1)
                base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
                ends = np.cumsum(c.sizes) - c.sizes
                add = lambda x: np.add.reduceat(x, ends)  # noqa: B023, E731
                of = batch.column(batch.schema.get_field_index("row_ids"))[i].values
                size = len(c.sizes)
                columns = [of, pa.array(c.parts == OUT), pa.array(c.sizes), pa.array(add((words > 0)[c.ids].astype(np.int64))), pa.array(np.full(size, n)), pa.array(add(base[c.ids])), pa.array(add(np.log10(p)[c.of]))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return gathered.select("row_ids", "sizes", "parts", "ids", "words", "pairs").mapInArrow(run, schema).withColumnRenamed("id", id_col)
