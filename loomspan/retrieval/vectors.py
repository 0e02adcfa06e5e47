"""A vector index: cells around fitted centroids, every row in the cell of its nearest, search of the nearest cells.

The centroids are fitted on at most ``SAMPLE`` rows, chosen by a hash of their id; all rows are assigned and kept, cell by
cell, as blocks of up to ``BLOCK`` rows. A search brings blocks of questions and blocks of rows together by cell, so what
is joined is blocks, never rows with rows, and a cell with very many rows is many blocks. Each pair of blocks is one
matrix product, of which every question keeps its k best; scores are exact. How many cells have to be searched for a
wanted recall depends on the vectors, and is found on questions of the sample against exact results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Copies

SAMPLE, BLOCK, MOST_CELLS, TRIED = 20_000, 1024, 1024, 200
_KEPT = "cell int, ids array<long>, vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def sample(vectors: DataFrame, most: int, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Up to ``most`` unit vectors, those with the smallest hashes of their ids: the same ones at every run."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(vector_col).limit(most).collect()
    return unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def centroids(points: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means over a bounded sample: directions that the points of a cell add up to."""
    random = np.random.default_rng(seed)
    centers = points[np.sort(random.choice(len(points), min(cells, len(points)), replace=False))]
    for _ in range(rounds):
        nearest = (points @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        empty = np.bincount(nearest, minlength=len(centers)) == 0
        centers = unit(np.where(empty[:, None], centers, sums))
    return centers


class VectorIndex:
    """``root`` holds versions of the index, of which readers see one whole one."""

    def __init__(self, copies: Copies, name: str) -> None:
        self.copies, self.name, self.spark = copies, name, copies.spark

    @property
    def about(self) -> dict:
        """Centroids and the number of cells to search: at most MOST_CELLS vectors, read on the driver."""
        if (meta := self.copies.meta(self.name)) is None:
            raise LookupError(f"no index {self.name} yet")
        return json.loads(meta["views"][0])

    def build(self, vectors: DataFrame, now, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 20) -> dict:
        """Fits, assigns and writes all rows that have a vector; a null one isn't found by vectors."""
        points = sample(vectors, SAMPLE, id_col, vector_col)
        cells = cells or int(min(MOST_CELLS, max(1, round(len(points) ** 0.5 / 2))))
        centers = centroids(points, cells) if len(points) else np.zeros((1, 1))
        probes = self._probes(points, centers, recall, k)
        dim = centers.shape[1]
        rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = unit(_matrix(batch.column(1), dim))
                    cell = (x @ centers.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["cell", "id", "vector"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed(batches, ["cell", "ids", "vectors"], [pa.int32(), pa.list_(pa.int64()), pa.binary()])

        cell_rows = rows.mapInArrow(assign, "cell int, id long, vector binary")
        kept = cell_rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(pack, _KEPT)
        return self.copies.write(self.name, kept, now, views=(json.dumps({"centers": centers.tolist(), "probes": probes}),))

    @staticmethod
    def _probes(points: np.ndarray, centers: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells whose search finds this share of the exact results, for TRIED points within the sample."""
        if len(points) <= k:
            return len(centers)
        asked = points[:: max(1, len(points) // TRIED)]
        exact = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :k]
        cell = (points @ centers.T).argmax(axis=1)
        rank = np.empty((len(asked), len(centers)), np.int64)
        np.put_along_axis(rank, np.argsort(-(asked @ centers.T), axis=1, kind="stable"), np.arange(len(centers))[None, :], axis=1)
        needed = np.sort(np.take_along_axis(rank, cell[exact], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest rows of the ``probes`` nearest cells, by cosine, then id."""
        about = self.about
        centers = np.array(about["centers"])
        return found(self.copies.read(self.name), self._asked(queries, centers, min(probes or about["probes"], len(centers)), id_col, vector_col), k, centers.shape[1])

    def exact(self, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """The same over all cells."""
        return self.search(queries, k, len(self.about["centers"]), id_col, vector_col)

    @staticmethod
    def _asked(queries: DataFrame, centers: np.ndarray, probes: int, id_col: str, vector_col: str) -> DataFrame:
        """Questions in blocks, for each cell that they search."""
        dim = centers.shape[1]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = unit(_matrix(batch.column(1), dim))
                    cell = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    at = np.repeat(np.arange(len(x)), cell.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), batch.column(0).take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["cell", "id", "vector"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed(batches, ["asked_cell", "asked", "questions"], [pa.int32(), pa.list_(pa.int64()), pa.binary()])

        rows = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(probe, "cell int, id long, vector binary")
        return rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(pack, "asked_cell int, asked array<long>, questions binary")


def _packed(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, id, vector) to rows of one cell with up to BLOCK ids and vectors."""
    cell, ids, parts = None, [], []
    for batch in batches:
        for c, i, v in zip(*(x.to_pylist() for x in batch.columns)):
            if ids and (c != cell or len(ids) == BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((cell, ids, b"".join(parts)), kinds)], names=names)
                ids, parts = [], []
            cell = c
            ids.append(i)
            parts.append(v)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((cell, ids, b"".join(parts)), kinds)], names=names)


def best(order: Column | str = "score", by: str = "query_id", tie: str = "vec_id") -> Window:
    """Ranks by score, of equal ones (to twelve digits) the smallest id first."""
    return Window.partitionBy(by).orderBy(F.desc(F.round(order, 12)), tie)


def found(kept: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """Every block of questions with the blocks of its cell: the k best of each pair, then of all."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, asked_ids, questions in zip(*(batch.column(i) for i in range(4))):
                x, q = (np.frombuffer(b.as_buffer(), np.float64).reshape(-1, dim) for b in (vectors, questions))
                own, rows = asked_ids.values.to_numpy(), ids.values.to_numpy()
                score = q @ x.T
                n = min(k, len(rows))
                if n < len(rows):  # all rows that reach the n-th best score, so that ties are settled by id later
                    least = np.partition(score, len(rows) - n, axis=1)[:, len(rows) - n, None] - 1e-12
                    at, to = np.nonzero(score >= least)
                else:
                    at, to = np.divmod(np.arange(score.size), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(rows[to]), pa.array(score[at, to])], names=["query_id", "vec_id", "score"])

    pairs = kept.join(asked, kept["cell"] == asked["asked_cell"]).select("ids", "vectors", "asked", "questions").mapInArrow(multiply, _FOUND)
    return pairs.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
