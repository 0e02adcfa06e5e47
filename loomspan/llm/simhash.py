"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

The fingerprint has bit b set if over half of the text's shingle hashes (XXH64, seed 42, repeats included) have it.
Fingerprints link at a Hamming distance of RADIUS = 2 or less. Covering LSH gives each of the 64 bit positions one of
the 7 non-zero vectors of GF(2)^3 and makes one table for each of the 7 masks v: the table's key is the fingerprint's
bits whose vector has an odd inner product with v. Two positions span a plane at most, some v is orthogonal to both,
and in that table the two fingerprints have one key: no pair within the radius is missed.

Texts of one fingerprint are one node, so copies cost nothing. In a table's bucket of up to SMALL fingerprints the
pairs are compared; those of a larger bucket take an exact way whose groups geometry bounds: each fingerprint is filed
under itself and its 64 neighbours at distance 1, and two fingerprints are within 2 of each other exactly if they are
filed together somewhere. No such file has over 65 fingerprints, all within 2 of each other, so a star links them.
That second way isn't covering LSH; it costs 65 rows for each fingerprint of a large bucket.

For near copies of text a wider radius is asked for: WIDE = 6, with shingles of five words. There position b has the vector
64 + b of GF(2)^7. Six positions span less than the space, so some of the 127 masks is orthogonal to all of them; and the
masks are the words of a first-order Reed-Muller code, so each keeps 32 of the 64 bits (one keeps all) and its buckets hold
next to nothing but near copies. Buckets of more than two go in parts of about PART fingerprints, part against part; each
comparison gives a tree of links for every component that it finds, never all pairs.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text of one or two words has its
whole word sequence as the only shingle; texts of any length are read whole; repeated rows get equal results; a null id
is never a component's name while the component has another; an empty table gives no rows; further columns are left out
by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, sieved, unboxed, unhexed, whole, written
from .components import components

SEED, SHINGLE, RADIUS, SMALL = 42, 3, 2, 16
WIDE, WIDE_SHINGLE, PART = 6, 5, 1024
#: Fingerprints that a task files under all wide masks: 127 rows each, which it can add up in memory.
FILED = 8192
_AT_ONCE = 1 << 18


def _masks() -> list[int]:
    odd = lambda x: x.bit_count() & 1
    masks = [sum(1 << bit for bit in range(64) if odd((bit % 7 + 1) & v)) for v in range(1, 8)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _wide_masks() -> list[int]:
    masks = [sum(1 << bit for bit in range(64) if ((64 + bit) & v).bit_count() & 1) for v in range(1, 128)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text. bytes.lower() and bytes.split() know A-Z and ASCII white space only."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), _AT_ONCE):
        h = np.array([digest(line[a:b], seed) for a, b in zip(first[at : at + _AT_ONCE], last[at : at + _AT_ONCE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp, h) with the fingerprint as a signed 64-bit number, and the text's MD5."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], names=["id", "fp", "h"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType()), T.StructField("h", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), unhexed(F.md5(whole(text_col))).alias("h")).mapInArrow(run, schema)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, that connect all fingerprints (column fp, distinct) within the radius."""
    filed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(_masks())])).alias("at")).select("fp", "at.*")
    sizes = filed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(filed.join(sizes, ["v", "key"]))

    def near(fps: Column) -> Column:
        return F.flatten(F.transform(fps, lambda a, i: F.transform(F.filter(F.slice(fps, i + 2, F.lit(SMALL)), lambda b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS), lambda b: F.struct(a.alias("a"), b.alias("b")))))

    small = shared.where(F.col("n") <= SMALL).groupBy("v", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode(F.transform(F.array("fps"), near)).alias("links")).select(F.explode("links").alias("x")).select("x.*")
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    dense = shared.where(F.col("n") > SMALL).select("fp").distinct().select("fp", F.explode(flips).alias("near"))
    files = dense.groupBy("near").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = files.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return pairs.unionByName(stars).distinct()


def _tree(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of ``a`` and ``b`` within the radius connect: each to the first of its component."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    every, none = np.concatenate([a, b]), len(a) + len(b)
    of_a, of_b = np.arange(len(a)), len(a) + np.arange(len(b))
    while True:
        new_b = np.minimum(of_b, np.where(near, of_a[:, None], none).min(axis=0))
        new_a = np.minimum(of_a, np.where(near, new_b[None, :], none).min(axis=1))
        if (new_a == of_a).all() and (new_b == of_b).all():
            break
        of_a, of_b = new_a, new_b
    first = every[np.concatenate([of_a, of_b])]
    return every[every != first], first[every != first]


def wide_links(nodes: DataFrame, radius: int = WIDE) -> DataFrame:
    """Distinct pairs (a, b) that connect all fingerprints (column fp, distinct) within a radius of six at most."""
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(_wide_masks())]))
    spread = nodes.repartition(1 + nodes.count() // FILED, "fp")
    filed = spread.select("fp", at.alias("at")).select("fp", F.xxhash64("at.v", "at.key").alias("key"))  # keys of two tables that meet cost a comparison
    shared = written(filed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    more = shared.where("n > 2").select("key", "n")
    among = sieved(filed, F.col("key"), more.select("key"), more.count()).where("hit").join(more, "key")
    parts = written(among.withColumn("part", F.pmod(F.hash("fp"), F.ceil(F.col("n") / PART).cast("int"))).groupBy("key", "part").agg(F.collect_list("fp").alias("fps")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = _tree(x.values.to_numpy(), y.values.to_numpy(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    other = parts.select("key", F.col("part").alias("to"), F.col("fps").alias("others"))
    against = parts.join(other, "key").where("part <= to").select("fps", "others").mapInArrow(compare, "a long, b long")
    return pairs.unionByName(against).where("a <> b").distinct()


def _members(docs: DataFrame, id_col: str, text_col: str, wide: bool = False) -> DataFrame:
    """Per row: id, fp, h (the text's MD5), component (the smallest id that links reach), keeper (id and h of the row to keep)."""
    prints = written(fingerprints(docs, id_col, text_col, WIDE_SHINGLE if wide else SHINGLE))
    keeper = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.min(keeper).alias("keeper"))
    roots = components(wide_links(nodes.select("fp")) if wide else links(nodes.select("fp")))
    grouped = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"), F.min("keeper").alias("keeper"))
    return prints.join(grouped.select("fp", "root").join(smallest, "root").drop("root"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    return _members(docs, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns. ``wide``: groups by shingles of five
    words and six bits.

    Rows are told apart by id and text, so another text of the same id is a document of its own. Of rows of one id
    and text one stays. Documents that are alone in their group aren't shuffled.
    """
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    decided = written(_members(docs, id_col, text_col, wide).groupBy("id", "h").agg(F.first(mine == F.col("keeper")).alias("stays"), F.count("*").alias("n")))
    key = F.xxhash64("id", "h")
    rows = docs.select(boxed(docs).alias("doc"), F.col(id_col).alias("id"), unhexed(F.md5(whole(text_col))).alias("h"))
    touched = decided.where(~F.col("stays") | (F.col("n") > 1)).select(key.alias("k"))
    marked = sieved(rows, key, touched, touched.count())
    stays = decided.where("stays").select(F.col("id").alias("s_id"), F.col("h").alias("s_h"))
    among = marked.where("hit").join(stays, (F.col("h") == F.col("s_h")) & F.col("id").eqNullSafe(F.col("s_id")), "left_semi").groupBy("id", "h").agg(F.first("doc").alias("doc"))
    return unboxed(marked.where(~F.col("hit")).select("doc").unionByName(among.select("doc")), docs.columns)
