"""Collocations by hierarchical pair naming: frequent phrases of k words are frequent pairs of phrases of k - 1.

Texts become blocks of numbers, one for each place: first of the word that stands there, then, level by level, of the
phrase of k words that begins there. A block numbers its own pairs, so its numbers are small; which pairs are frequent, and
what they are called everywhere, is found by bringing the pairs of all blocks together by parts of their hash. Between two
such phrases stands a 0, so places that lead nowhere are left out of the next level. The name of a phrase keeps the two
names it was made of: these pointers give the frequencies of every beginning and end (for the cuts), and what longer
phrases hold it.

A frequent phrase holds frequent phrases only, so nothing that counts is lost on the way; counts are exact.

Defined cases: a null text counts as empty, a null language as ``und``; pieces of fewer words than a phrase give none;
repeated rows count as often as they occur; a word of any length is a word; a text of any length is one block at least
and goes whole into one; ties go as stated at ``collocations``; an empty table gives no rows; further columns are left
out.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, shared_dir, temporary, whole

LEAST, WORDS, TOP, SHARE, UNKNOWN = 100, 5, 2000, 100, "und"
PLACES = 1 << 21  # of a block; the text that fills it goes in whole
IN_PART, BYTES_OF_PART = 1 << 20, 1 << 24  # pairs of a part at most, bytes of text for each part of words, on average
# What parts pieces, and what parts words.
_PARTING, _BETWEEN = b".,;:!?\n\x0b\x0c\r", b"\t"
_AS = bytes.maketrans(_PARTING + _BETWEEN, b"\n" * len(_PARTING) + b" ")


class _Names(dict):
    """Words of one language with their numbers in the block; an unknown one gets the next."""

    def __init__(self, numbers: Iterator[int]) -> None:
        super().__init__({b"": -1, b"\n": 0})
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = out = next(self.numbers)
        return out


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers from 0 up, each column in as few bytes as its largest needs, bytes of one place together, compressed."""
    widths = [np.min_scalar_type(int(c.max())).itemsize for c in columns]
    planes = b"".join(c.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes() for c, w in zip(columns, widths))
    return bytes(widths) + len(columns[0]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    widths, n = list(data[:columns]), int.from_bytes(data[columns : columns + 4], "little")
    planes, at, out = np.frombuffer(pa.decompress(data[columns + 4 :], n * sum(widths), codec="zstd"), np.uint8), 0, []
    for w in widths:
        out.append(planes[at : at + n * w].reshape(w, n).T.copy().view(f"<u{w}").reshape(-1).astype(np.int64))
        at += n * w
    return out


def _table(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` with these columns, the others null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    said = [c.split() for c in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in said], names=[c for c, _ in said])


#: A block's places are one row (``data``, ``size`` of them, no part); beside it stand its words or pairs, by part.
_OF_WORDS = "block long, size long, data binary, part int, lang string, words binary"
_OF_PAIRS = "block long, size long, data binary, part int, start int"
#: Frequent words or pairs with their names, and for each block which of its numbers have a name.
_TOLD = "block long, local array<int>, ids array<long>"
_WORDS_COUNTED = f"id long, lang string, word string, n long, total long, {_TOLD}"
_PAIRS_COUNTED = f"id long, left long, right long, n long, {_TOLD}"


def _texts(words: list[bytes]) -> bytes:
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _of_texts(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def _words(most: int, parts: int):
    """(lang, text) to blocks of about ``most`` places: numbers of words with 0 at every end of a piece, and what each means."""

    def begin() -> tuple[array, defaultdict]:
        numbers = count(1)
        return array("i"), defaultdict(lambda: _Names(numbers))

    def end(block: int, places: array, names: defaultdict) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(places, np.int32)
        ids = ids[ids >= 0]
        yield _table(_OF_WORDS, block=[block], size=[len(ids)], data=[_packed(ids)])
        langs = list(names)
        seeds = [crc32(lang.encode()) for lang in langs]
        said = sorted((number, i, word) for i, lang in enumerate(langs) for word, number in names[lang].items() if number > 0)
        n = np.bincount(ids, minlength=len(said) + 1)
        key = np.array([crc32(word, seeds[i]) % parts * len(langs) + i for _, i, word in said], np.int64)
        order = np.argsort(key, kind="stable")
        for s in _runs(key[order]):
            local = order[s] + 1
            part, i = divmod(int(key[order[s.start]]), len(langs))
            yield _table(_OF_WORDS, block=[block], size=[len(local)], data=[_packed(np.diff(local, prepend=0), n[local])], part=[part], lang=[langs[i]], words=[_texts([said[x][2] for x in order[s]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, (places, names) = TaskContext.get().partitionId() << 32, begin()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.lower().translate(_AS).replace(b"\n", b" \n ").split(b" ")
                places.extend(map(names[lang].__getitem__, words))
                places.append(0)
                if len(places) >= most:
                    yield from end(block, places, names)
                    block, (places, names) = block + 1, begin()
        if places:
            yield from end(block, places, names)

    return run


def _runs(keys: np.ndarray) -> list[slice]:
    """Slices of equal neighbours."""
    if not len(keys):
        return []
    at = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist()
    return [slice(a, b) for a, b in zip(at, at[1:])]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Runs of rows with an equal first column; a row's other columns as Arrow values."""
    key, rows = None, []
    for batch in batches:
        for i, own in enumerate(batch.column(0).to_pylist()):
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append([c[i] for c in batch.columns[1:]])
    if rows:
        yield key, rows


def _pairs(parts: int):
    """Sorted (block, data, local, ids) to the next level's blocks: places whose number has no name become 0, two
    neighbours that have one make a pair. Pairs are numbered part by part, so that a part's numbers follow its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches):
            data = [r[0].as_py() for r in rows if r[0].is_valid]
            told = [r for r in rows if r[1].is_valid]
            if not data or not told:
                continue
            local, name = (np.concatenate([r[c].values.to_numpy() for r in told]).astype(np.int64) for c in (1, 2))
            ids = _unpacked(data[0], 1)[0]
            number = np.zeros(max(int(ids.max()), int(local.max())) + 1, np.int64)
            number[local] = np.arange(1, len(local) + 1)
            at = number[ids]
            both = (at[:-1] > 0) & (at[1:] > 0)
            keys, pair, n = np.unique(at[:-1][both] << 32 | at[1:][both], return_inverse=True, return_counts=True)
            if not len(keys):
                continue
            left, right = name[(keys >> 32) - 1], name[(keys & 0xFFFFFFFF) - 1]
            part = ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % parts
            order = np.lexsort((right, left, part))
            place_of = np.empty(len(order), np.int64)
            place_of[order] = np.arange(1, len(order) + 1)
            places = np.zeros(len(both) + 1, np.int64)
            places[:-1][both] = place_of[pair]
            keep = places > 0
            keep[1:] |= keep[:-1]  # one 0 behind each run
            yield _table(_OF_PAIRS, block=[block], size=[int(keep.sum())], data=[_packed(places[keep])])
            left, right, part, n = left[order], right[order], part[order], n[order]
            spans = _runs(part)
            yield _table(_OF_PAIRS, block=[block] * len(spans), part=[part[s.start] for s in spans], start=[s.start + 1 for s in spans], size=[s.stop - s.start for s in spans], data=[_packed(np.diff(left[s], prepend=0), right[s], n[s]) for s in spans])

    return run


def _told(schema: str, blocks: list[int], locals_: list[np.ndarray], own: np.ndarray) -> pa.RecordBatch:
    """For each block the numbers that have a name; ``own``: names (-1: none) of all blocks' entries in turn."""
    found, at = [], 0
    for block, local in zip(blocks, locals_):
        mine = own[at : at + len(local)]
        at += len(local)
        if len(hit := np.flatnonzero(mine >= 0)):
            found.append((block, local[hit], mine[hit]))
    return _table(schema, block=[x[0] for x in found], local=[x[1] for x in found], ids=[x[2] for x in found])


def _words_counted(parts: int, least: int):
    """Sorted (part, lang, block, data, words) to the names of the frequent words, the blocks' numbers that have one, and
    how many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            given = 0
            langs = [r[0].as_py() for r in rows]
            for s in _runs(np.unique(langs, return_inverse=True)[1]):
                own = rows[s]
                columns = [_unpacked(r[2].as_py(), 2) for r in own]
                every = pa.chunked_array([pa.array(_of_texts(r[3].as_py()), pa.binary()) for r in own]).combine_chunks().dictionary_encode()
                at, n = every.indices.to_numpy().astype(np.int64), np.concatenate([c[1] for c in columns])
                total = np.bincount(at, weights=n).astype(np.int64)  # exact below 2 ** 53
                often = total >= least
                ids = np.where(often, (given + np.cumsum(often) - 1) * parts + part, -1)
                given += int(often.sum())
                words = every.dictionary.filter(pa.array(often)).cast(pa.string())
                yield _table(_WORDS_COUNTED, lang=[langs[s.start]], total=[int(n.sum())])
                if len(words):
                    yield _table(_WORDS_COUNTED, id=ids[often], lang=[langs[s.start]] * len(words), word=words, n=total[often])
                    yield _told(_WORDS_COUNTED, [r[1].as_py() for r in own], [np.cumsum(c[0]) for c in columns], ids[at])

    return run


def _pairs_counted(parts: int, least: int):
    """Sorted (part, block, start, data) to the names of the frequent pairs and the blocks' numbers that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            columns = [_unpacked(r[2].as_py(), 3) for r in rows]
            left, right, n = (np.concatenate([np.cumsum(c[i]) if i == 0 else c[i] for c in columns]) for i in range(3))
            lefts, l = np.unique(left, return_inverse=True)  # noqa: E741
            rights, r = np.unique(right, return_inverse=True)
            keys, pair = np.unique(l << 32 | r, return_inverse=True)
            total = np.bincount(pair, weights=n).astype(np.int64)  # exact below 2 ** 53
            often = total >= least
            if not often.any():
                continue
            ids = np.where(often, (np.cumsum(often) - 1) * parts + part, -1)
            yield _table(_PAIRS_COUNTED, id=ids[often], left=lefts[keys[often] >> 32], right=rights[keys[often] & 0xFFFFFFFF], n=total[often])
            yield _told(_PAIRS_COUNTED, [r[0].as_py() for r in rows], [r[1].as_py() + np.arange(len(c[0])) for r, c in zip(rows, columns)], ids[pair])

    return run


class _Tables:
    """Parquet tables in the shared folder, removed when they are read no more."""

    def __init__(self, spark) -> None:
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = temporary(self.spark, shared_dir(self.spark))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, self.paths.pop(name))


def _words_named(words: DataFrame) -> DataFrame:
    """The frequent words, as phrases of one word: id, lang, phrase, last word, n, and the frequencies of the beginnings
    (``starts``) and ends (``ends``) by number of words, themselves included."""
    own = F.array("n")
    return words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", own.alias("starts"), own.alias("ends"))


def _pairs_named(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """The same of pairs, with ``left`` and ``right``, from those of one word less."""
    first = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "starts")
    rest = below.select(F.col("id").alias("right"), "last", "ends")
    own = F.array("n")
    return pairs.join(first, "left").join(rest, "right").select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n", F.concat("starts", own).alias("starts"), F.concat("ends", own).alias("ends"))


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = WORDS, places: int = PLACES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words and the number of words of each language.

    A block's words and pairs go out in parts of a hash, packed; a part counts its own over all blocks, names the frequent
    ones and tells each block. How many parts there are follows the bytes, then the places, so a part stays small.
    """
    tables = _Tables(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole(text_col).alias("text"))
    parts = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_OF_PART
    blocks = tables.write("blocks1", texts.mapInArrow(_words(places, parts), _OF_WORDS))
    entries = blocks.where("part is not null").select("part", "lang", "block", "data", "words")
    counted = tables.write("counts1", entries.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(_words_counted(parts, least), _WORDS_COUNTED))
    totals = counted.where("total is not null").groupBy("lang").agg(F.sum("total").alias("total"))
    out = [tables.write("names1", _words_named(counted.where("id is not null")))]
    for k in range(2, most_words + 1):
        held = blocks.where("part is null")
        size = held.agg(F.sum("size")).first()[0] or 0
        parts = 1 + size // IN_PART
        none = [F.lit(None).cast("array<int>").alias("local"), F.lit(None).cast("array<bigint>").alias("ids")]
        told = counted.where("block is not null").select("block", F.lit(None).cast("binary").alias("data"), "local", "ids")
        both = held.select("block", "data", *none).unionByName(told).repartition(1 + size // (2 * PLACES), "block")
        blocks = tables.write(f"blocks{k}", both.sortWithinPartitions("block").mapInArrow(_pairs(parts), _OF_PAIRS))
        tables.drop(f"blocks{k - 1}")
        tables.drop(f"counts{k - 1}") if k > 2 else None
        fragments = blocks.where("part is not null").select("part", "block", "start", "data")
        counted = tables.write(f"counts{k}", fragments.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_pairs_counted(parts, least), _PAIRS_COUNTED))
        out.append(tables.write(f"names{k}", _pairs_named(counted.where("id is not null").select("id", "left", "right", "n"), out[-1])))
    tables.drop(f"blocks{most_words}")
    return out, totals


def _floor(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in decimals of 38 digits: exact for up to 10**17 words."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(n)) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = WORDS, top: int | None = TOP, share: int = SHARE, places: int = PLACES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of 2 words or more that occur ``least`` times.

    The score is that of the lowest-scoring cut, of equal ones the first. A phrase goes if a longer one that holds it has
    ``share`` percent of its occurrences; as frequencies fall with length, one word more tells. Ranks go by score, then a
    (both falling), then phrase, whose bytes differ within a language.
    """
    names, totals = levels(docs, text_col, lang_col, least, most_words, places)
    kept = None
    for k in range(2, most_words + 1):
        rows = names[k - 1]
        cuts = F.array(*[F.struct(_floor(F.col("n"), F.col("total"), F.col("starts")[j - 1], F.col("ends")[k - j - 1]).alias("score"), F.lit(j).alias("cut"), F.col("starts")[j - 1].alias("l"), F.col("ends")[k - j - 1].alias("r")) for j in range(1, k)])
        if k < most_words:
            longer = names[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, "id", "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < share * F.col("n")))
        rows = rows.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), F.array_min(cuts).alias("cut"))
        kept = rows if kept is None else kept.unionByName(rows)
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
