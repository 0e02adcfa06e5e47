"""Packs documents into sequences of a fixed length: Martello-Toth reduction, then best fit.

What the packing needs to know of the documents is how many pieces have each length, CAPACITY numbers at most, however
large the corpus. So the whole packing is planned on the driver over that histogram, for all pieces at once, and the
plan says for the r-th piece of a length in which sequence it lies and where. The reduction fixes sets of up to three
pieces that provably dominate all others of a length (Martello and Toth, 1990); best fit takes the rest by falling
length. Both treat all pieces of a length together, so the plan's size depends on CAPACITY alone.

Defined cases: a null text counts as empty and is one piece of one id (the end, 0); a document of repeated rows is
packed as often as it occurs; a text of any length is encoded whole and cut into pieces; pieces of equal length go in the
order of id and piece; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import ChainMap
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole, written

CAPACITY = 2048
_CACHED, _AT_ONCE, GROUP = 500_000, 500, 32
# How the tokenizer that may be asked word by word lower-cases and splits.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
}

#: Some bins of equal content: how many, and the (length, how many of it) in them.
Bins = tuple[int, tuple[tuple[int, int], ...]]


@cache
def _loaded(path: str) -> tuple[object, np.ndarray | None]:
    """The tokenizer, and if it is as in WORDWISE which ids end a run of letters."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    tokenizer, steps, ending = Tokenizer.from_file(path), (said["pre_tokenizer"] or {}).get("pretokenizers", [{}]), said["model"].get("end_of_word_suffix")
    if said["normalizer"] != WORDWISE["normalizer"] or steps[0] != WORDWISE["split"] or said["post_processor"] is not None or not ending:
        return tokenizer, None
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith(ending)]] = True
    return tokenizer, last


class Encoder:
    """Ids of UTF-8 texts as little-endian 32-bit numbers, without special tokens.

    A tokenizer as in WORDWISE lower-cases and never joins what white space parts, nor a comma or stop with a letter or
    digit before it, so the ids of a text are those of its words; the first _CACHED words that an encoder meets are
    kept. Where a text may hold a special token's name, its case stays, since those names are told apart by case. Any
    other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.last = _loaded(path)
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _of_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, asked for GROUP at a time and parted behind each id that ends a run of letters.

        Every word has one such id or more, so that as many as there are words means one each; else they go one by one.
        """
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for group, data in zip(groups, self._encoded([b" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[np.frombuffer(data, "<u4")])
            if len(ends) == len(group):
                at = [0, *(4 * ends + 4).tolist()]
                out += [data[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self._encoded(group)
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.last is None:
            return self._encoded(texts)
        known = self.known
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = set().union(*split).difference(known)
        stem = {w: w[:-1] for w in new if w[-1] in b",." and w[-2:-1].isalnum()}
        missing = list({stem.get(w, w) for w in new}.union(w[-1:] for w in stem).difference(known))
        letters = [w for w in missing if w.isalpha() or w.decode("utf-8").isalpha()]
        found = dict(zip(letters, self._of_letters(letters)))
        others = [w for w in missing if w not in found]
        found.update(zip(others, self._encoded(others)))
        look = ChainMap(found, known)
        found |= {w: look[s] + look[w[-1:]] for w, s in stem.items()}
        if len(known) + len(found) <= _CACHED:
            known.update(found)
            look = known
        else:
            for words in split:
                found.update((w, known[w]) for w in words if w not in found)
            look = found
        return [b"".join(map(look.__getitem__, words)) for words in split]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and if asked for ids) for each piece; only longer documents are cut."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is kept of words lives as long as the task, and then goes back to the system, not just to Python."""
        encode = Encoder(tokenizer)
        yield from cut(batches, encode)
        encode.known.clear()
        with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    def cut(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[pa.RecordBatch]:
        for batch in (large.slice(at, _AT_ONCE) for large in batches for at in range(0, large.num_rows, _AT_ONCE)):
            rows, ids = [], []
            for at, tokens in enumerate(encode(batch.column(1).cast(pa.binary()).to_pylist())):
                tokens += b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[start : start + 4 * capacity]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part)
            at, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * with_ids)
    names = schema.names
    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Bins that some optimal packing has, and what is left to pack.

    For a piece of length l, with room = capacity - l, a bin of l and k dominates all other bins with l if k fills the
    room, or no two pieces fit into it and k is the largest that does, or no three fit and k is as large as any two.
    """
    left, fixed = dict(counts), []
    lengths = sorted(left)

    def smallest(n: int, but: int) -> list[int]:
        out: list[int] = []
        for x in lengths:
            out += [x] * min(n, left.get(x, 0) - (x == but))
            if len(out) >= n:
                break
        return out[:n]

    def largest(room: int, but: int) -> int:
        i = bisect_left(lengths, room + 1) - 1
        while i >= 0 and left.get(lengths[i], 0) - (lengths[i] == but) <= 0:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def largest_two(room: int, but: int) -> int:
        best, i = 0, 0
        have = [x for x in lengths if left.get(x, 0) - (x == but) > 0]
        j = len(have) - 1
        while i <= j:
            if have[i] + have[j] > room:
                j -= 1
            elif i == j and left[have[i]] - (have[i] == but) < 2:
                break
            else:
                best, i = max(best, have[i] + have[j]), i + 1
        return best

    for l in reversed(lengths):  # noqa: E741
        while left.get(l, 0) > 0:
            room = capacity - l
            k = largest(room, l)
            few = smallest(3, l)
            if k == 0:
                fixed.append((left.pop(l), ((l, 1),)))
                break
            if not (k == room or len(few) < 2 or few[0] + few[1] > room or ((len(few) < 3 or sum(few) > room) and k >= largest_two(room, l))):
                break
            n = left[l] // 2 if k == l else min(left[l], left[k])
            fixed.append((n, ((l, 2),) if k == l else ((l, 1), (k, 1))))
            left[l] -= n
            left[k] -= n
    return fixed, {x: n for x, n in left.items() if n > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit by falling length; a bin stays the best for a length until that no longer fits, so it takes j at once."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(n: int, room: int, content: tuple[tuple[int, int], ...]) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((n, content))

    for l in sorted(counts, reverse=True):  # noqa: E741
        n = counts[l]
        while n:
            i = bisect_left(rooms, l)
            if i < len(rooms):
                room = rooms[i]
                have, content = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            else:
                room, have, content = capacity, n, ()
            j = room // l
            full = min(have, n // j)
            rest = min(n - full * j, j) if full < have else 0
            put(full, room - j * l, (*content, (l, j)))
            if rest:
                put(1, room - rest * l, (*content, (l, rest)))
            if content:
                put(have - full - (rest > 0), room, content)
            n -= full * j + rest
    return [x for groups in by_room.values() for x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in a sequence, offset), sorted by length and first rank."""
    fixed, left = reduced(counts, capacity)
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for n, content in fixed + best_fit(left, capacity):
        offset = 0
        for length, k in content:
            rows.append((length, rank[length], sequence, k, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    assert rank == counts
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    The rank of a piece among those of its length comes from its rank in a salted part of the length and the sizes of
    the parts before, so one length that very many documents share is dealt over many tasks.
    """
    cut = written(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = plan(counts, capacity)
    parts = max(64, sum(counts.values()) // 500_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece"))).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("salt", "before")
    wide = np.int64(1) << 40  # pieces of a length are fewer; CAPACITY is far below 2 ** 23
    keys = table[:, 0] * wide + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1] if len(rank) else table[:0]
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 3]) if len(rank) else (rank, rank)
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names[:-2]}
            columns |= {"sequence_id": pa.array(row[:, 2] + bin_), "offset": pa.array(row[:, 4] + slot * length)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
