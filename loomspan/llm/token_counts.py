"""Exact token counts at every prefix of a text, by dynamic programming over its characters.

A byte-pair encoding is told by its neighbours: tokens make up the encoding of a text exactly when each two adjacent
ones, encoded alone, stay two. So every prefix has exactly one last token that can stand behind the encoding of what is
before it, and its count is one more than that of the shorter prefix: one pass over a text gives the counts of all of
its prefixes, without encoding any of them. Truncation and budget questions then read the stored counts.

No piece reaches over the place where a space follows another character, or where letters end, so a text falls into
segments whose counts add up; an executor's worker keeps the counts of segments it has met.

Defined cases: a null text counts as empty, which has no tokens; a text of any length is counted whole; repeated rows
and null ids are rows like any other; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

LIMIT = 4096
#: What a worker keeps: segments, characters of them, pairs of tokens. Beyond that it begins anew; counts stay the same.
_SEGMENTS, _CHARS, _PAIRS = 300_000, 6_000_000, 1_000_000
_AT_ONCE = 1 << 20  # characters of the texts that are counted together
SPACE = "▁"  # fixed value: what the model writes for a space


class PrefixCounter:
    """Counts of a sentencepiece BPE model that falls back to bytes and changes nothing of a text but its spaces."""

    def __init__(self, path: str) -> None:
        from ahocorasick import Automaton
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, kind = model.normalizer_spec, model.trainer_spec
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        odd = any(p.type in (4, 5) for p in model.pieces)  # pieces of the user's, pieces out of use
        if kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix or odd or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("prefix counts need a BPE model with byte fallback, a space put before the text, and no other change of it")
        if any(SPACE in p[1:].lstrip(SPACE) or (p[0] != SPACE and SPACE in p) for p in self.score):
            raise ValueError("a piece reaches over a space")
        self.segment = self._segments()
        self.width, self.pairs = len(self.score), {}
        self.pieces, self.steps = Automaton(), []
        for piece in self.score:  # only one that encodes to itself can be a token
            parts, steps = self._joined(piece)
            if len(parts) == 1:
                self.pieces.add_word(piece, (len(self.steps), len(piece)))
                self.steps.append(((*steps, (None, piece, piece)), piece[0], piece[-1]))
        self.pieces.make_automaton()
        self.forget()

    def _segments(self) -> re.Pattern:
        """Spaces and a run of letters; or of other characters, up to the next space or end of a line; no piece reaches
        from one such segment into the next. Letters that a piece joins to what is none count as others."""
        joined = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        others: set[str] = set()
        while more := {a for a, b in joined if b not in others and a.isalnum() and not b.isalnum() and a not in others} | {a for a, b in joined if b in others and a.isalnum() and a not in others}:
            others |= more
        line = "\n" if not any("\n" in p for p in self.score) else ""
        letter = "".join(map(re.escape, sorted(c for c in set("".join(self.score)) if c.isalnum() and c not in others)))
        return re.compile(f"{SPACE}*[{letter}]+|{SPACE}*[^{SPACE}{line}]+" + (f"|{SPACE}+|{line}" if line else f"|{SPACE}+"))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = array("i")
        self.starts, self.lengths, self.totals = array("q"), array("q"), array("q")

    def _joined(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """A short text's encoding by its definition (the best pair is joined, the leftmost of equal ones, until none is
        left), and for each join its score and the first and last part behind it."""
        parts, steps = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether two tokens stay two: both are joined up side by side, and no pair across them ever comes first."""
        (of_a, _, end), (of_b, begin, _) = self.steps[a], self.steps[b]
        i = j = 0
        score, low = self.score.get, float("-inf")
        while True:
            left, right = of_a[i][0], of_b[j][0]
            if (across := score(end + begin)) is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is None and right is None:
                return True
            if (low if left is None else left) >= (low if right is None else right):
                end = of_a[i][2]
                i += 1
            else:
                begin = of_b[j][1]
                j += 1

    def counts(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment (whose spaces are SPACE), from one character on.

        ``last`` has each prefix's last token: -1 for none or a character outside the pieces, which nothing joins, and -2
        for prefixes that no piece seen so far ends.
        """
        n, pairs, width = len(segment), self.pairs, self.width
        last, out, at = [-2] * (n + 1), [0] * (n + 1), 0
        last[0] = -1
        for end, (token, length) in self.pieces.iter(segment):
            end += 1
            if last[end] != -2:
                continue
            while at < end - 1:  # characters that are no piece
                at += 1
                if last[at] == -2:
                    last[at], out[at] = -1, out[at - 1] + len(segment[at - 1].encode("utf-8"))
            start = end - length
            before = last[start]
            if before >= 0:
                key = before * width + token
                if (stay := pairs.get(key)) is None:
                    if len(pairs) >= _PAIRS:
                        pairs.clear()
                    stay = pairs[key] = self._adjacent(before, token)
                if not stay:
                    continue
            last[end], out[end] = token, out[start] + 1
        while at < n:
            at += 1
            if last[at] == -2:
                last[at], out[at] = -1, out[at - 1] + len(segment[at - 1].encode("utf-8"))
        return out[1:]

    def _learn(self, segment: str) -> int:
        counts = self.counts(segment)
        self.starts.append(len(self.flat))
        self.lengths.append(len(counts))
        self.totals.append(counts[-1])
        self.flat.extend(counts)
        self.known[segment] = out = len(self.known)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes (one character and more) of all texts, one after another, and where each text's begin."""
        if len(self.known) > _SEGMENTS or len(self.flat) > _CHARS:
            self.forget()
        known, ids, many = self.known, array("q"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                segments = self.segment.findall(SPACE + text.replace(" ", SPACE))
                many[i] = len(segments)
                ids.extend([known[s] if s in known else self._learn(s) for s in segments])
        at = np.frombuffer(ids, np.int64) if ids else np.zeros(0, np.int64)
        starts, lengths, totals = (np.frombuffer(x, np.int64)[at] if ids else at for x in (self.starts, self.lengths, self.totals))
        first = np.concatenate([[0], np.cumsum(many)])
        before, chars = np.concatenate([[0], np.cumsum(totals)]), np.concatenate([[0], np.cumsum(lengths)])
        base = before[:-1] - np.repeat(before[first[:-1]], many)
        flat = np.frombuffer(self.flat, np.int32) if ids else np.zeros(0, np.int32)
        counts = flat[np.arange(chars[-1]) + np.repeat(starts - chars[:-1], lengths)] + np.repeat(base, lengths)
        keep = np.ones(len(counts), bool)
        keep[chars[first[:-1][many > 0]]] = False  # the space before the text is no prefix of it
        return counts[keep], chars[first] - np.concatenate([[0], np.cumsum(many > 0)])


@cache
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_counts: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), fit_chars (characters of the longest
    prefix that has ``limit`` tokens at most), and if asked for ``counts``: the tokens of each prefix, from one
    character on, as ``tokens_of_prefix`` and ``longest_within`` read them."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "fit_chars")] + [T.StructField("counts", T.ArrayType(T.IntegerType(), False))] * with_counts)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of about _AT_ONCE characters; a longer text is one alone."""
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy())
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _AT_ONCE, side="right")))
                yield batch.slice(start, end - start)
                start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model)
        for batch in together(batches):
            counts, first = count(batch.column(1).to_pylist())
            chars = np.diff(first)
            tokens = np.where(chars > 0, np.append(counts, 0)[np.maximum(first[1:] - 1, 0)], 0)
            fit = chars.copy()
            for i in np.flatnonzero(tokens > limit):
                within = np.flatnonzero(counts[first[i] : first[i + 1]] <= limit)
                fit[i] = within[-1] + 1 if len(within) else 0
            columns = [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(fit, pa.int64())]
            if with_counts:
                columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(counts.astype(np.int32))).cast(pa.list_(pa.field("element", pa.int32(), False))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over, "fit_chars", *["counts"] * with_counts)


def tokens_of_prefix(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``chars`` characters, from stored counts; those of the whole text where it is shorter."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts)).cast("int")
    return F.when(at > 0, F.get(counts, at - 1)).otherwise(0).cast("long")


def longest_within(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix of ``budget`` tokens at most, from stored counts, which can fall as a text goes on."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    ends = F.filter(F.transform(counts, lambda n, i: F.when(n <= most, i + 1).otherwise(0)), lambda i: i > 0)
    return F.coalesce(F.array_max(ends), F.lit(0)).cast("long")
