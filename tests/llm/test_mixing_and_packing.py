import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import mixing, packing
from loomspan.llm.queries import tokenizer

from . import cases


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(3 * sizes[s])
        left = Fraction(sum(sizes.values())) - sum(out.values())
        open_ -= set(full)
    return out


def brute_sainte_lague(weights, seats):
    won = Counter()
    for _ in range(seats):
        won[max(weights, key=lambda k: (Fraction(weights[k]) / (2 * won[k] + 1), -k))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    r = random.Random(seed)
    parties = {(g, i): r.choice([0, 1, 2, 3, r.randint(1, 10**6)]) for g in range(3) for i in range(r.randint(1, 25))}
    seats = {0: 0, 1: r.randint(1, 30), 2: r.randint(100, 700)}
    df = spark.createDataFrame([(g, i, w, seats[g]) for (g, i), w in parties.items()], "g int, i int, w long, seats long")
    got = {(x["g"], x["i"]): x["quota"] for x in mixing.sainte_lague(df, ["g"], ["i"], "w", "seats").collect()}
    for g in range(3):
        weights = {i: w for (h, i), w in parties.items() if h == g}
        want = brute_sainte_lague(weights, seats[g]) if any(weights.values()) else Counter()
        assert {i: got[g, i] for i in weights} == {i: want[i] for i in weights}


def test_mixed_words(spark):
    rows = cases.documents(300)
    got = mixing.mixed_words(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = Counter()
    for r in rows:
        sources[r[3]] += size(r[1])
    targets = brute_targets(sources)
    by_id = {r[0]: r for r in rows}
    taken = Counter()
    for r in got:
        s = by_id[r["doc_id"]][3]
        assert r["size"] == size(by_id[r["doc_id"]][1]) and r["source_size"] == sources[s]
        assert r["target"] == pytest.approx(float(targets[s])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        assert abs(taken[s] - targets[s]) <= mixing.BLOCK
    again = mixing.mixed_words(cases.frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_small_source_is_capped_and_its_excess_reshared(spark):
    rows = [(i, "w " * 100, "big" if i < 95 else "a") for i in range(100)]
    got = {x["source"]: x["target"] for x in mixing._taken(spark.createDataFrame([(i, s, 100) for i, _, s in rows], "id long, source string, size long"), 7, 64).select("source", "target").distinct().collect()}
    assert got == {"a": 1500.0, "big": 8500.0}


@pytest.mark.parametrize("small", [[5] * 20, list(range(1, 64)), [1], [63, 40]])
def test_small_sources_are_not_lost(spark, small):
    """Each source's words come within a word, or a 64th of the smallest target, of its target; all in all they stay."""
    rows = [(i, "w " * n, "en", f"a{i:03}") for i, n in enumerate(small)] + [(1000 + i, "w " * 600, "en", "z") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed_words(df).collect()
    source = {r[0]: r[3] for r in rows}
    targets = brute_targets(Counter({s: sum(len(r[1]) // 2 for r in rows if r[3] == s) for s in source.values()}))
    taken = Counter()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    near = max(1, min(targets.values()) / 64)
    assert all(abs(taken[s] - t) <= near for s, t in targets.items()) and abs(sum(taken.values()) - sum(targets.values())) <= near


def test_the_mix_has_the_words_it_says(spark):
    docs = cases.frame(spark, cases.documents(200))
    said, mixed = mixing.mixed_words(docs).collect(), mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    original = {r[0]: (r[1] or "").split() for r in cases.documents(200)}
    for r in mixed.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert w and w == re.findall(r"[^\x20\x09-\x0D]+", next(d[1] for d in cases.documents(200) if d[0] == r["doc_id"]))[: len(w)]
        words[r["doc_id"]] += len(w)
    want = Counter()
    for r in said:
        want[r["doc_id"]] += r["taken"]
    assert +words == +want and original


def test_no_words_and_no_rows(spark):
    assert mixing.mixed_words(cases.frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, " ", None)]
    got = mixing.mixed_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def brute_pieces(text):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]
    return [(n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048)) for part in [ids[at : at + 2048]]]


TRICKY = ["Hello, WORLD. it's, don't. x, y. ,. ., ...", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "\x1c\x85 \u3000 \u00a0a\u0301 A\u0301, é. ß. İ, ﬁ.", "1,2. 3,4.5 , . a1. 1a,"]


def test_packing(spark):
    rows = cases.documents() + [(3000 + i, t, "en", "s", 0, 1, "", "", 1, 1) for i, t in enumerate(TRICKY)]
    got = packing.packed(cases.frame(spark, rows), tokenizer()).collect()
    want = Counter((r[0], *p) for r in rows for p in brute_pieces(r[1]))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_empty_packing(spark):
    assert packing.packed(cases.frame(spark, []), tokenizer()).count() == 0


def optimum(items, capacity):
    """The fewest bins, by branch and bound over small instances."""
    best = len(items)
    items = sorted(items, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= items[i]:
                rest = list(rooms)
                rest.remove(k)
                go(i + 1, [*rest, k - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_the_reduction_keeps_an_optimum(items):
    counts = dict(Counter(items))
    fixed, left = packing.reduced(counts, 20)
    used = Counter()
    for n, content in fixed:
        assert sum(x * k for x, k in content) <= 20
        for x, k in content:
            used[x] += n * k
    assert used + Counter(left) == Counter(counts)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_over_counts_is_best_fit(items):
    bins = packing.best_fit(dict(Counter(items)), 50)
    rooms = sorted(50 - sum(x * k for x, k in content) for n, content in bins for _ in range(n))
    assert rooms == plain_best_fit(items, 50)


def test_the_plan_does_not_grow_with_the_corpus():
    r = random.Random(1)
    lengths = [r.randint(1, 2048) for _ in range(20_000)]
    small, large = Counter(lengths), {k: v * 100_000 for k, v in Counter(lengths).items()}
    assert len(packing.plan(large)) < 3 * len(packing.plan(dict(small))) + 20_000


def test_other_tokenizers_get_whole_texts():
    """One that keeps case and white space isn't asked word by word; the ids are its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello,  World. ", "a\n\nb", "", "Ünder 12,000.5 <|endoftext|>"]
    for name, wordwise in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
        assert (encode.last is not None) == wordwise
        assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
