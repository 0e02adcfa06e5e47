import hashlib
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup, simhash
from loomspan.llm.common import lower_ascii, sieved
from loomspan.llm.components import components

from . import cases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_groups(rows, keep):
    by = {}
    for r in rows:
        by.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    return sorted((r[0], keep(by[t]), len(by[t]), r[0] == keep(by[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r[1] or "").translate(LOWER)])


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_groups(spark, keep, best):
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(cases.frame(spark), keep=keep).collect())
    assert got == brute_groups(cases.documents(), best)


def test_a_hash_collision_makes_two_groups(spark):
    got = exact_dedup.exact_groups(cases.frame(spark), keep="largest", hash_of=lambda c: F.repeat(F.lit("00"), F.lit(16)))
    assert sorted(tuple(r) for r in got.collect()) == brute_groups(cases.documents(), max)


def test_empty_table(spark):
    empty = cases.frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_dropping_keeps_one_of_each_text(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in cases.documents()})
    assert all(r["doc_id"] == min(d[0] for d in cases.documents() if (d[1] or "").translate(LOWER) == (r["text"] or "").translate(LOWER)) for r in kept.collect())


def test_lower_ascii_changes_only_a_to_z(spark):
    texts = ["ÀÉ AZ", "İI", "ΑΣ ΣΑΣ", "ǅ Ⅷ Ⓐ", "ſ K Å", "plain é", "Ünder DOG", "𐐀A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lower_ascii(F.col("t"))).collect()] == [t.translate(LOWER) for t in texts]


def slow_fingerprint(text):
    words = text.translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c xY ", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def brute_components(ids, fps):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= 2:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def test_near_duplicates_of_odd_documents(spark):
    rows = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(cases.frame(spark)).collect()}
    prints = {r[0]: slow_fingerprint(r[1] or "") for r in cases.documents()}
    expected = brute_components(list(prints), list(prints.values()))
    assert rows == {(i, f"{p:016x}", expected[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(cases.frame(spark)).count() == len(cases.documents())


def test_covering_masks_miss_no_pair():
    masks = [m & (1 << 64) - 1 for m in simhash._masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("dense", [False, True])
def test_links_reach_what_all_pairs_reach(spark, dense):
    """Clusters of many fingerprints, some beyond SMALL in a bucket, so that both ways are taken."""
    r = np.random.default_rng(3)
    fps = set()
    for _ in range(4 if dense else 40):
        centre = int(r.integers(0, 1 << 63))
        for _ in range(150 if dense else 4):
            x = centre
            for b in r.integers(0, 64, int(r.integers(0, 5))):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in r.integers(0, 1 << 63, 50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = simhash.links(nodes)
    got = {x: x for x in signed} | {r["node"]: r["root"] for r in components(pairs).collect()}
    want = brute_components(signed, [x & (1 << 64) - 1 for x in signed])
    assert got == want
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs.collect())


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (301, 302), (302, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {301: 301, 302: 301}


def test_keep_one_of_each_group(spark):
    docs = cases.frame(spark)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(groups.values())


def test_dropping_keeps_columns_of_any_name(spark):
    rows = [(1, "Same", "a", "b", "c", 1), (2, "same", "d", "e", "f", 2), (3, "other", "g", "h", "i", 3), (3, "other", "g", "h", "i", 3), (None, "none", "j", "k", "l", 4), (None, None, "m", "n", "o", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string, __id string, h string, `a.b` int")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, {rows[0], rows[2], rows[4], rows[5]}))


def test_a_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 3000).select((F.xxhash64("id")).alias("k"))
    rows = sieved(spark.range(-9000, 9000), F.xxhash64("id"), keys, 3000)
    hits = {r["id"] for r in rows.where("hit").collect()}
    assert rows.columns == ["id", "hit"] and rows.count() == 18000
    assert set(range(3000)) <= hits and len(hits) < 3000 + 15000 / 4
    assert sieved(spark.range(10), F.xxhash64("id"), keys.limit(0), 0).where("hit").count() == 0


def test_keep_one_loses_no_text(spark):
    """Ids that repeat with other texts, and columns that could clash."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a, "p", 1), (7, a, "q", 2), (7, b, "r", 3), (7, b, "r", 3), (None, b, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, keeper int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, a, "p", 1), (7, b, "r", 3)]


def test_wide_masks_cover_and_select():
    masks = [m % (1 << 64) for m in simhash._wide_masks()]
    assert len(set(masks)) == 127 and Counter(m.bit_count() for m in masks) == {32: 126, 64: 1}
    r = np.random.default_rng(1)
    for _ in range(3000):
        flipped = sum(1 << int(b) for b in r.choice(64, 6, replace=False))
        assert any(not m & flipped for m in masks)


@pytest.mark.parametrize("part", [3, 1024])
def test_wide_links_connect_what_six_bits_do(spark, monkeypatch, part):
    """Chains, dense families and single fingerprints, against all pairs."""
    monkeypatch.setattr(simhash, "PART", part)
    r = np.random.default_rng(part)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in r.choice(64, n, replace=False))
    fps = [int(x) for x in r.integers(0, 1 << 63, 60)]
    for _ in range(12):
        x = int(r.integers(0, 1 << 63))
        for _ in range(9):  # a chain of steps that are at times too long
            fps.append(x)
            x = flip(x, int(r.integers(4, 9)))
    center = int(r.integers(0, 1 << 63))
    fps += [flip(center, int(r.integers(0, 5))) for _ in range(150)]
    fps = sorted(set(fps))
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 6
    label = np.arange(len(a))
    while (new := np.where(near, label[None, :], len(a)).min(axis=1)).tolist() != label.tolist():
        label = new
    signed = a.view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long").repartition(3)
    links = simhash.wide_links(nodes)
    assert all((int(p["a"]) % (1 << 64) ^ int(p["b"]) % (1 << 64)) for p in links.collect())
    root = {x["node"]: x["root"] for x in components(links).collect()}
    groups = {}
    for x, of in zip(signed.tolist(), label.tolist()):
        groups.setdefault(of, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_edited_copies_go_and_others_stay(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(r.choice(words, 400)) for _ in range(60)]
    edited = []
    for t in texts[:30]:
        w = t.split()
        w[int(r.integers(0, 400))] = "changed"
        edited.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts + edited)) + [(900, None), (901, "")], "doc_id long, text string").withColumn("fp", F.lit(1))
    kept = {x["doc_id"] for x in simhash.keep_one(docs, wide=True).collect()}
    assert set(range(60)) <= kept and len(kept & set(range(60, 90))) <= 3 and len(kept & {900, 901}) == 1
