import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomspan.llm.conversation_trie import prefix_trie, sequences, spliced

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, n long, uid int"


def own_turns(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
            turns[c].append(((turn is not None, turn or 0, digest), (r, t)))
    return {c: [x[1] for x in sorted(t, key=lambda x: x[0])] for c, t in turns.items()}


def brute(turns, splice=True):
    """Every prefix of every rebuilt conversation, with its members; sums over all nodes below."""
    convs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if splice else 0
        b = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        convs[c] = tuple(turns.get(b, [])[:h] + own[h:]) if splice else tuple(own)
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children, out = defaultdict(int), []
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def made(seed, n):
    r = random.Random(seed)
    rows, texts = [], ["", None, "a", "b", "ü", "long " * 300]
    for c in r.sample(range(-20, 3 * n), n):
        length = r.choice([0, 1, 2, 3, 5, 9, 12, 60]) if r.random() < 0.9 else 4
        few = r.choice([1, 2, 4, 6])
        rows += [(c, r.choice([t, t, t, t, None, t // 2]), r.choice(["user", "user", None, "assistant"]), r.choice(texts[:few])) for t in range(length)]
    copies = [(5 * k + 1000, t, "user", f"same {t}") for k in range(40) for t in range(7)]
    out = rows + copies + rows[:3] + [(None, 1, "user", "of none"), (None, None, None, None)]
    r.shuffle(out)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(parts)


def nodes(spark, rows, **more):
    turns = sequences(frame(spark, rows), group=5)
    return sorted(str(tuple(r)) for r in prefix_trie(spliced(turns)).collect())


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 200), (3, 7)])
def test_nodes_by_brute_force(spark, seed, n):
    rows = made(seed, n)
    assert nodes(spark, rows) == brute(own_turns(rows))


@pytest.mark.parametrize("parts", ["1", "2", "40"])
def test_runs_over_many_blocks(spark, parts):
    """The block edges fall anywhere: within copies, within a long shared prefix, between unlike conversations."""
    r = random.Random(int(parts))
    rows = []
    for c in range(300):
        said = r.choice(["a" * r.randint(1, 9), "abcabc" + r.choice("xyz") * r.randint(0, 3), "".join(r.choice("ab") for _ in range(r.randint(1, 8))), f"{c}"])
        rows += [(c, t, "user", x) for t, x in enumerate(said)]
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plain = prefix_trie(sequences(frame(spark, rows)).select("conv_id", "steps"))
        assert sorted(str(tuple(x)) for x in plain.collect()) == brute(own_turns(rows), splice=False)
        assert nodes(spark, rows) == brute(own_turns(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_tables(spark):
    assert nodes(spark, []) == [] == nodes(spark, [(None, 1, "user", "x")])
    one = [(7, 1, "user", "x")]
    assert nodes(spark, one) == brute(own_turns(one))
    turnless = [(1, 1, "user", "x"), (6, 1, "user", "x")]  # ids 1 and 6 keep nothing: their bases are absent
    assert nodes(spark, turnless) == brute(own_turns(turnless))


def test_ids_of_large_groups_are_joined_in_parts(spark, monkeypatch):
    rows = [(c, 1, "user", "same") for c in range(0, 30000, 5)]
    got = prefix_trie(sequences(frame(spark, rows)).select("conv_id", "steps")).collect()
    ends = hashlib.sha256(",".join(str(c) for c in range(0, 30000, 5)).encode()).hexdigest()
    assert {(r["depth"], r["n_convs"], r["saved_tokens"]): r["ends_sha256"] for r in got} == {(0, 6000, 5999 * 4): hashlib.sha256(b"").hexdigest(), (1, 6000, 5999 * 4): ends}
