import random
import re
from collections import Counter, defaultdict

import pytest

from loomspan.llm import phrases
from loomspan.llm.phrases import collocations

from . import cases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, most, top, share):
    """Straight from the definition: every phrase of every piece, every cut, every longer candidate."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, every in f.items():
        often = {p: a for p, a in every.items() if a >= least and len(p) > 1}
        found = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023,E731
            if any(len(q) > len(p) and inside(q) and 100 * b >= share * a for q, b in often.items()):
                continue
            cuts = [(1000 * a * n[lang] // (every[p[:k]] * every[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), every[p[:k]], every[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=150):
    r = random.Random(seed)
    words = ["a", "b", "c", "d", "E", "É", "ab", "x-y", "w\x00", "日本", " ", "z" * 3000]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "; ", "?!", ":"]
    said = lambda: "".join(r.choice(words[: r.choice((3, 5, 12))]) + r.choices(marks, [40, 3, 2] + [1] * 9)[0] for _ in range(r.randint(0, 40)))
    return [(said() if r.random() > 0.03 else None, r.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("seed,least,most,top,share,places", [(1, 3, 5, 2000, 100, 1 << 21), (2, 5, 4, 7, 60, 1), (3, 2, 6, 2000, 35, 100), (4, 40, 5, 2000, 100, 300), (5, 4, 2, 2000, 100, 1)])
def test_phrases_by_brute_force(spark, seed, least, most, top, share, places):
    rows = texts(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(map(tuple, collocations(df, least=least, most_words=most, top=top, share=share, places=places).collect()))
    assert got == brute(rows, least, most, top, share) and (got or least == 40)


def test_odd_documents(spark):
    rows = [(r[1], r[2]) for r in cases.documents()]
    got = sorted(map(tuple, collocations(cases.frame(spark), least=5).collect()))
    assert got == brute(rows, 5, 5, 2000, 100) and got
    assert collocations(cases.frame(spark, [])).count() == 0
    assert collocations(cases.frame(spark), least=10**6).count() == 0  # no word is frequent


def test_products_beyond_64_bits_are_exact(spark):
    a, n, left, right = 9 * 10**9 + 7, 10**13 + 1, 10**10 + 3, 9 * 10**9 + 11
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(phrases._floor(*[phrases.F.col(c) for c in "anlr"]).alias("x")).collect()[0]
    assert row["x"] == 1000 * a * n // (left * right)
