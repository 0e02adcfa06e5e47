"""Documents that a text operator has to stand: nulls, blanks, long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size string, h int, n int"


def documents(n=120, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéüß") for _ in range(r.randint(1, 7))) for _ in range(200)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "One", "One two", "one TWO", "É É É", "x" * 50_000, " ".join(r.choices(words, k=6000)), "a b c " * 400, "line\nline\n\nline\r\nother", "😀 𝄞 words beyond the plane 😀"]
    while len(texts) < n:
        t = " ".join(r.choices(words, k=r.randint(40, 160)))
        texts += [t, t.upper() if r.random() < 0.2 else t] if r.random() < 0.3 else [t]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", len(t or ""), 7, "x", "y", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[20], rows[20]]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
