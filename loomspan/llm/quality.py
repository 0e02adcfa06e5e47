"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both estimated on a sample; the cascade asks the rules in the order of
rejections per cost and stops at the first that rejects. The order decides how much is computed, never the verdict.

Defined cases: a null text has no words; an empty text fails the length rule; texts of any length are measured whole;
rules of equal worth keep their written order; repeated rows get equal verdicts; an empty table gives no rows (the rules
then keep their written order); further columns are left out by ``measured`` and kept by ``keep_good``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, whole, words, written


def n_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters of ``#*$%&|<>``."""
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Most texts have no such window: if all windows' hashes differ, so do the windows. For the others the windows
    themselves are sorted with their places; those with an equal neighbour are repeated, and place p covers up to three
    words, as many as lie before the next repeated place.
    """

    def places(win: Column) -> Column:
        return let(
            F.array_sort(F.transform(win, lambda k, p: F.struct(k.alias("k"), p.alias("p")))),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda e, j: (e["k"] == F.coalesce(F.get(s, j - 1)["k"], F.lit(""))) | (e["k"] == F.coalesce(F.get(s, j + 1)["k"], F.lit("")))), lambda e: e["p"])),
        )

    def covered(win: Column) -> Column:
        return let(places(win), lambda p: F.aggregate(F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    def windows(w: Column, of) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: of(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(w: Column) -> Column:
        exact = let(windows(w, lambda *x: F.concat_ws(" ", *x)), covered)
        none = let(windows(w, F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) < 4, F.lit(0)).when(none, F.lit(0)).otherwise(exact)

    return let(w, repeated).cast("long")


def upper_share(text: Column) -> Column:
    """Upper-case letters among the letters; 0 without letters."""
    upper, letters = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.try_divide(upper.cast("double"), letters), F.lit(0.0))


class Figures:
    """What rules ask for, from a text and its words, or as columns where they are known; made when asked."""

    def __init__(self, text: Column, w: Column, **known: Column) -> None:
        self.text, self.words, self.known = text, w, known

    def __getattr__(self, name: str) -> Column:
        made = {
            "n_words": lambda: n_words(self.words), "word_chars": lambda: word_chars(self.words), "n_symbols": lambda: n_symbols(self.text), "n_dup_lines": lambda: n_dup_lines(self.text),
            "n_repeat_words": lambda: n_repeat_words(self.words), "upper_share": lambda: upper_share(self.text), "n_lines": lambda: F.size(F.split(self.text, "\n", -1)),
        }
        if name not in made:
            raise AttributeError(name)
        return self.known[name] if name in self.known else made[name]()


@dataclass(frozen=True)
class Rule:
    """``rejects(figures)`` is true for a document that has to go."""

    name: str
    rejects: Callable[[Figures], Column]


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.1
    max_upper_share: float = 0.6
    max_dup_line_share: float = 0.7
    mean_word: tuple[float, float] = (1.5, 30.0)


def rules(x: Limits = Limits()) -> list[Rule]:
    return [
        Rule("too_short", lambda f: f.n_words < x.min_words),
        Rule("word_length", lambda f: ~f.word_chars.between(f.n_words * x.mean_word[0], f.n_words * x.mean_word[1])),
        Rule("symbols", lambda f: f.n_symbols > f.n_words * x.max_symbols_per_word),
        Rule("shouting", lambda f: f.upper_share > x.max_upper_share),
        Rule("equal_lines", lambda f: f.n_dup_lines > f.n_lines * x.max_dup_line_share),
        Rule("repetition", lambda f: f.n_repeat_words * 100 > f.n_words * x.max_repeat_percent),
    ]


@dataclass(frozen=True)
class Step:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def planned(docs: DataFrame, text_col: str = "text", of: list[Rule] | None = None, sample_rows: int = 500, times: int = 3) -> list[Step]:
    """The rules by falling rejection per cost, both measured on a sample of about ``sample_rows`` rows.

    The sample is drawn by a hash of each row's place, from all partitions and texts of any length, and written. The
    cost of a rule is the median time of ``times`` runs over it, less that of a run that only reads words. The
    sample orders the rules and decides nothing else.
    """
    of = of or rules()
    every = max(1, docs.count() // sample_rows)
    drawn = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    sample = written(drawn.select(whole(text_col).alias("t"), words(whole(text_col)).alias("w")).repartition(1))
    figures = Figures(F.col("t"), F.col("w"))

    def run(column: Column) -> tuple[float, float]:
        took = []
        for _ in range(times):
            began = time.perf_counter()
            n = sample.agg(F.sum(column.cast("long"))).first()[0] or 0
            took.append(time.perf_counter() - began)
        return n, median(took)

    total = sample.count()
    floor = run(F.size("w") + F.length("t") > 0)[1] if total else 0
    steps = []
    for rule in of:
        n, took = run(rule.rejects(figures)) if total else (0, 1)
        steps.append(Step(rule, n / max(total, 1), max(took - floor, 0.001)))
    return sorted(steps, key=lambda s: -s.worth) if total else steps


def cascade(order: list[Rule], text: Column, w: Column, **known: Column) -> Column:
    """The name of the first rule that rejects, or null. CASE WHEN asks no rule behind that one."""
    out, figures = None, Figures(text, w, **known)
    for rule in order:
        out = (out.when if out is not None else F.when)(rule.rejects(figures), F.lit(rule.name))
    return out


def keep_good(docs: DataFrame, text_col: str = "text", of: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; a figure is made only where a rule is asked."""
    order = [s.rule for s in planned(docs, text_col, of)]
    return docs.where(let(words(whole(text_col)), lambda w: cascade(order, whole(text_col), w)).isNull())


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, the figures of the base rules, base_failed, and kept as the cascade says.

    The base figures are asked for of every document, so the rules read them from columns; what a document that fails
    the base rules, or a rule before, saves is the figures that only later rules need.
    """
    order = [s.rule for s in planned(docs, text_col, [r for r in rules() if r.name not in ("too_short", "repetition")])]
    x, names = Limits(), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("t")).withColumn("w", words(F.col("t")))
    made = Figures(F.col("t"), F.col("w"))
    rows = rows.select("id", "t", "w", *[getattr(made, name).alias(name) for name in names])
    failed = (F.col("n_words") < x.min_words) | (100 * F.col("n_repeat_words") > x.max_repeat_percent * F.col("n_words"))
    passed = cascade(order, F.col("t"), F.col("w"), **{name: F.col(name) for name in names}).isNull()
    return rows.select(F.col("id").alias(id_col), *names, failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(passed).alias("kept"))
