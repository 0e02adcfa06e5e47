"""Recorded names (buyers, stores, items, ...) in a question: exact phrases, aliases, and close spellings."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFF = 0.85
GAP = 0.02  # by which the closest has to be closer than the next


def _norm(column):
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def base(column):
    """A name without its legal form."""
    return F.trim(F.regexp_replace(_norm(column), r"\b(ltd|limited|inc|llc|co|company|corp|gmbh)\b", ""))


@F.pandas_udf(T.DoubleType())
def closeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratios; where an upper bound of it is below the cutoff, that bound. Few texts b are looked at once for all a."""
    known: dict[str, difflib.SequenceMatcher] = {}
    out = []
    for x, y in zip(a, b):
        m = known.get(y) or known.setdefault(y, difflib.SequenceMatcher(None, "", y))
        m.set_seq1(x)
        bound = m.quick_ratio()
        out.append(m.ratio() if bound >= CUTOFF else bound)
    return pd.Series(out, dtype="float64")


def _pairs(text):
    """The pairs of neighbouring characters, those that repeat with a number, in an order that all texts share."""
    two = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    numbered = lambda two: F.transform(two, lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.concat(x, F.size(F.filter(F.slice(two, F.lit(1), i + 1), lambda y: y == x)).cast("string")).alias("pair")))
    return F.array_sort(F.element_at(F.transform(F.array(two), numbered), 1))["pair"]  # as a variable, the pairs are made once a text


def _first(pairs, length):
    """As many of the pairs as hold one that any close text shares.

    A ratio r = 2 M / (la + lb) leaves x and y characters unmatched, x + y <= 2 M (1 / r - 1), and each takes at most
    two of the pairs of its own text or one of the other's. So M - 1 - x - y pairs are shared, with M >= la r / (2 - r).
    """
    least = F.greatest(F.lit(1), F.ceil(length * (CUTOFF / (2 - CUTOFF)) * (3 - 2 / CUTOFF) - 1 - 1e-6))
    return F.slice(pairs, F.lit(1), (F.size(pairs) - least + 1).cast("int"))


def lookup(questions: DataFrame, entries: DataFrame, factory: str | None = None) -> DataFrame:
    """(question_id, entity, value, code, score): questions (question_id, text) against entries (entity, value, code,
    factory, alias). A whole name scores 1, its base 1 (one word 0.95), an alias 1, a close spelling of a base of two
    words or more its ratio, against phrases of as many words, one less or one more. Exact hits are joins on phrases;
    spelling is compared where enough pairs of characters are shared, as they are at any ratio that counts."""
    own = entries if factory is None else entries.where(F.col("factory").isNull() | (F.col("factory") == factory))
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    named = own.select("entity", "value", "code", F.explode(F.array(F.struct(_norm(F.col("value")).alias("phrase"), F.lit(1.0).alias("score")), F.struct(base(F.col("value")).alias("phrase"), F.when(F.size(F.split(base(F.col("value")), " ")) > 1, 1.0).otherwise(0.95).alias("score")), F.struct(_norm(F.coalesce("alias", F.lit(""))).alias("phrase"), F.lit(1.0).alias("score")))).alias("p")).select("entity", "value", "code", "p.*").where("phrase != ''")
    longest = named.agg((F.max(F.size(F.split("phrase", " "))) + 1).alias("longest"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least("longest", F.size("w"))), lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))
    asked = questions.withColumn("w", split(_norm(F.col("text")))).where(F.size("w") > 0).join(F.broadcast(longest)).select("question_id", F.explode(F.array_distinct(grams)).alias("phrase"))  # one row
    exact = asked.join(named, "phrase").select("question_id", "entity", "value", "code", "score")
    phrases = asked.where(F.length("phrase") > 2).select("question_id", "phrase", F.size(F.split("phrase", " ")).alias("n"), F.length("phrase").alias("l"), _pairs(F.col("phrase")).alias("g"))
    phrases = phrases.withColumn("f", _first(F.col("g"), F.col("l")))
    long = own.select("entity", "value", "code", base(F.col("value")).alias("b")).withColumn("bn", F.size(F.split("b", " "))).where(F.col("bn") > 1).repartition("value", "code")  # names may come in few files
    long = long.withColumn("bl", F.length("b")).withColumn("bg", _pairs(F.col("b"))).withColumn("bf", _first(F.col("bg"), F.col("bl")))
    near = phrases.withColumn("pair", F.explode("f")).join(long.withColumn("pair", F.explode("bf")), "pair").where(F.abs(F.col("n") - F.col("bn")) <= 1)
    total = F.col("l") + F.col("bl")
    near = near.where(2 * F.least("l", "bl") >= CUTOFF * total - 1e-6).where(F.element_at(F.array_intersect("f", "bf"), 1) == F.col("pair"))  # once for all pairs shared
    near = near.where(F.size(F.array_intersect("g", "bg")) >= total * (CUTOFF / 2) * (3 - 2 / CUTOFF) - 1 - 1e-6)
    near = near.select("question_id", "entity", "value", "code", "b", "phrase").repartition("value", "code")
    fuzzy = near.withColumn("score", closeness("b", "phrase")).where(F.col("score") >= CUTOFF).select("question_id", "entity", "value", "code", "score")
    return exact.unionByName(fuzzy).groupBy("question_id", "entity", "value", "code").agg(F.max("score").alias("score"))


def resolve(hits: DataFrame) -> DataFrame:
    """Per question and entity the only best value, or all best ones as candidates."""
    alike = hits.groupBy("question_id", "entity", "score").agg(F.array_sort(F.collect_set("value")).alias("candidates"))
    out = alike.groupBy("question_id", "entity").agg(F.max_by("candidates", "score").alias("candidates"), F.max("score").alias("score"))
    return out.withColumn("value", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))


def closest(asked: str, known: list[str], cutoff: float = CUTOFF, gap: float = GAP) -> str | None:
    """The recorded spelling of a value that found nothing: exact without case, or clearly the closest."""
    low = {k.lower(): k for k in known}
    if asked.lower() in low:
        return low[asked.lower()]
    scored = sorted(((difflib.SequenceMatcher(None, asked.lower(), k.lower()).ratio(), k) for k in known), reverse=True)
    if not scored or scored[0][0] < cutoff or (len(scored) > 1 and scored[0][0] - scored[1][0] < gap):
        return None
    return scored[0][1]


def tokens_of(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower()))
