"""URL filters: rules on hosts and paths, and for the urls that no rule fits gradient-boosted trees on lexical features.

The trees are trained on labelled urls, which here are those that a rule fits. Features: lengths, depth, digit and
letter shares, entropy of the characters, counts of parameters and marks, and for the host's suffixes, its first label
and the first path segment how often other hosts' labelled urls are blocked with them. A training url's statistics
leave out the fold of hosts that it is in, so the trees don't learn from its own label; each node is offered a third of
the features, so that no single one, such as a key that the rules themselves name, decides alone. ``held_out_auc``
says how well labels of hosts that the trees haven't seen are ranked.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees
like any other; without labelled urls everything is allowed; with labels of one kind the trees give that kind;
repeated rows get equal verdicts; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: At most so many distinct labelled urls train the trees, chosen by their hashes; a twentieth is kept for each label.
SAMPLE_ROWS = 20_000
#: Hosts fall into so many folds by their hash.
FOLDS = 5
KEYS = ("last", "two", "sub", "first")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


# Fixed values of the contract.
RULES = [rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), path


def fitting(rules: list[Rule], host: Column, path: Column, value=lambda r: r.name) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(value(r))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits for a character; 0 for an empty text."""
    share = lambda c, s: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(s)
    of = lambda s: F.aggregate(F.array_distinct(F.array_remove(F.split(s, ""), "")), F.lit(0.0), lambda a, c: let(share(c, s), lambda p: a - p * F.log2(p)))
    return let(F.coalesce(text, F.lit("")), of)


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("double")


def features(rows: DataFrame) -> DataFrame:
    """Adds lexical features (f_...) and the keys of the suffix statistics (k_...) to rows with url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.length(url).cast("double")
    per = lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0))
    return rows.withColumns(
        {
            "f_length": size, "f_host": F.length(host).cast("double"), "f_path": F.length(path).cast("double"),
            "f_depth": _count(path, "/"), "f_dots": _count(host, "."), "f_hyphens": _count(url, "-"),
            "f_digits": per(_count(url, "0-9")), "f_letters": per(_count(url, "A-Za-z")), "f_percent": per(_count(url, "%")),
            "f_parameters": _count(url, "="), "f_ampersands": _count(url, "&"), "f_fragment": url.contains("#").cast("double"),
            "f_secure": url.startswith("https").cast("double"), "f_entropy": entropy(url), "f_host_entropy": entropy(host),
            "k_last": F.regexp_extract(host, r"([^.]*)$", 1), "k_two": F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1), "k_first": F.regexp_extract(path, r"^/([^/]*)", 1),
            "k_sub": F.regexp_extract(host, r"^([^.]*)\.", 1), "f_path_digits": _count(path, "0-9"), "f_path_entropy": entropy(path), "f_file": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "f_longest": F.array_max(F.transform(F.split(path, "[/._-]"), lambda x: F.length(x))).cast("double"), "f_vowels": per(_count(host, "aeiou")), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
        }
    )


def _statistics(train: DataFrame, key: str, smooth: float = 10.0) -> DataFrame:
    """How often urls of a key are blocked, drawn to the share of all: for each fold by the other folds, and for -1 by all.

    One row for each key of the sample and fold that has it or lacks it.
    """
    sums = train.groupBy(key, "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    all_ = sums.groupBy(key).agg(F.sum("b").alias("b_all"), F.sum("n").alias("n_all"))
    whole_, every = train.agg(F.avg("label")).first()[0], F.array(*map(F.lit, range(-1, FOLDS)))
    table = all_.withColumn("fold", F.explode(every)).join(sums, [key, "fold"], "left").fillna(0, ["b", "n"])
    return table.select(key, "fold", ((F.col("b_all") - F.col("b") + smooth * whole_) / (F.col("n_all") - F.col("n") + smooth)).alias("s_" + key[2:]))


class Trees:
    """Statistics and trees from labelled urls (url, host, path, label)."""

    def __init__(self, labelled: DataFrame, trees: int, depth: int, keys: tuple[str, ...]) -> None:
        from pyspark.ml.classification import GBTClassifier

        train = written(features(labelled).coalesce(1))
        self.prior = train.agg(F.avg("label")).first()[0]
        self.tables = {f"k_{k}": written(_statistics(train, f"k_{k}").coalesce(1)) for k in keys}
        known = written(self.vectors(train).select("features", "label").coalesce(1))
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=32, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(known)

    def vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        for k, statistics in self.tables.items():  # FOLDS + 1 rows for each key of the sample
            df = df.join(F.broadcast(statistics), [k, "fold"], "left").withColumn("s_" + k[2:], F.coalesce("s_" + k[2:], F.lit(self.prior)))
        names = sorted(c for c in df.columns if c[:2] in ("f_", "s_"))
        return VectorAssembler(inputCols=names, outputCol="features").transform(df)

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p_block; the statistics are those of all labelled urls."""
        from pyspark.ml.functions import vector_to_array

        found = self.model.transform(self.vectors(features(rows).withColumn("fold", F.lit(-1))))
        return found.select(*rows.columns, F.element_at(vector_to_array("probability"), 2).alias("p_block"))


def sampled(labelled: DataFrame, n: int) -> DataFrame:
    """The n distinct urls of the smallest hashes, by hash; of a rare label a twentieth of n, if it has so many."""
    place = F.xxhash64("url")
    each = written(labelled.distinct())
    least = lambda df, k: df.orderBy(place, "url").limit(k)
    firsts = [least(each.where(F.col("label") == label), max(1, n // 20)).withColumn("turn", F.lit(0)) for label in (0.0, 1.0)]
    every = firsts[0].unionByName(firsts[1]).unionByName(least(each, n).withColumn("turn", F.lit(1)))
    chosen = every.groupBy("url", "host", "path", "label").agg(F.min("turn").alias("turn")).orderBy("turn", place, "url").limit(n)
    return chosen.drop("turn").orderBy(place, "url")


def _ruled(pages: DataFrame, id_col: str, url_col: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """All rows with their rule, and the labelled urls."""
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": fitting(rules, F.col("host"), F.col("path")), "ruled": fitting(rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
    return rows, rows.where("ruled IS NOT NULL").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the trees' probability to block (null where a rule fits)."""
    rows, labelled = _ruled(pages, id_col, url_col, rules)
    train = written(sampled(labelled, sample_rows).coalesce(1))
    kinds = [r["label"] for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:
        verdict = F.coalesce("ruled", F.lit("block" if kinds == [1.0] else "allow"))
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    open_ = Trees(train, trees, depth, keys).scored(rows.where("ruled IS NULL").select("id", "url", "host", "path", "rule"))
    by_trees = open_.select("id", "host", "path", "rule", F.when(F.col("p_block") > 0.5, "block").otherwise("allow").alias("verdict"), "p_block")
    by_rules = rows.where("ruled IS NOT NULL").select("id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    return by_rules.unionByName(by_trees).withColumnRenamed("id", id_col)


def held_out_auc(pages: DataFrame, url_col: str = "url", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4, keys: tuple[str, ...] = KEYS) -> float:
    """The area under the ROC curve over the labelled urls of one fold of hosts, for trees that learned from the others."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    every = written(sampled(_ruled(pages, url_col, url_col, rules)[1], sample_rows).withColumn("held", F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0).coalesce(1))
    model = Trees(every.where(~F.col("held")).drop("held"), trees, depth, keys)
    return BinaryClassificationEvaluator(rawPredictionCol="p_block").evaluate(model.scored(every.where("held").drop("held")))
