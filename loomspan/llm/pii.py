"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that no base pattern knows.

Base matches are seeds; of a fifth kind, secrets, seeds are lower-case hexadecimal runs in quotes behind an equals sign.
Patterns are what surrounds a value: the one or two words before it, the marks between those and it, the word behind it,
that it begins a line, and the kind of the base match shortly before it. Patterns and the values they surround are a
bipartite graph; the values of all candidates (runs of digits, things with an at sign, colon-parted hexadecimal numbers,
long runs of letters and digits) are in it, seeds and others. A pattern's confidence for a kind is the mean score of its
distinct values; a value's score is 1 for a seed, else 1 - product(1 - confidence) over the patterns with enough
support. After some rounds, a candidate that a pattern of high confidence surrounds, and whose shape suits the kind, is
a new span.

All of it is DataFrame functions. Positions are code points: split() gives the text between the matches that
regexp_extract_all() gives, and running sums of their lengths are the places.

Defined cases: a null or empty text has no spans (base_sha256 is that of the empty string); texts and words of any length
are read whole; repeated rows get equal results; of equal scores for two kinds the first of ALL_KINDS counts; an empty
table gives no rows; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, whole, written

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]

# Fixed values of the contract, with possessive repeats so that Java's matcher loops and never recurses, and for emails
# and addresses a test that a run is tried from its begin only (a later begin of one run can match no more than it).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Seeds of secrets.
SECRET = r"(?<==[\x20]?\")[0-9a-f]{32,}+(?=\")"
#: What may be an identifier: things with an at sign in any writing, long runs with letters and digits, hexadecimal
#: groups, runs of digits.
CANDIDATE = r"[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9.-]++(?:\x20?(?:\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+|(?<![A-Za-z0-9_+/-])(?=[0-9_+/-]*+[A-Za-z])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Fa-f:])|[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"
#: Contexts are first looked for so many characters around a value, and in the whole text where they reach further.
WINDOW = 80


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    least_support: int = 5
    least_confidence: float = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _suits(kind: str, value: Column) -> Column:
    """Whether a value that isn't a base match may be of the kind."""
    if kind == "email":
        return value.rlike(r"@|\[at\]|\(at\)")
    if kind == "ip":
        return value.rlike(r":.*:|^[0-9]+(?:\.[0-9]+){2,}$")
    if kind == "secret":
        return (F.length(value) >= 20) & value.rlike(r"^[A-Za-z0-9_+/-]+$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    n = F.length(_digits(value))
    plain = value.rlike(r"^[+(]?[0-9(][\x20().0-9-]*$")
    return plain & (n.between(12, 19) if kind == "card" else n.between(6, 15))


def running(x: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks of about the root of its size: appending copies an array."""

    def plain(x: Column, base: Column) -> Column:
        none = F.struct(base.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, v: let(a["sum"] + v, lambda s: F.struct(s.alias("sum"), F.concat(a["out"], F.array(s)).alias("out")))
        return F.aggregate(x, none, step)["out"]

    def blocks(x: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda b: F.slice(x, b * n + 1, n))

    def joined(b: Column) -> Column:
        sums = plain(F.transform(b, lambda y: F.aggregate(y, F.lit(0).cast("long"), lambda a, v: a + v)), F.lit(0))
        return let(sums, lambda s: F.flatten(F.transform(b, lambda y, i: plain(y, F.coalesce(F.get(s, i - 1), F.lit(0).cast("long"))))))

    return F.when(F.size(x) <= 64, plain(x, F.lit(0))).otherwise(let(blocks(x), joined))


def located(text: Column, pattern: str, needs: str) -> Column:
    """All leftmost matches that don't overlap: array of (value, start, end) in code points, end exclusive."""

    def places(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = let(gaps, lambda g: F.transform(found, lambda m, i: (F.length(F.get(g, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))).cast("long")))
        return let(running(steps), lambda at: F.transform(found, lambda m, i: F.struct(m.alias("value"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"))))

    none = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")
    found = F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(places(m)))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value): by kind in the order of KINDS, then by start."""

    def of(kind: str) -> Column:
        good = F.filter(located(text, BASE[kind], NEEDS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*map(of, KINDS))


def _words_before(text: Column, start: Column) -> Column:
    """The last two words before a place (fewer at the text's begin), numbers as 0."""
    clean = lambda t: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]+", " "), r"[0-9]+", "0"))
    split = lambda t: F.filter(F.split(clean(t), r"\s+"), lambda w: w != "")
    near = split(F.substring(text, F.greatest(F.lit(1), start - WINDOW + 1).cast("int"), F.least(start, F.lit(WINDOW)).cast("int")))
    # The window's first word may be the end of a longer one.
    whole_words = let(near, lambda w: F.when((F.size(w) > 2) | (start <= WINDOW), w).otherwise(split(F.substring(text, F.lit(1), start.cast("int")))))
    return let(whole_words, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), F.lit(2)))


def _word_behind(text: Column, end: Column) -> Column:
    word = lambda t: F.regexp_extract(t, r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]*+)", 0)
    near = word(F.substring(text, (end + 1).cast("int"), F.lit(WINDOW)))
    found = let(near, lambda w: F.when(F.length(w) < WINDOW, w).otherwise(word(F.substring(text, (end + 1).cast("int"), F.length(text)))))
    return F.lower(F.regexp_replace(F.regexp_replace(found, r"[^\p{L}\p{N}]+", ""), "[0-9]+", "0"))


def contexts(text: Column, start: Column, end: Column, base: Column) -> Column:
    """The patterns around a value, each with a sign of its own before it."""
    words = _words_before(text, start)
    marks = F.regexp_extract(F.substring(text, F.greatest(F.lit(1), start - 7).cast("int"), F.least(start, F.lit(8)).cast("int")), r"([^\p{L}\p{N}]*)$", 1)
    last = lambda w: F.element_at(w, -1)
    before = let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) == 1, F.array(last(w))).otherwise(F.array(F.concat_ws(" ", F.element_at(w, -2), last(w)), last(w))))
    marked = let(marks, lambda m: F.when((F.size(words) > 0) & (F.btrim(m, F.lit(SPACE_CHARS)) != ""), F.concat(F.lit("="), last(words), m)))
    behind = let(_word_behind(text, end), lambda w: F.when(w != "", F.concat(F.lit(">"), w)))
    line = F.when((start == 0) | (F.substring(text, start.cast("int"), F.lit(1)) == "\n"), F.lit("^"))
    near = F.filter(base, lambda b: (b["end"] <= start) & (b["end"] > start - WINDOW))
    neighbour = let(near, lambda n: F.when(F.size(n) > 0, F.concat(F.lit("#"), F.element_at(F.array_sort(F.transform(n, lambda b: F.struct(b["end"].alias("end"), b["kind"].alias("kind")))), -1)["kind"])))
    return F.array_distinct(F.concat(before, F.filter(F.array(marked, behind, line, neighbour), lambda p: p.isNotNull())))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its base spans, and the candidates apart from them, each with the patterns before it."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("secret", F.transform(located(F.col("text"), SECRET, "[0-9a-f]{32}"), lambda m: F.struct(F.lit("secret").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))))
    rows = rows.withColumn("seeds", F.concat("base", "secret"))
    apart = F.filter(located(F.col("text"), CANDIDATE, r"[0-9@]|\[at\]|\(at\)"), lambda c: ~F.exists(F.col("seeds"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    any_kind = lambda c: _suits("email", c["value"]) | _suits("ip", c["value"]) | _suits("card", c["value"]) | _suits("phone", c["value"]) | _suits("secret", c["value"])
    with_context = lambda spans, kind: F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), contexts(F.col("text"), s["start"], s["end"], F.col("base")).alias("patterns")))
    return rows.select("id", F.xxhash64("text").alias("text_hash"), F.size("base").alias("n_base"), with_context(F.col("seeds"), lambda s: s["kind"]).alias("seeds"), with_context(F.filter(apart, any_kind), lambda s: F.lit(None).cast("string")).alias("open"))


def _graph(marked: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind) with kind null for what is no seed; all patterns of seeds and candidates."""
    every = marked.where((F.size("seeds") > 0) | (F.size("open") > 0)).select(F.explode(F.concat("seeds", "open")).alias("s"))
    return every.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind")).distinct()


def confident_patterns(graph: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, kind, confidence) of the patterns with enough support, after the rounds; ``graph`` is a written table.

    Each round asks all patterns: those that the values found in the round before support count as those of seeds do.
    Only patterns before fewer values than the support needs are left out, which no round can support. A pattern before
    very many values is counted in parts, and its edges come straight from the table to the join, where Spark splits a
    task that grows large.
    """
    pairs = written(graph.groupBy("pattern", "value").agg(F.bool_or(F.col("kind").isNull()).alias("open")))
    reach = written(pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= how.least_support))
    edges = written(pairs.join(reach, "pattern"))
    seeds = written(graph.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct())
    suits = F.coalesce(*[F.when((F.col("k") == kind) & _suits(kind, F.col("value")), F.lit(True)) for kind in ALL_KINDS], F.lit(False))
    scores, found = seeds, None
    for _ in range(how.rounds):
        by = edges.select("pattern", "value", "n").join(scores, "value")
        found = by.groupBy("pattern", "kind").agg((F.sum("score") / F.first("n")).alias("confidence"), F.count_if(F.col("score") >= 0.5).alias("support"))
        found = written(found.where((F.col("support") >= how.least_support) & (F.col("confidence") >= how.least_confidence / 2)))
        new = edges.where("open").select("pattern", "value").join(found.withColumnRenamed("kind", "k"), "pattern").where(suits)
        new = new.groupBy("value", F.col("k").alias("kind")).agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        scores = seeds.unionByName(new).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return found.where(F.col("confidence") >= how.least_confidence).select("pattern", "kind", "confidence")


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base, secrets and new), n_spans, n_new."""
    marked = written(_marked(docs, id_col, text_col))
    patterns = written(confident_patterns(written(_graph(marked)), how))
    open_ = marked.where(F.size("open") > 0).select("id", "text_hash", F.explode("open").alias("s")).select("id", "text_hash", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))
    suits = F.coalesce(*[F.when((F.col("kind") == kind) & _suits(kind, F.col("value")), F.lit(True)) for kind in ALL_KINDS], F.lit(False))
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    hits = open_.join(patterns, "pattern").where(suits)
    best = hits.groupBy("id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("confidence", -order)).alias("kind"))
    new = best.groupBy("id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    new = new.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = marked.select("id", "text_hash", plain(F.col("seeds")).alias("seeds"), plain(F.slice("seeds", F.lit(1), F.col("n_base"))).alias("base"))
    rows = rows.join(new, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    every = F.concat("seeds", F.coalesce("new", none))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(ranked).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size(F.coalesce("new", none)).cast("long").alias("n_new"))
