"""Mixes sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Sources, in the order of their code points with null last, weigh 5, 2, 1, repeating; they share all words by weight,
but no target goes beyond MOST times its source's size, and the excess is reshared by weight. Each source's target is
apportioned in blocks of BLOCK words, or where some target is small in shorter ones, down to one word, so that a block is
a BLOCK-th of the smallest target at most and no source is lost; its blocks are apportioned to its shards; in a shard the documents stand in an
order that the seed gives, and the mix takes whole rounds over all of them and then the first words of that order, up
to the quota. A document is cut only where a shard's quota ends.

Defined cases: a null text has no words, is never taken and changes nothing; a null source is a source; rows of one id
stand together in the order, count each, and share by their sizes what is taken of the last document of a shard; texts
of any length are counted whole; an empty table, or one without words, gives targets of 0; further columns are left out or kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, boxed, whole, words, written

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 64, 7
#: A source has a shard for each so many words, up to SLOTS (a power of two).
SHARD_WORDS, SLOTS = 50_000, 4096
#: Tables of sources and shards are broadcast up to so many rows (about 20 MB), else joined by a shuffle.
BROADCAST_ROWS = 200_000


def sainte_lague(parties: DataFrame, group: list[str], item: list[str], weight: str, seats: str) -> DataFrame:
    """``parties`` with a column ``quota``: the seats of each group go to the highest quotients weight / (2 k - 1).

    Seats that a lower multiplier already gives are counted, not ranked: at x = (N - n/2 - 1)/W all rounded shares give
    fewer than N seats, at (N + n/2 + 1)/W more; only the about 3 n quotients between are sorted, whatever N is.
    Equal quotients go by ``item``.
    """
    of = Window.partitionBy(*group)
    w, n_seats = F.col(weight).cast("double"), F.col(seats).cast("double")
    have = parties.where((w > 0) & (n_seats > 0)).withColumns({"__n": F.count("*").over(of), "__w": F.sum(w).over(of)})
    at = lambda x: F.floor(w * x / F.col("__w") + 0.5)
    low = F.greatest(F.lit(0).cast("long"), at(F.greatest(F.lit(0.0), (n_seats - F.col("__n") / 2 - 1) * (1 - 1e-12))))
    have = have.withColumns({"__low": low, "__high": at((n_seats + F.col("__n") / 2 + 1) * (1 + 1e-12)) + 1})
    open_ = have.withColumn("__left", F.col(seats) - F.sum("__low").over(of)).withColumn("k", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))))
    ranked = open_.withColumn("__r", F.row_number().over(of.orderBy((w / (2 * F.col("k") - 1)).desc(), *item, "k")))
    won = ranked.groupBy(*group, *item).agg((F.first("__low") + F.sum((F.col("__r") <= F.col("__left")).cast("long"))).alias("quota"))
    return parties.join(won, [*group, *item], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with sid, weight and target: min(most x size, level x weight), in all as much as there is.

    Resharing what is above until nothing is comes to one level for all sources that aren't full. In the order of
    most x size / weight the first i are full; the level is what is left by the weight that is left, at the first i
    whose next source it doesn't fill. The windows run over one row for each source.
    """
    every = Window.partitionBy()
    in_order = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cap = F.col("source_size") * most
    x = in_order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)).withColumns({"cap": cap, "full_at": cap / F.col("weight")})
    by = Window.orderBy("full_at", "sid")
    x = x.withColumns({"all": F.sum("source_size").over(every), "caps": F.sum("cap").over(by) - F.col("cap"), "rest": F.sum("weight").over(every) - F.sum("weight").over(by) + F.col("weight")})
    x = x.withColumn("level", (F.col("all") - F.col("caps")) / F.col("rest"))
    x = x.withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "sid", "level"))).over(every)["level"])
    return x.select("source", "source_size", "sid", "weight", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def quotas(sizes: DataFrame, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From (source, slot, size): per source (source, source_size, sid, target, shards), and per shard (sid, shard, shard_size, quota in words)."""
    small = written(sizes)
    sources = targets(small.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("everything", F.lit(0))
    every = Window.partitionBy()
    smallest = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every), F.lit(0.0))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(smallest / block))).cast("long"))
    seats = F.round(F.sum("source_size").over(every) / F.col("block")).cast("long")
    shards_of = F.least(F.lit(SLOTS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / SHARD_WORDS))))).cast("long")
    sources = written(sainte_lague(sources.withColumn("seats", seats), ["everything"], ["sid"], "target", "seats").select(F.col("source").alias("__source"), "source_size", "sid", "target", "quota", "block", shards_of.alias("shards")))
    slots = small.join(sources, F.col("source").eqNullSafe(F.col("__source"))).select("size", "sid", F.col("quota").alias("seats"), "block", (F.col("slot") % F.col("shards")).alias("shard"))
    shards = slots.groupBy("sid", "seats", "block", "shard").agg(F.sum("size").alias("shard_size"))
    return sources.drop("quota", "block"), sainte_lague(shards, ["sid"], ["shard"], "shard_size", "seats").select("sid", "shard", "shard_size", (F.col("quota") * F.col("block")).alias("quota"))


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has BROADCAST_ROWS or fewer."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows (id, source and more) with their source's figures, their order h and their shard."""
    rows = rows.withColumn("h", _order(seed)).join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return rows.withColumn("shard", F.pmod("h", F.lit(SLOTS)) % F.col("shards")).drop("shards")


def planned(rows: DataFrame, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """From (id, source, size), per source its figures, and per shard ``rounds``, which all of its documents are taken
    whole, and where the words beyond end: at the document (h_end, id_end), whose ``total`` words are taken up to ``more``.

    So what a document gives follows from its own place and a row of its shard, and no text is moved to be ordered. Rows
    of one id are one document here, that share ``more`` by their sizes.
    """
    sized = rows.withColumn("h", _order(seed)).withColumn("slot", F.pmod("h", F.lit(SLOTS)))
    sources, shards = (_few(written(x)) for x in quotas(sized.groupBy("source", "slot").agg(F.sum("size").alias("size")), seed, block))
    rounds = F.coalesce(F.try_divide(F.col("quota"), F.col("shard_size")).cast("long"), F.lit(0))
    documents = _placed(rows.where("size > 0"), sources, seed).groupBy("sid", "shard", "h", "id").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("sid", "shard").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    left = documents.withColumn("before", before).join(shards.withColumn("rounds", rounds), ["sid", "shard"]).withColumn("more", F.col("quota") - F.col("rounds") * F.col("shard_size") - F.col("before"))
    ends = left.where((F.col("more") >= 0) & (F.col("more") < F.col("total"))).select("sid", "shard", "rounds", F.col("h").alias("h_end"), F.col("id").alias("id_end"), "total", "more")
    return sources, _few(written(ends))


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("id"))


def _joined(rows: DataFrame, plan: tuple[DataFrame, DataFrame], seed: int) -> DataFrame:
    """Rows with ``whole``, how often they are taken whole, and for the last document of a shard ``part`` of ``total`` words."""
    sources, ends = plan
    rows = _placed(rows, sources, seed).join(ends, ["sid", "shard"], "left")
    at, end = F.struct("h", "id"), F.struct(F.col("h_end").alias("h"), F.col("id_end").alias("id"))
    last = (F.col("h") == F.col("h_end")) & F.col("id").eqNullSafe(F.col("id_end"))
    whole_ = F.coalesce(F.col("rounds") + F.when(~last & (at < end), F.lit(1)).otherwise(F.lit(0)), F.lit(0)).cast("long")
    return rows.withColumns({"whole": whole_, "part": F.when(last, F.col("more")).otherwise(F.lit(0)).cast("long")})


def _words(size: Column, most: int = MOST) -> Column:
    """The words that a row of that size gives."""
    share = F.coalesce(F.floor(F.try_divide(F.col("part").cast("decimal(38,0)") * size, F.col("total"))), F.lit(0)).cast("long")
    return F.least(size * most, F.col("whole") * size + share).cast("long")


def _taken(rows: DataFrame, seed: int, block: int) -> DataFrame:
    """Rows (id, source, size) with source_size, target and taken."""
    return _joined(rows, planned(rows, seed, block), seed).withColumn("taken", _words(F.col("size")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(whole(text_col))).cast("long").alias("size")))


def mixed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words, repeats counted)."""
    return _taken(_sized(docs, id_col, text_col, source_col), seed, block).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken k times and a part is k whole rows and one with
    the first words of that part, up to the white space behind them. Words are counted again only where a part is taken."""
    plan = planned(_sized(docs, id_col, text_col, source_col), seed, block)
    rows = docs.select(boxed(docs).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), whole(text_col).alias("text")).where(F.btrim("text", F.lit(SPACE_CHARS)) != "")
    size = F.when(F.col("part") > 0, F.size(words(F.col("text")))).otherwise(F.lit(1)).cast("long")
    taken = _joined(rows, plan, seed).withColumn("size", size).withColumn("taken", _words(F.col("size"))).where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    cut = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    # Possessive, so that Java's matcher loops over the words and doesn't recurse.
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), cut.cast("string"), F.lit("}+"))
    part = F.when(cut < F.col("size"), F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0)))
    text = docs.columns.index(text_col)
    return copies.select(*[(F.coalesce(part, F.col("doc")[f"c{i}"]) if i == text else F.col("doc")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])
