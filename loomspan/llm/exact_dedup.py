"""Exact duplicates: groups by a 128-bit content hash whose members are compared byte by byte.

Only texts that may have a copy are moved. A 64-bit key that equal texts share is counted first; the texts whose key
is single are settled by that, and stay where they are. Those of a repeated key are aggregated by (128-bit hash,
bytes), before and after one shuffle: the second key is what tells texts of one hash apart, so a collision makes two
groups, and a group of any size reaches a task as one row for each task that read some of it.

A group that has a thousandth of all rows or more is one of a thousand at most; those are broadcast to the documents'
hashes, so no task of the other join meets more than a thousandth of the rows under one key. Two texts with equal
128-bit hash and equal SHA-256 but unequal bytes would end the query with an error.

Defined cases: a null text counts as empty; a null id is an id of its own; repeated rows (same id, same text) are all
reported and count in ``group_size``, and one of them stays; texts of any length are hashed and compared whole; ties of
ids are repeated rows; an empty table gives no rows. ``exact_groups`` leaves further columns out, and
``drop_exact_duplicates`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lower_ascii, sieved, unboxed, unhexed, whole

#: A group with 1 / HOT of all rows or more is broadcast, HOT groups at most.
HOT = 1000
_BEST = {"smallest": F.min, "largest": F.max}


def _key(text_col: str) -> Column:
    """Texts that are equal after lower-casing A-Z are equal after lower-casing everything, which is much cheaper."""
    return F.xxhash64(F.lower(whole(text_col)))


def _maybe_again(rows: DataFrame, text_col: str, n: int) -> DataFrame:
    """``rows`` with ``hit``, false for those whose text is surely single."""
    keys = rows.select(_key(text_col).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return sieved(rows, _key(text_col), keys, n)


def _joined(rows: DataFrame, again: DataFrame, best, n: int, only_kept: bool = False) -> DataFrame:
    """``rows`` (id, h, sha and more) with ``n`` and ``stays`` of their group, null where the text is single.

    ``again`` (id, norm, h) has all texts that occur more than once. Rows that found their group among the broadcast
    ones go through the other join by their place in the input, which no group matches, so they are spread; if only
    those that are kept are asked for, the others go before that.
    """
    texts = again.groupBy("h", "norm").agg(F.count("*").alias("n"), best("id").alias("stays"))
    groups = texts.select("h", unhexed(F.sha2("norm", 256)).alias("sha"), "n", "stays").groupBy("h", "sha").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), best("stays").alias("stays"))
    checked = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long"))
    groups = groups.where("n > 1").select(F.col("h").alias("g_h"), F.col("sha").alias("g_sha"), F.struct(checked.alias("n"), "stays").alias("group"))
    hot = F.col("group.n") * HOT >= n
    few, rest = groups.where(hot).withColumnRenamed("group", "few"), groups.where(~hot).withColumn("g_at", F.xxhash64("g_h"))
    same = (F.col("h") == F.col("g_h")) & (F.col("sha") == F.col("g_sha"))
    met = rows.join(F.broadcast(few), same, "left").drop("g_h", "g_sha")
    if only_kept:
        met = met.where(F.col("few").isNull() | F.col("id").eqNullSafe(F.col("few.stays")))
    met = met.withColumn("at", F.when(F.col("few").isNull(), F.xxhash64("h")).otherwise(F.monotonically_increasing_id()))
    met = met.join(rest, (F.col("at") == F.col("g_at")) & same, "left").withColumn("group", F.coalesce("few", "group"))
    if only_kept:
        met = met.where(F.col("group").isNull() | F.col("id").eqNullSafe(F.col("group.stays")))
    return met.select(*rows.columns, F.col("group.n").alias("n"), F.col("group.stays").alias("stays"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=F.md5) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. ``keep``: the "smallest" or "largest" id."""
    rows, n = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")), docs.count()
    norm = lower_ascii(F.col("text")).alias("norm")
    hashed = lambda df: df.withColumn("h", unhexed(hash_of("norm")))
    again = hashed(_maybe_again(rows, "text", n).where("hit").select("id", norm))
    every = hashed(rows.select("id", norm)).select("id", "h", unhexed(F.sha2("norm", 256)).alias("sha"))
    stays = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("stays"))
    return _joined(every, again, _BEST[keep], n).select(
        F.col("id").alias(id_col),
        stays.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(stays).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns; of fully equal rows with the id that stays, one remains.

    Documents whose text is single aren't shuffled, and of the largest groups only the rows with the id that stays are.
    """
    n = docs.count()
    marked = _maybe_again(docs.select(boxed(docs).alias("doc"), F.col(id_col).alias("id"), whole(text_col).alias("text")), "text", n)
    again = marked.where("hit").select("doc", "id", lower_ascii(F.col("text")).alias("norm")).withColumns({"h": unhexed(F.md5("norm")), "sha": unhexed(F.sha2("norm", 256))})
    kept = _joined(again.select("doc", "id", "h", "sha"), again.select("id", "norm", "h"), _BEST[keep], n, only_kept=True)
    one = kept.groupBy("h", "sha", "id").agg(F.first("doc").alias("doc"))
    return unboxed(marked.where(~F.col("hit")).select("doc").unionByName(one.select("doc")), docs.columns)
