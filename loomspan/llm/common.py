"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the text contracts: white space is U+0020 and U+0009 to U+000D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+", -1), F.lit(""))


def unhexed(digest: Column) -> Column:
    """The bytes of a hexadecimal digest, in a type without null: a join then adds no filter that makes them again."""
    return F.coalesce(F.unhex(digest), F.lit(b""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which a lambda that names an expression doesn't ensure."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or where it is unset a folder of ours."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        local = spark.sparkContext.master.partition("[")[0] == "local"
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{base.rstrip('/')}/loomspan-{uuid.uuid4().hex}"


#: Bits of a sieve for each key, and at most (128 MB, which is what is broadcast then).
SIEVE_BITS, SIEVE_MOST = 8, 1 << 30
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def sieved(rows: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` with a boolean ``hit``: true for every row whose 64-bit ``key`` is in the only column of ``keys``.

    ``keys`` has ``n`` rows or fewer. Other rows are hits too, by chance: one in SIEVE_BITS at most while n is below
    SIEVE_MOST / SIEVE_BITS, more beyond. So a hit has to be joined, and a row that is none needs no shuffle to be told
    from the keys. What is broadcast is a bitmap of those keys, whose size follows n up to a fixed one.
    """
    bits = min(SIEVE_MOST, max(_BITMAP, 1 << (SIEVE_BITS * n).bit_length()))
    place = lambda k: k.bitwiseAND(F.lit(bits - 1))  # noqa: E731  never null, so that no filter repeats what it is made of
    at = place(F.col(keys.columns[0]))
    maps = keys.select(F.shiftright(at, 15).cast("int").alias("__map"), at.bitwiseAND(F.lit(_BITMAP - 1)).alias("at")).groupBy("__map").agg(F.bitmap_construct_agg("at").alias("__bits"))
    rows = rows.withColumn("__at", place(key)).withColumn("__of", F.shiftright("__at", 15).cast("int")).join(F.broadcast(maps), F.col("__of") == F.col("__map"), "left")
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(F.col("__at").bitwiseAND(F.lit(_BITMAP - 1)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("__at") % 8).cast("int")).bitwiseAND(F.lit(1))
    return rows.withColumn("hit", F.coalesce(bit == 1, F.lit(False))).drop("__at", "__of", "__map", "__bits")


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def unboxed(rows: DataFrame, names: list[str], box: str = "doc") -> DataFrame:
    return rows.select(*[F.col(box)[f"c{i}"].alias(c) for i, c in enumerate(names)])


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def temporary(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when the driver ends."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, removed when the driver ends."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(temporary(spark, path))
