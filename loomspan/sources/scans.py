"""What repeated scans of a source say of its files: new, changed, the same, unreadable, missing, removed.

The state is a row for each file; a scan is joined to it once, and gives the next state and what changed. A scan that was
applied before changes nothing, so a job that is run again after a lost driver goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import LostRace, Manifest

# Attempts to read a file, scans in a row that a file may be missing, and what share of all may go at once.
ATTEMPTS, MISSES, SHARE, LEAST = 3, 2, 0.05, 3
STATE = "path string, size long, modified long, hash string, status string, attempts int, misses int, change string"


def scanned(state: DataFrame, scan: DataFrame) -> DataFrame:
    """The next state from ``scan`` (path, size, modified, hash), with ``change`` as this scan makes it.

    A file of equal size and time that was read before is the same, whatever its hash, which needn't be made then. A null
    hash is an attempt that failed; after ATTEMPTS in a row the file has failed. A file that is missing for MISSES scans
    in a row is removed, unless more than SHARE of all read files (and more than LEAST) would go at once: they stay, marked
    ``held``, until a scan in which fewer go. A removed file that is there again is new. Of two rows of one path in a scan
    the newest counts.
    """
    now = scan.groupBy("path").agg(F.max(F.struct(F.coalesce("modified", F.lit(-1)).alias("at"), "size", "modified", "hash")).alias("s")).select("path", *[F.col(f"s.{c}").alias(f"now_{c}") for c in ("size", "modified", "hash")], F.lit(True).alias("there"))
    both = state.join(now, "path", "full")
    there, known = F.coalesce(F.col("there"), F.lit(False)), F.coalesce(F.col("status") != "removed", F.lit(False))
    read = F.coalesce(F.col("status") == "done", F.lit(False))
    due = ~there & known & (F.col("misses") + 1 >= MISSES)
    going = both.agg(F.count_if(due).alias("due"), F.count_if(read).alias("all_read")).select((F.col("due") > F.greatest(F.lit(LEAST), F.col("all_read") * SHARE)).alias("too_many"))
    both = both.join(F.broadcast(going))  # one row
    same = read & F.col("size").eqNullSafe(F.col("now_size")) & F.col("modified").eqNullSafe(F.col("now_modified"))
    tried = F.when(known, F.coalesce("attempts", F.lit(0))).otherwise(0) + 1
    change = (
        F.when(~there, F.when(~known, F.lit(None)).when(due & ~F.col("too_many"), "removed").when(due, "held").otherwise("missing"))
        .when(same, F.lit(None)).when(F.col("now_hash").isNull(), F.when(tried >= ATTEMPTS, "failed").otherwise("retry"))
        .when(~known | F.col("hash").isNull(), "new").when(F.col("now_hash") != F.col("hash"), "changed")
    )
    both = both.withColumn("change", change)
    taken = there & ~same & F.col("now_hash").isNotNull()
    unread = there & ~same & F.col("now_hash").isNull()
    status = F.when(F.col("change") == "removed", "removed").when(~there, F.col("status")).when(same | taken, "done").otherwise(F.when(tried >= ATTEMPTS, "failed").otherwise("retry"))
    own = lambda c: F.when(taken, F.col(f"now_{c}")).when(unread & ~known, F.lit(None)).otherwise(F.col(c)).alias(c)
    return both.select(
        "path", own("size"), own("modified"), own("hash"), status.alias("status"), F.when(unread, tried).when(there, F.lit(0)).otherwise(F.coalesce("attempts", F.lit(0))).cast("int").alias("attempts"),
        F.when(there, F.lit(0)).when(known, F.col("misses") + 1).otherwise(F.col("misses")).cast("int").alias("misses"), "change",
    )


class Registry:
    """The states of a source below ``root``, a version for each scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)

    def state(self) -> DataFrame:
        _, content = self.manifest.read()
        return self.spark.read.schema(STATE).parquet(f"{self.root}/{content['state']}") if content else self.spark.createDataFrame([], STATE)

    def apply(self, number: int, scan: DataFrame) -> bool:
        """Applies scan ``number``; whether it was new. Of two writers of one scan the second is refused."""
        began, content = self.manifest.read()
        if number <= content.get("scan", 0):
            return False
        path = f"state-{number:09d}-{began}"
        scanned(self.state(), scan).write.mode("overwrite").parquet(f"{self.root}/{path}")
        self.manifest.commit(began, {"scan": number, "state": path})
        return True


__all__ = ["LostRace", "Registry", "scanned"]
