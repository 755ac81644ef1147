"""Resuming an audit: keyed results, of which the last write counts, kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = ("offline", "online", "llm")


def last_writes(rows: DataFrame, key: str = "key", order: str = "line_no") -> DataFrame:
    """The last row of each key; aggregated map-side, so a key with many rows isn't one task."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def needed(entries: DataFrame, results: DataFrame, requested: list[str]) -> DataFrame:
    """(key, todo): phases requested and not done; none are done where the raw text has changed."""
    fresh = entries.select("key", F.sha2("raw", 256).alias("raw_hash"))
    both = fresh.join(results.select("key", F.col("raw_hash").alias("old"), "done"), "key", "left")
    done = F.when(F.col("raw_hash") == F.col("old"), F.col("done")).otherwise(F.array().cast("array<string>"))
    asked = set(requested) | ({"online"} if "llm" in requested else set())
    todo = F.array_except(F.array(*[F.lit(p) for p in PHASES if p in asked]), F.coalesce(done, F.array().cast("array<string>")))
    return both.select("key", todo.alias("todo")).filter(F.size("todo") > 0)


def keep_last(stream: DataFrame, target: str, checkpoint: str, key: str, order: str):
    """Starts an available-now query that keeps the last row of each key below ``target``, a folder a batch.

    A batch reads the newest folder, merges and writes a new one, so a batch that runs again replaces its own.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch
        if batch_id > 0:
            now = spark.read.parquet(f"{target}/batch={batch_id - 1}").unionByName(batch)
        last_writes(now, key, order).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
