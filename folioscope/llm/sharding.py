"""Sharding by vector bin packing (operator 10).

A group is the copies of one text; its vector is bytes, tokens and rows.  Each group goes to the shard
where the dot product of its vector with the shard's residual capacity is highest.  A group stays whole
unless its bytes fit into no shard (to within 2/``SPLIT`` of one); only then it is cut into parts, by a hash of
the row's number, so that no group makes a shard uneven.

Groups large against a shard are few whatever the corpus (at most ``3 * SHARE`` a shard) and are placed
first, on the driver, largest first.  All others are packed in parallel: hash buckets of about ``BUCKET``
groups each fill their own share of what is left, so packings add up to even shards.

Defined results: a null text counts as empty, of size 1; a null id is an id; repeated rows are separate
rows with slots of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text

SPLIT, SHARE, BUCKET, SLOT_BIN = 64, 256, 20_000, 4096
WEIGHT = np.array([4.0, 1.0, 1.0])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus 1), tokens (words), CRC-32 and a 128-bit hash of the text."""
    import xxhash

    _spark.ship(docs.sparkSession)

    def run(parts):
        for part in parts:
            data, offsets = _text.buffers(part.column(1))
            tokens = np.zeros(part.num_rows, np.int64)
            for lo, hi, own, at in _text.pieces(data, offsets):
                tokens[lo:hi] = np.diff(_text.words(own, at)[2])
            view, edge = memoryview(data), offsets.tolist()
            crc, a, b = [], [], []
            for i, j in zip(edge, edge[1:]):
                crc.append(zlib.crc32(view[i:j]))
                h = xxhash.xxh3_128_intdigest(view[i:j])
                a.append((h >> 64) - 2**63)
                b.append((h & (2**64 - 1)) - 2**63)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets) + 1), pa.array(tokens), pa.array(crc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["doc_id", "size", "tokens", "text_crc32", "h1", "h2"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).transform(_spark.in_arrow, run, f"doc_id {kind}, size long, tokens long, text_crc32 long, h1 long, h2 long"
    )


def pack(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each vector, largest first; ``residual`` (shards by dimensions) is used up in place."""
    scale = np.maximum(residual.sum(0), 1e-9) / len(residual)
    unit = vectors / scale
    left = residual / scale
    out = np.zeros(len(vectors), np.int32)
    for k in np.lexsort((np.arange(len(unit)), -unit @ WEIGHT)):
        s = int(np.argmax(left @ (unit[k] * WEIGHT)))
        out[k] = s
        left[s] -= unit[k]
    residual[:] = left * scale
    return out


def place_large(vectors: np.ndarray, residual: np.ndarray, room: np.ndarray) -> np.ndarray:
    """As :func:`pack`, but only where the first dimension fits with ``room`` to spare; -1 where it fits nowhere."""
    scale = np.maximum(residual.sum(0), 1e-9) / len(residual)
    unit, left = vectors / scale, residual / scale
    out = np.full(len(vectors), -1, np.int32)
    for k in np.lexsort((np.arange(len(unit)), -unit @ WEIGHT)):
        fits = vectors[k, 0] <= residual[:, 0] + room
        if fits.any():
            s = int(np.argmax(np.where(fits, left @ (unit[k] * WEIGHT), -np.inf)))
            out[k] = s
            left[s] -= unit[k]
            residual[s] -= vectors[k]
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, tokens, text_crc32, ``shard`` and ``slot``, gapless from 0 in each shard."""
    spark = docs.sparkSession
    # row numbers are written with the rows: a task that runs again can't change them later
    rows = _spark.stored(measured(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "measured")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = np.array([float(x or 0) for x in total])
    capacity = total / shards
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    share = F.greatest(*[F.col(c) / F.lit(max(x, 1.0)) for c, x in zip(("size", "tokens", "n"), capacity)])
    groups = _spark.stored(rows.groupBy("h1", "h2").agg(*vector).withColumn("large", share > 1 / SHARE), "groups")
    # at most 3 * SHARE * shards groups are large, for their shares sum to 3 * shards
    large = groups.filter("large").toPandas().sort_values(["h1", "h2"], ignore_index=True)
    residual = np.tile(capacity, (shards, 1))
    own = large[["size", "tokens", "n"]].to_numpy(float)
    large["shard"] = place_large(own, residual, 2 * capacity[0] / SPLIT)
    # only what fits nowhere as a whole is cut, into parts that do
    cut = large[large["shard"] < 0]
    cut = cut.assign(parts=np.minimum(np.ceil(cut["size"] / max(capacity[0] / SPLIT, 1e-9)) + 1, cut["n"]).astype(int))
    whole = large[large["shard"] >= 0].assign(part=0)[["h1", "h2", "part", "shard"]]
    rows = rows.withColumn("part", F.lit(0))
    if len(cut):
        named = F.broadcast(spark.createDataFrame(cut[["h1", "h2", "parts"]], "g1 long, g2 long, parts int"))
        rows = rows.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
        # by the row's number, for all rows of a group may have one id
        rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("g1", "g2", "parts")
        inside = rows.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_semi").groupBy("h1", "h2", "part").agg(*vector)
        parts = inside.toPandas().sort_values(["h1", "h2", "part"], ignore_index=True)
        parts["shard"] = pack(parts[["size", "tokens", "n"]].to_numpy(float), residual)
        whole = pd.concat([whole, parts[["h1", "h2", "part", "shard"]]], ignore_index=True)
    residual = np.maximum(residual, 0)
    ratio = residual / np.maximum(residual.sum(0), 1e-9)
    buckets = max(1, math.ceil(groups.count() / BUCKET))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"], ignore_index=True)
        own = pdf[["size", "tokens", "n"]].to_numpy(float)
        return pdf[["h1", "h2"]].assign(part=np.int32(0), shard=pack(own, ratio * own.sum(0)))

    schema = "h1 long, h2 long, part int, shard int"
    small = groups.filter("not large").withColumn("bucket", F.pmod(F.xxhash64("h1", "h2"), F.lit(buckets))).groupBy("bucket").applyInPandas(fill, schema)
    if len(whole):
        # large groups go by broadcast, for all rows of one would meet in one task
        known = F.broadcast(spark.createDataFrame(whole, schema).toDF("g1", "g2", "p2", "shard"))
        same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("part") == F.col("p2"))
        first = rows.join(known, same).drop("g1", "g2", "p2")
        rest = rows.join(known, same, "left_anti").join(small, ["h1", "h2", "part"])
        placed = first.unionByName(rest)
    else:
        placed = rows.join(small, ["h1", "h2", "part"])
    rows = _spark.stored(placed, "placed")
    bins = max(1, math.ceil(total[2] / shards / SLOT_BIN))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins)))
    counts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(F.col("shard").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "h1", "h2", "row"))
    return (
        rows.withColumn("place", place)
        .join(start, (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("b")))
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))
    )
