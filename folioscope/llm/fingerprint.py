"""Document fingerprints by MinHash (operator 5).

A text's shingles are its windows of ``WIDTH`` bytes (a shorter text is one shingle); ``PERMUTATIONS``
universal hash permutations in vectorised numpy give its signature, of which 16 bits a component are kept.
The likeness of two fingerprints is the share of agreeing components, less what agrees by chance.

Edited texts need the next document by descending id.  Rows are placed into ranges of ids, so each text
moves once; the highest row of a range is also sent to the range before it.  Signatures are minima, so the
part of a text that an edit keeps is hashed once for both.

:func:`similar_classes` joins signature bands in Spark and verifies Jaccard similarity on full shingle sets.

Defined results: null and empty texts have no shingles, one fingerprint of their own, and likeness 1 to each
other and 0 to any other; rows are ordered by descending id (null last), rows of one id by descending hash of
the text; a single row is its own next document; repeated rows have equal fingerprints; an empty table gives an
empty table; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text, near_dedup
from .minhash import Permutations

WIDTH, PERMUTATIONS, BANDS = 8, 128, 32
#: Rows of a range, and most ranges (their heads are known to every task); a task reads its ranges as a stream.
RANGE_ROWS, RANGES = 512, 65_536
_CHANCE = 2.0**-16


def shingles(data: np.ndarray, sums: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Hashes of the byte windows that lie in [lo, hi)."""
    if hi - lo < WIDTH:
        return np.zeros(0, np.uint64)
    begin = np.arange(lo, hi - WIDTH + 1)
    return _text.span_hash(sums, begin, begin + WIDTH)


class Signer:
    """Signatures of whole texts and of their kept parts."""

    def __init__(self) -> None:
        self.perms = Permutations(PERMUTATIONS, 5)

    def minima(self, values: np.ndarray) -> np.ndarray:
        return self.perms.extremes(values, np.array([0, len(values)]), False)[0][0]

    def whole(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        sums = _text.prefix_sums(data)
        if len(data) and len(data) < WIDTH:
            return self.minima(_text.span_hash(sums, np.array([0]), np.array([len(data)])))
        return self.minima(shingles(data, sums, 0, len(data)))

    def edit(self, text: bytes, kept: int, added: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the text and of its first ``kept`` bytes with ``added`` behind."""
        if len(text) < WIDTH or kept < WIDTH or kept + len(added) < WIDTH:
            return self.whole(text), self.whole(text[:kept] + added)
        data = np.frombuffer(text, np.uint8)
        sums = _text.prefix_sums(data)
        common = self.minima(shingles(data, sums, 0, kept))
        rest = shingles(data, sums, kept - WIDTH + 1, len(data))
        tail = np.frombuffer(text[kept - WIDTH + 1 : kept] + added, np.uint8)
        other = shingles(tail, _text.prefix_sums(tail), 0, len(tail))
        return np.minimum(common, self.minima(rest)), np.minimum(common, self.minima(other))


def pack(signature: np.ndarray) -> bytes:
    # minima of long texts are small numbers: their bits are spread before 16 of them are taken
    with np.errstate(over="ignore"):
        return ((signature * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def likeness(one: bytes, two: bytes) -> float:
    """Estimated Jaccard similarity of two packed signatures, 0 to 1; texts without shingles are alike."""
    a, b = np.frombuffer(one, ">u2"), np.frombuffer(two, ">u2")
    return max(0.0, (float((a == b).mean()) - _CHANCE) / (1 - _CHANCE))


def char_offset(text: bytes, chars: int) -> int:
    """Byte offset of the code point number ``chars``; the length if there are fewer."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(starts[chars]) if chars < len(starts) else len(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fingerprint`` (hex), in one pass without a shuffle."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        signer = Signer()
        for part in parts:
            data, offsets = _text.buffers(part.column(1))
            raw, edge = data.tobytes(), offsets.tolist()
            out = [pack(signer.whole(raw[i:j])).hex() for i, j in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(_spark.in_arrow, run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _heads(keys: DataFrame) -> list[tuple]:
    """The highest (id, h) of each range, highest first: at most ``RANGES`` of them, null ids (which are lowest) last."""
    total = keys.count()
    each = max(RANGE_ROWS, -(-total // RANGES))
    down = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    # ranks need no task that sees all keys: blocks of keys are sorted on their own and their sizes added up
    blocks = _spark.stored(keys.repartitionByRange(*down).select("id", "h", F.spark_partition_id().alias("block")), "blocks")
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("size")).withColumn("base", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*down)) - 1
    ranked = blocks.withColumn("inside", rank).join(F.broadcast(sizes), F.col("block") == F.col("b")).withColumn("rank", F.col("base") + F.col("inside"))
    return [(r["id"], r["h"]) for r in ranked.filter(F.col("rank") % each == 0).orderBy("rank").select("id", "h").collect()]


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, role, n, h, id, text) by range; a range's highest row again, as role 1, in the range before.

    Rows that agree in id and text are one, ``n`` times.  The first range's highest row goes to the last range,
    for after the last document comes the first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = _spark.stored(rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")), "ids")
    heads = _heads(keys)
    count = len(heads)
    # ascending, nulls first
    low = [(i is not None, i, h) for i, h in reversed(heads)]
    nulls = [h for i, h in reversed(heads) if i is None]

    @F.arrow_udf("struct<range: int, leads: boolean>")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        found, leads = [], []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            key = (i is not None, i, h)
            # a range holds the keys from its head down to the next head
            at = bisect.bisect_left(low, key) if i is not None else bisect.bisect_left(nulls, h)
            found.append(count - 1 - at)
            leads.append(low[at] == key)
        return pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(leads)], names=["range", "leads"])

    often = _spark.stored(keys.filter("n > 1"), "often")
    if often.isEmpty():
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    else:
        same = F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
        named = often.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "n")
        once = rows.join(named, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
        rows = once.unionByName(rows.join(named, same).select("id", "h", "text", "n").dropDuplicates(["id", "h"]))
    rows = rows.select("id", "h", "n", place("id", "h").alias("at"), "text")
    own = F.struct(F.col("at.range").alias("range"), F.lit(0).alias("role"))
    again = F.struct(((F.col("at.range") + count - 1) % max(count, 1)).alias("range"), F.lit(1).alias("role"))
    both = rows.withColumn("to", F.explode(F.when(F.col("at.leads"), F.array(own, again)).otherwise(F.array(own))))
    both = both.select("to.range", "to.role", "n", "h", "id", "text")
    return both.repartition("range").sortWithinPartitions("range", "role", F.col("id").desc_nulls_last(), F.col("h").desc())


class _Line:
    """A text waiting for its next, with what is known of it so far."""

    def __init__(self, where: int, key: object, text: bytes, times: int) -> None:
        self.where, self.key, self.text, self.times = where, key, text, times


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    _spark.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(signer: Signer, now: _Line, after: _Line, waiting: list | None) -> tuple[list, list | None]:
        """The row of ``now`` but for near_next, and the completed row of the text before it."""
        chars = int(((np.frombuffer(now.text, np.uint8) & 0xC0) != 0x80).sum())
        cut = chars // 3
        kept = char_offset(now.text, chars - cut) if cut else len(now.text)
        added = after.text[: char_offset(after.text, cut)] if cut else b""
        one, two = map(pack, signer.edit(now.text, kept, added))
        row = [now.key, chars, hashlib.sha256(now.text[:kept] + added).hexdigest(), one, two]
        return row, complete(waiting, one) if waiting else None

    def complete(row: list, after: bytes) -> list:
        return [*row[:3], row[3].hex(), row[4].hex(), likeness(row[3], row[4]), likeness(row[3], after)]

    def copied(signer: Signer, now: _Line) -> list[list]:
        """Rows of the copies of a text that another copy follows."""
        if now.times < 2:
            return []
        row, _ = finish(signer, now, now, None)
        return [complete(row, row[3])] * (now.times - 1)

    def run(parts):
        signer, now, waiting = Signer(), None, None
        for part in parts:
            out = []
            where, role, times = (part.column(k).to_pylist() for k in (0, 1, 2))
            keys = part.column(4).to_pylist()
            data, offsets = _text.buffers(part.column(5))
            raw, edge = data.tobytes(), offsets.tolist()
            for k in range(part.num_rows):
                after = _Line(where[k], keys[k], raw[edge[k] : edge[k + 1]], times[k])
                if now is not None and now.where == after.where:
                    out += copied(signer, now)
                    row, full = finish(signer, now, after, waiting)
                    if full:
                        out.append(full)
                    waiting = row
                    if role[k]:
                        out.append(complete(row, pack(signer.whole(after.text))))
                        waiting = None
                elif now is not None or waiting is not None or role[k]:
                    raise ValueError("a range doesn't end with the row that follows it")
                now = None if role[k] else after
            if out:
                types = [part.schema.field(4).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if now is not None or waiting is not None:
            raise ValueError("a range doesn't end with the row that follows it")

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _placed(docs, id_col, text_col).transform(_spark.in_arrow, run, schema)


def gram_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte windows of each text (a shorter text is one), sorted, and where each text begins."""
    sums, edge, found = _text.prefix_sums(data), at.tolist(), []
    for i, j in zip(edge, edge[1:]):
        short = 0 < j - i < WIDTH
        found.append(np.unique(_text.span_hash(sums, np.array([i]), np.array([j])) if short else shingles(data, sums, i, j)))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), starts


def similar_classes(docs: DataFrame, percent: int = 70, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of texts linked at ``percent`` similarity: signature bands joined in Spark, Jaccard verified on full sets.

    The first table has a row a document: doc_id, n_shingles, class_id (the smallest id of its class) and node (its
    distinct set); the second the verified links (a, b, jaccard) between nodes.  Buckets go by their hub first, and by
    pairs of components where several are left, as in :mod:`.near_dedup`; bands are of ``BANDS`` in ``PERMUTATIONS``.
    Rows with a null id take part and have a null class where no row of it has an id.
    """
    kind = near_dedup.Kind(gram_sets, PERMUTATIONS, False, percent)
    rows, links = near_dedup.classes(docs, id_col, text_col, kind)
    rows = rows.select("doc_id", "n_shingles", F.col("component_id").alias("class_id"), "node")
    return rows, links.select("a", "b", (F.col("both") / F.col("whole")).alias("jaccard"))
