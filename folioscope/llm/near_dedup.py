"""Near-duplicate groups by min-max hashing (operator 7).

A document's set is its distinct word shingles.  Under each of ``PERMUTATIONS`` permutations both the
minimum and the maximum are kept; bands of ``ROWS`` minima, and of as many maxima, are the blocking keys.
At Jaccard similarity 0.7 a pair agrees in none of the 52 bands with probability 6e-7.

Documents with equal sets are one node.  A bucket of nodes that share a band is never expanded into all
pairs: every node is held against the bucket's smallest node (the hub), links are confirmed on the full
sets, and components are taken.  Only nodes of buckets that then still hold more than one component are
held against the nodes of the other components in their bucket.  Where such a bucket has more than ``CROWD``
nodes, they are told apart by a second band first, and by a third: a pair at 0.7 agrees in none of the other
51 with probability 8e-7, while pairs below meet ever less.  Pairs whose 8-bit sketches agree in
less than half of 208 components, which a pair at 0.7 does with probability below 1e-9, aren't confirmed.

Confirmation streams texts by hub: the hub's set is kept and each member's text passes once; hubs with many
members are salted, with a copy of the hub's text in each part.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; repeated rows
are one node, and all rows of the smallest id are kept; rows with a null id take part but name no component
(``component_id`` is null and ``kept`` true if no row of the component has an id, else ``kept`` is false);
very long texts are read whole; an empty table gives an empty table; other columns are ignored.
Nodes are 64-bit hashes of the sets: among a billion documents two different sets collide with
probability 0.03.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from .connected import components
from .minhash import Permutations, band_keys, set_hash

WIDTH, PERMUTATIONS, ROWS = 5, 104, 4
#: Least share of agreeing sketch components of a pair that is confirmed, and members of one part of a hub.
AGREE, PART = 0.5, 256
#: Nodes of a bucket with several components beyond which further bands tell them apart, and how often they do.
CROWD, DEEPER = 2048, 2
#: Numbers of texts up to which the list of those to be confirmed is broadcast (16 bytes each); beyond, texts are shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Kind:
    """What a text's set is, how it is sketched, and which similarity (in percent) links."""

    sets: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    permutations: int = PERMUTATIONS
    maxima: bool = True
    percent: int = 70



def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text begins."""
    hashes, first = _text.word_hashes(data, at)
    return _text.distinct_by_text(*_text.shingles(hashes, first, width))


WORDS = Kind(shingle_sets)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = WORDS) -> DataFrame:
    """Per row: doc_id, uid (a hash of id and text), n_shingles, node, an 8-bit sketch and the band keys."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        perms = Permutations(kind.permutations)
        for part in parts:
            data, offsets = _text.buffers(part.column(2))
            for lo, hi, own, at in _text.pieces(data, offsets):
                values, starts = kind.sets(own, at)
                low, high = perms.extremes(values, starts, kind.maxima)
                both = [low, high] if kind.maxima else [low]
                keys = np.concatenate([band_keys(x, ROWS, k + 1) for k, x in enumerate(both)], 1)
                n = np.diff(starts)
                sketch = np.concatenate([x >> np.uint32(9) for x in both], 1).astype(np.uint8)
                width = keys.shape[1]
                edges = np.concatenate([[0], np.cumsum(np.where(n > 0, width, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(lo, hi - lo),
                        part.column(1).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(set_hash(values, starts).view(np.int64)),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys[n > 0].reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "uid", "n_shingles", "node", "sketch", "bands"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("uid"), text.alias("text")).transform(_spark.in_arrow, run, f"doc_id {id_type}, uid long, n_shingles long, node long, sketch binary, bands array<long>"
    )


def _likely(pairs: DataFrame, nodes: DataFrame, kind: Kind) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches agree enough; with both uids."""
    left = nodes.select(F.col("node").alias("a"), F.col("uid").alias("ua"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("uid").alias("ub"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = (100 * F.least("na", "nb")) >= kind.percent * F.greatest("na", "nb")
    met = pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "ua", "ub", "sa", "sb")

    def run(parts):
        for part in parts:
            if part.num_rows:
                one, two = (_text.buffers(part.column(k).cast(pa.large_binary()))[0].reshape(part.num_rows, -1) for k in (4, 5))
                yield part.select(["a", "b", "ua", "ub"]).filter(pa.array((one == two).mean(1) >= AGREE))

    return met.transform(_spark.in_arrow, run, "a long, b long, ua long, ub long")


def _confirmed(docs: DataFrame, pairs: DataFrame, text_col: str, id_col: str, kind: Kind) -> DataFrame:
    """Links (a, b, both, whole) among pairs (a, b, ua, ub), a being the hub: 100 * both >= percent * whole on full sets."""
    parts = pairs.groupBy("a", "ua").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    member = pairs.join(parts.drop("ua"), "a").select(F.col("ub").alias("uid"), "a", "b", salt.alias("salt"), F.lit(1).alias("role"))
    hub = parts.select(F.col("ua").alias("uid"), "a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    sent = _spark.stored(member.unionByName(hub), "sent")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(F.col(id_col), text).alias("uid"), text.alias("text"))
    # repeated rows have one uid; one text each is enough.  A short list goes to the texts, so that no other text moves
    wanted = _spark.stored(sent.select("uid").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    texts = texts.join(wanted, "uid", "left_semi").dropDuplicates(["uid"])
    placed = sent.join(texts, "uid").select("a", "salt", "role", "b", "text")
    placed = placed.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "role")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, have = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, salt, role = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3, 1, 2))
            data, offsets = _text.buffers(batch.column(4))
            out = [], [], [], []
            for lo, hi, own, at in _text.pieces(data, offsets):
                values, starts = kind.sets(own, at)
                edge = starts.tolist()
                for k in range(lo, hi):
                    mine = values[edge[k - lo] : edge[k - lo + 1]]
                    if role[k] == 0:
                        now, have = (a[k], salt[k]), mine
                        continue
                    if now != (a[k], salt[k]):
                        raise ValueError("a hub's text is missing")
                    place = np.searchsorted(have, mine)
                    place[place == len(have)] = 0
                    both = int((have[place] == mine).sum()) if len(have) else 0
                    whole = len(have) + len(mine) - both
                    if 100 * both >= kind.percent * whole and both:
                        for column, x in zip(out, (a[k], b[k], both, whole)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "both", "whole"])

    return placed.transform(_spark.in_arrow, run, "a long, b long, both long, whole long")


def _across(crowded: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a bucket; ``crowded`` has (band, node, c).

    A second band tells a crowded bucket apart.  Only bands of this table come into question: two nodes of
    different components that share another one are both in it, but for hubs, which have met all others.
    """
    found, bands = None, crowded.select("node", F.col("band").alias("b2"))
    for depth in range(DEEPER + 1):
        big = crowded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("band")
        small = crowded
        if depth < DEEPER:
            big = _spark.stored(big, "crowded")
            more = not big.isEmpty()
            if more:
                small = crowded.join(big, "band", "left_anti")
        one = small.select("band", F.col("node").alias("x"), F.col("c").alias("cx"))
        two = small.select("band", F.col("node").alias("y"), F.col("c").alias("cy"))
        pairs = one.join(two, "band").filter("cx < cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if depth == DEEPER or not more:
            return found.distinct()
        inner = crowded.join(big, "band", "left_semi").join(bands, "node").filter("b2 <> band")
        inner = _spark.stored(inner.select(F.xxhash64(F.least("band", "b2"), F.greatest("band", "b2")).alias("band"), "node", "c").distinct(), "inner")
        mixed = inner.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("band")
        crowded = _spark.stored(inner.join(mixed, "band", "left_semi"), "deeper")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return classes(docs, id_col, text_col)[0]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = WORDS) -> tuple[DataFrame, DataFrame]:
    """Membership, per row: doc_id, n_shingles, component_id, kept, uid and node; and the confirmed links (a, b, both, whole) of nodes."""
    table = _spark.stored(sketches(docs, id_col, text_col, kind), "sketches")
    held = table.filter("n_shingles > 0")
    # one row a node: the smallest uid among its copies, then that row's sketch
    chosen = held.groupBy("node").agg(F.min("uid").alias("uid"))
    nodes = held.join(chosen, ["node", "uid"], "left_semi").select("node", "uid", F.col("n_shingles").alias("n"), "sketch", "bands").dropDuplicates(["node"])
    nodes = _spark.stored(nodes, "nodes")
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    live = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most").drop("most")
    buckets = _spark.stored(rows.join(live, "band"), "buckets")
    pairs = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = _spark.stored(pairs, "pairs")
    links = _spark.stored(_confirmed(docs, _spark.stored(_likely(pairs, nodes, kind), "likely"), text_col, id_col, kind), "links")
    found = _spark.stored(components(links), "components")

    root = buckets.join(found.withColumnRenamed("root", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = root.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("band")
    # the hub itself has met all others
    open_ = _spark.stored(root.join(mixed, "band", "left_semi").filter("node <> hub").select("band", "node", "c"), "open")
    rest = _across(open_).join(pairs, ["a", "b"], "left_anti")
    more = _spark.stored(_confirmed(docs, _spark.stored(_likely(rest, nodes, kind), "likely"), text_col, id_col, kind), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = _spark.stored(components(links), "components")

    least = held.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = least.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "component_id")
    full = table.join(named, (F.col("node") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "uid", "node"), links


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the smallest id, with all its columns; of repeated rows one stays."""
    with _spark.temporary(docs.sparkSession) as keep:
        kept = groups(docs, id_col, text_col).filter("kept").groupBy("uid").agg(F.count(F.lit(1)).alias("times"))
        kept = keep(_spark.stored(kept, "kept"))
    # columns go by place, so that no name can clash
    names = [f"c{k}" for k in range(len(docs.columns))]
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    out = docs.toDF(*names).withColumn("key", F.xxhash64(own_id, own_text.cast("string")))
    out = out.join(kept.select("uid"), F.col("key") == F.col("uid"), "left_semi")
    if kept.filter("times > 1").limit(1).count():
        out = out.dropDuplicates(["key"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
