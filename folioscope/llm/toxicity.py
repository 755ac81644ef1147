"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 3).

Units are words, runs of single letters ("i d i o t" is one unit), and overlapping windows of words longer
than ``WINDOW`` letters.  Punctuation and digits that don't stand for letters are dropped, so "id-iot"
reads as "idiot".  The kernel counts common subsequences of three letters (with marks at both ends of a
unit), each occurrence weighted by ``DECAY`` to the power of its span; inserted letters only cost decay.
It is normalised by the root of the summed squared weights, which leaves it positive semi-definite.

Labels belong to documents.  Units that stand out in toxic documents (counted by distinct document
sketches, so that copies don't vote twice) are positive, weighted by that number, units of clean documents
negative; virtual examples repeat the strongest positives with one letter inserted.  A squared-hinge SVM is
fitted in the Nyström space of the landmarks, hard negatives are searched among all units of the sample,
and it is fitted again.  Because the kernel has an explicit map, the machine folds into one weight
a subsequence: scoring costs the same however many landmarks there are.  A logistic curve over a document's
highest unit score and its number of positive units gives the probability.

Bounded parameters: the classifier is fitted on at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean
distinct labelled texts, chosen by a hash of the id; shares of documents are shares of distinct sketches.
Every text is scored whole.

Defined results: null, empty and blank texts score as a document without units; labels that are null are
ignored, and of repeated labels of an id the highest counts; with no toxic or no clean label every score is
0; where no unit tells the classes apart a warning is given and every score is the share of toxic labels; repeated rows score alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
POSITIVE, NEGATIVE, HARD, LANDMARKS = 4096, 12_000, 4000, 384
#: The strongest positive units, of which virtual examples with an inserted letter are made.
VIRTUAL = 48
WINDOW, DECAY, SPAN = 24, 0.6, 6
_OFFSETS = [(d, e) for d in range(1, SPAN) for e in range(1, SPAN - d + 1)]
_START, _END, KEYS = 60, 61, 64**3

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:192] = 27 + (np.arange(128, 192) & 31)
for _digit, _letter in zip(b"013457@", b"oieasta"):
    SYMBOL[_digit] = _letter - 96


@dataclass
class Units:
    """Distinct units of a run of texts: letters one after another, and which unit stands where."""

    letters: np.ndarray
    edges: np.ndarray
    which: np.ndarray
    first: np.ndarray


def units(data: np.ndarray, at: np.ndarray) -> Units:
    """Units of every text; ``first`` has each text's first place in ``which``."""
    symbols = SYMBOL[data]
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbols > 0, out=held[1:])
    stream = symbols[symbols > 0]
    begin, end, _ = _text.words(data, at)
    lo, hi = held[begin], held[end]
    keep = hi > lo
    begin, lo, hi = begin[keep], lo[keep], hi[keep]
    doc = np.searchsorted(at, begin, "right") - 1
    single = hi - lo == 1
    fresh = np.ones(len(lo), bool)
    fresh[1:] = ~(single[1:] & single[:-1] & (doc[1:] == doc[:-1]))
    start = np.flatnonzero(fresh)
    lo, hi, doc = lo[start], hi[np.append(start[1:], len(fresh)) - 1] if len(start) else hi[:0], doc[start]
    n = np.maximum(1, -(-(hi - lo - WINDOW) // (WINDOW // 2)) + 1)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hi = np.repeat(hi, n)
    lo = np.repeat(lo, n) + nth * (WINDOW // 2)
    hi = np.minimum(lo + WINDOW, hi)
    doc = np.repeat(doc, n)
    first = np.searchsorted(doc, np.arange(len(at)))
    if not len(lo):
        return Units(stream[:0], np.zeros(1, np.int64), np.zeros(0, np.int64), first)
    _, place, which = np.unique(_text.span_hash(_text.prefix_sums(stream), lo, hi), return_index=True, return_inverse=True)
    lo, size = lo[place], (hi - lo)[place]
    edges = np.concatenate([[0], np.cumsum(size)])
    letters = stream[np.arange(edges[-1]) - np.repeat(edges[:-1] - lo, size)]
    return Units(letters, edges, which, first)


def _marked(letters: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(edges) - 1
    out = np.insert(letters, np.concatenate([edges[:-1], edges[1:]]), np.concatenate([np.full(n, _START, np.uint8), np.full(n, _END, np.uint8)]))
    # an end mark and the next start mark meet at one place: np.insert keeps the order given, starts first
    edges = edges + 2 * np.arange(n + 1)
    out[edges[:-1]], out[edges[1:] - 1] = _START, _END
    return out, edges


def _triples(letters: np.ndarray, edges: np.ndarray):
    """For each pair of gaps: place of the first letter, key of the subsequence, weight."""
    s, edges = _marked(letters, edges)
    last = np.repeat(edges[1:], np.diff(edges)).astype(np.int32)
    at = np.arange(len(s), dtype=np.int32)
    wide = s.astype(np.int32)
    for d, e in _OFFSETS:
        n = len(s) - d - e
        if n <= 0:
            continue
        ok = np.flatnonzero(at[:n] + (d + e) < last[:n])
        yield ok, (wide[ok] << 12) + (wide[ok + d] << 6) + wide[ok + d + e], DECAY ** (d + e)


def _unit_of(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges) + 2)


def unit_scores(own: Units, weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of every distinct unit."""
    n = len(own.edges) - 1
    total = np.zeros(len(own.letters) + 2 * n, np.float32)
    norm = np.zeros(len(total), np.float32)
    for at, key, w in _triples(own.letters, own.edges):
        total[at] += w * weights[key]
        norm[at] += w * w
    edges = own.edges[:-1] + 2 * np.arange(n)
    if not n:
        return np.zeros(0)
    return np.add.reduceat(total, edges) / np.sqrt(np.maximum(np.add.reduceat(norm, edges), 1e-9)) + bias


def _pack(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and edges of units by name (:func:`_names`)."""
    raw = [np.frombuffer(x.encode("latin-1"), np.uint8) - 48 for x in names]
    return (np.concatenate(raw) if raw else np.zeros(0, np.uint8)), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _names(own: Units) -> list[str]:
    text = (own.letters + 48).tobytes().decode("latin-1")
    edges = own.edges.tolist()
    return [text[i:j] for i, j in zip(edges, edges[1:])]


@dataclass
class Model:
    """Weights by subsequence, and the logistic curve over document features."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray | None = None


def virtual(positive: list[str]) -> list[str]:
    """Units with one letter inserted at each place between two letters; the letter differs by place."""
    out = []
    for k, name in enumerate(positive):
        if len(name) >= 4:
            out += [name[:i] + chr(49 + (7 * k + 5 * i + j) % 26) + name[i:] for i in range(1, len(name)) for j in (0, 11)]
    return out


def fit_units(positive: dict[str, float], negative: list[str], landmarks: int = LANDMARKS, cost: float = 20.0, rounds: int = 30) -> Model:
    """Squared-hinge SVM in the Nyström space of landmarks, the first of both classes.

    ``positive`` has a weight for each unit, strongest first; ``negative`` has the hardest first.
    """
    extra = [x for x in virtual(list(positive)[:VIRTUAL]) if x not in positive]
    half = min(len(positive), landmarks // 2)
    basis = list(positive)[:half] + negative[: landmarks - half]
    column = np.full(KEYS, -1, np.int64)
    letters, edges = _pack(basis)
    found = np.unique(np.concatenate([key for _, key, _ in _triples(letters, edges)]))
    column[found] = np.arange(len(found))

    def dense(names: list[str]) -> np.ndarray:
        letters, edges = _pack(names)
        unit = _unit_of(edges)
        out, norm = np.zeros((len(names), len(found)), np.float64), np.zeros(len(names))
        for at, key, w in _triples(letters, edges):
            np.add.at(norm, unit[at], w * w)
            have = column[key] >= 0
            np.add.at(out, (unit[at][have], column[key][have]), w)
        return out / np.sqrt(np.maximum(norm, 1e-9))[:, None]

    base = dense(basis)
    values, vectors = np.linalg.eigh(base @ base.T)
    good = values > 1e-6 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    names = [*positive, *extra, *negative]
    z = np.concatenate([dense(names[k : k + 400]) @ base.T @ project for k in range(0, len(names), 400)])
    z = np.hstack([z, np.ones((len(z), 1))])
    y = np.concatenate([np.ones(len(positive) + len(extra)), -np.ones(len(negative))])
    own = np.array(list(positive.values()), float)
    c = cost * np.concatenate([own / own.mean() * 4, np.full(len(extra), 0.5), np.ones(len(negative))])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w, active = np.zeros(z.shape[1]), np.ones(len(z), bool)
    for _ in range(rounds):
        zs = z[active]
        w = np.linalg.solve(ridge + (zs * c[active, None]).T @ zs, (zs * (c * y)[active, None]).sum(0))
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    weights = np.zeros(KEYS, np.float32)
    weights[found] = base.T @ (project @ w[:-1])
    return Model(weights, float(w[-1]))


def _features(own: Units, model: Model) -> np.ndarray:
    """Per text: highest unit score (-2 without units), log of 1 plus the number of positive units."""
    n = len(own.first) - 1
    score = np.clip(unit_scores(own, model.weights, model.bias), -2, 2)[own.which] if len(own.which) else np.zeros(0)
    top = np.full(n, -2.0)
    filled = np.flatnonzero(np.diff(own.first))
    hits = np.zeros(n)
    if len(filled):
        top[filled] = np.maximum.reduceat(score, own.first[:-1][filled])
        hits[filled] = np.add.reduceat((score > 0).astype(float), own.first[:-1][filled])
    return np.stack([np.ones(n), top, np.log1p(hits)], 1)


def features(column: pa.Array, model: Model) -> np.ndarray:
    data, offsets = _text.buffers(column)
    out = np.zeros((len(offsets) - 1, 3))
    for lo, hi, own, at in _text.pieces(data, offsets, 2 << 20):
        out[lo:hi] = _features(units(own, at), model)
    return out


def _sign(hashes: np.ndarray) -> int:
    """The smallest hash of three neighbouring units: copies and most near copies of a text share it."""
    with np.errstate(over="ignore"):
        wide = hashes[:-2] + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(0xD6E8FEB86659FD93)
        if not len(wide):
            wide = hashes.sum(keepdims=True, dtype=np.uint64)
    return int(_text.mix(wide).min().view(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *np.ones(x.shape[1] - 1)])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """Learns from labelled rows that aren't held out; None if a class is missing."""
    spark = docs.sparkSession
    _spark.ship(spark)
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = _spark.stored(known, "labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    # copies of a text are one candidate, so that they can't fill the sample; only ids and hashes move
    text = F.col(text_col).cast("string")
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    rank = F.struct(F.xxhash64("id", F.lit(11)).alias("rank"), "id")
    texts = _spark.stored(known.join(hashed, "id").groupBy("toxic", "h").agg(F.min(rank).alias("m")).select("toxic", "h", "m.rank", "m.id"), "texts")
    pick = lambda kind, rows: texts.filter(F.col("toxic") == kind).orderBy("rank", "id", "h").limit(rows).select("id", "h", "toxic")
    chosen = pick(1, toxic_rows).unionByName(pick(0, clean_rows))
    # at most toxic_rows + clean_rows rows; an id's other texts, and repeated rows, don't come in
    sample = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(_spark.stored(chosen, "chosen")), ["id", "h"])
    sample = _spark.stored(sample.dropDuplicates(["id", "h"]).select("id", "toxic", "text"), "sample")

    def spread(parts):
        for part in parts:
            data, offsets = _text.buffers(part.column(2))
            toxic = np.asarray(part.column(1).to_pylist(), np.int32)
            for lo, hi, text, at in _text.pieces(data, offsets):
                own = units(text, at)
                names = np.array(_names(own), object)
                hashes = _text.mix(_text.span_hash(_text.prefix_sums(own.letters), own.edges[:-1], own.edges[1:]))
                for k in range(hi - lo):
                    held = np.unique(own.which[own.first[k] : own.first[k + 1]])
                    if len(held):
                        sign = _sign(hashes[own.which[own.first[k] : own.first[k + 1]]])
                        yield pa.RecordBatch.from_pydict(
                            {"unit": pa.array(names[held], pa.string()), "toxic": pa.array(np.full(len(held), toxic[lo + k], np.int32)), "sign": pa.array(np.full(len(held), sign, np.int64))}
                        )

    seen = _spark.stored(sample.transform(_spark.in_arrow, spread, "unit string, toxic int, sign long").distinct(), "seen")
    # sketches as in the units' counts, not rows
    sizes = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.countDistinct("sign").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    table = _spark.stored(seen.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "units")
    odds = ((F.col("t") + 0.5) / (sizes[1] + 1.0)) / ((F.col("c") + 0.5) / (sizes[0] + 1.0))
    enough = max(5, math.ceil(0.01 * sizes[1]))
    positive = {}
    # where no unit stands out as asked, rarer ones are taken before nothing is
    for least in dict.fromkeys([enough, 5, 2, 1]):
        marked = table.filter((F.col("t") >= least) & (odds >= 10) & (F.length("unit") >= 3))
        positive = {r["unit"]: float(r["t"]) for r in marked.orderBy(F.col("t").desc(), "unit").limit(POSITIVE).collect()}
        if positive:
            break
    everyone = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not positive:
        warnings.warn("no unit tells toxic from clean documents; every score is the share of toxic labels", stacklevel=2)
        return Model(np.zeros(KEYS, np.float32), -1.0, np.array([math.log(everyone[1] / everyone[0]), 0.0, 0.0]))
    clean = table.filter((F.col("c") > 0) & (odds < 3))
    negative = [r["unit"] for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVE).collect()]
    negative += [r["unit"] for r in clean.orderBy(F.col("c").desc(), "unit").limit(NEGATIVE // 6).collect()]
    model = fit_units(positive, list(dict.fromkeys(negative)))

    def rate(parts):
        for part in parts:
            names = part.column(0).to_pylist()
            letters, edges = _pack(names)
            own = Units(letters, edges, np.arange(len(names)), np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(unit_scores(own, model.weights, model.bias).astype(float))], names=["unit", "score"])

    hard = clean.select("unit").transform(_spark.in_arrow, rate, "unit string, score double").orderBy(F.col("score").desc(), "unit").limit(HARD)
    model = fit_units(positive, list(dict.fromkeys([r["unit"] for r in hard.collect()] + negative)))

    def measure(parts):
        for part in parts:
            x = features(part.column(2), model)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["toxic", "top", "hits"])

    got = sample.transform(_spark.in_arrow, measure, "toxic int, top double, hits double").toPandas()
    y = got["toxic"].to_numpy(float)
    share = np.where(y > 0, everyone[1] / max(y.sum(), 1), everyone[0] / max((1 - y).sum(), 1))
    x = np.column_stack([np.ones(len(got)), got["top"], got["hits"]])
    model.curve = fit_curve(x, y, share / share.mean())
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``keep`` columns, ``held_out``, ``score`` and ``predicted``, in one pass without a shuffle."""
    _spark.ship(docs.sparkSession)
    names = [id_col, *keep]

    def run(parts):
        for part in parts:
            column = part.column(part.num_columns - 1)
            p = _sigmoid(features(column, model) @ model.curve) if model else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], names=[*names, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    out = docs.select(*names, F.col(text_col).cast("string").alias("__text")).transform(_spark.in_arrow, run, f"{schema}, score double")
    return out.select(*names, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    _spark.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            if model is None:
                yield part
            elif part.num_rows:
                yield part.filter(pa.array(_sigmoid(features(part.column(at), model) @ model.curve) < threshold))

    return docs.transform(_spark.in_arrow, run, docs.schema)
