"""Quality rules by weak supervision (operator 6).

Each rule votes good, bad, or abstains.  Expectation-maximisation estimates, without labels, how often each
rule votes what on good and on bad documents, and the posterior probability of good decides, in place of
a filter that all rules must pass.  EM sees only the counts of vote patterns (at most 3 to the power of
the number of rules, summed over all documents), so its work doesn't grow with the corpus.

Defined results: null and empty texts have no words and fail the base rules; repeated rows get equal
verdicts; an empty table gives an empty table; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
LETTER = np.zeros(256, np.int64)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = 1
SHOUT = np.zeros(256, np.int64)
SHOUT[[ord(c) for c in "!?"]] = 1
WIDTH = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_stutters"]


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them aren't the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row a text, one column a feature, in the order of ``FEATURES``."""
    n, docs = len(data), len(at) - 1
    out = np.zeros((docs, len(FEATURES)), np.int64)
    if not n:
        return out
    begin, end, first = _text.words(data, at)
    sums = _text.prefix_sums(data)
    counts = np.diff(first)
    out[:, 0] = counts
    out[:, 1] = _per_text(((data & 0xC0) != 0x80) & ~_text.SPACE[data], at)
    for k, table in ((2, SYMBOL), (6, UPPER), (7, LETTER), (8, SHOUT)):
        out[:, k] = _per_text(table[data], at)
    salt = _text.mix(np.arange(1, docs + 1, dtype=np.uint64))

    edge = np.zeros(n + 1, bool)
    edge[at[:-1]] = True
    edge[1:][data == 10] = True
    edge[n] = False
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], n)
    doc = np.searchsorted(at, lo, "right") - 1
    hi = np.minimum(hi, at[doc + 1])
    hi = hi - ((hi > lo) & (data[np.maximum(hi - 1, 0)] == 10))
    held = np.searchsorted(begin, hi) > np.searchsorted(begin, lo)
    lo, hi, doc = lo[held], hi[held], doc[held]
    if len(lo):
        with np.errstate(over="ignore"):
            _, later = _repeated(_text.span_hash(sums, lo, hi) + salt[doc])
        out[:, 3] = np.bincount(doc[later], minlength=docs)
        out[:, 5] = np.bincount(doc, minlength=docs)

    hashes = _text.span_hash(sums, begin, end)
    if len(hashes) > 1:
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[first[:-1][counts > 0]] = False
        out[:, 9] = _per_text(again, first)

    full = counts >= WIDTH
    if full.any():
        windows = np.where(full, counts - WIDTH + 1, 0)
        start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
        key = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WIDTH):
                key += hashes[start + k] * _text._SHINGLE[k]
            key = _text.mix(key) + np.repeat(salt, windows)
        twice, _ = _repeated(key)
        covered = np.zeros(len(begin) + 1, bool)
        for k in range(WIDTH):
            covered[start[twice] + k] = True
        out[:, 4] = _per_text(covered[:-1], first)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of every whole text; the id and the ``keep`` columns pass through, the text moves once."""
    _spark.ship(docs.sparkSession)
    names = [id_col, *keep]
    passes = text_col in names and docs.schema[text_col].dataType.simpleString() == "string"
    place = names.index(text_col) if passes else len(names)

    def run(parts):
        for part in parts:
            data, offsets = _text.buffers(part.column(place))
            out = np.zeros((part.num_rows, len(FEATURES)), np.int64)
            for lo, hi, own, at in _text.pieces(data, offsets):
                out[lo:hi] = features(own, at)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(out[:, k]) for k in range(len(FEATURES))]], names=[*names, *FEATURES])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in FEATURES])
    return docs.select(*names, *([] if passes else [F.col(text_col).cast("string").alias("__text")])).transform(_spark.in_arrow, run, schema)


def _vote(bad: Column, good: Column | None = None) -> Column:
    """-1 bad, 1 good, 0 abstains; an undefined ratio abstains."""
    vote = F.when(F.coalesce(bad, F.lit(False)), -1)
    return (vote if good is None else vote.when(F.coalesce(good, F.lit(False)), 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the columns of :func:`measured`.

    A document can be bad in one way and ordinary in all others, so a rule about one kind of junk votes bad
    or abstains; only the rule that looks at prose as a whole votes for good.
    """
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    lines = F.when(F.col("n_lines") >= 3, F.col("n_lines"))
    letters = F.when(F.col("n_letters") >= 20, F.col("n_letters"))
    symbols, shouts, mean = F.col("n_symbols") / words, F.col("n_shouts") / words, F.col("word_chars") / words
    upper, repeats, copies = F.col("n_upper") / letters, F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    stutter = F.col("n_stutters") / words
    plain = (F.col("n_words") >= 10) & mean.between(2.5, 10) & (symbols < 0.1) & (upper < 0.35) & (repeats < 0.25) & (stutter < 0.2)
    return {
        "symbols": _vote(symbols > 0.15),
        "capitals": _vote(upper > 0.4),
        "shouting": _vote(shouts > 0.4),
        "repeats": _vote(repeats > 0.4),
        "copied_lines": _vote(copies > 0.4),
        "stutter": _vote(stutter > 0.3),
        "word_length": _vote((mean < 2.5) | (mean > 10)),
        "prose": _vote(F.col("n_words") < 10, plain),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.02) -> np.ndarray:
    """Probability of good for each vote pattern (rows of -1, 0, 1) that was seen ``counts`` times.

    Classes are independent-vote mixtures.  A start in which rules are right more often than not, kept as
    a prior worth the share ``prior`` of all documents, ties the first class to good.
    """
    rules = patterns.shape[1]
    # bad, abstain, good: on good and on bad documents
    start = np.empty((2, rules, 3))
    start[0], start[1] = (0.01, 0.49, 0.5), (0.3, 0.5, 0.2)
    at = patterns + 1
    hot = np.eye(3)[at]
    theta, share = start.copy(), np.array([0.8, 0.2])
    total = counts.sum()
    good = np.full(len(patterns), 0.8)
    for _ in range(rounds):
        log = np.log(share)[:, None] + np.stack([np.log(theta[y])[np.arange(rules), at].sum(1) for y in (0, 1)])
        log -= log.max(0)
        post = np.exp(log) / np.exp(log).sum(0)
        done = np.abs(post[0] - good).max() < 1e-9
        good = post[0]
        if done:
            break
        for y in (0, 1):
            weight = post[y] * counts
            soft = prior * total * (0.8, 0.2)[y] * start[y]
            theta[y] = ((weight[:, None, None] * hot).sum(0) + soft) / (weight.sum() + prior * total * (0.8, 0.2)[y])
            share[y] = (weight.sum() + prior * total * (0.8, 0.2)[y]) / (total * (1 + prior))
    return good


def posterior(seen: list) -> dict[tuple, float]:
    """Probability of good by vote pattern, from rows (votes, n)."""
    if not seen:
        return {}
    patterns = np.array([r["votes"] for r in seen], np.int64)
    p = expectation_maximisation(patterns, np.array([r["n"] for r in seen], float))
    return {tuple(r["votes"]): float(x) for r, x in zip(seen, p)}


def _counted(table: DataFrame) -> list:
    """Counts of vote patterns, at most 3 to the power of the number of rules."""
    return table.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()


def _decided(table: DataFrame, good: dict[tuple, float], threshold: float) -> DataFrame:
    spark = table.sparkSession
    known = F.broadcast(spark.createDataFrame([(list(k), p) for k, p in good.items()], "pattern array<int>, p_good double"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        table.join(known, F.col("votes") == F.col("pattern"), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold))
        .drop("pattern")
    )


def _voted(table: DataFrame) -> DataFrame:
    return table.select("*", F.array(*[v.cast("int") for v in votes().values()]).alias("votes"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Features, ``base_failed``, ``p_good`` and ``kept`` of every document (and the ``keep`` columns)."""
    table = _spark.stored(_voted(measured(docs, id_col, text_col, keep)), "features")
    return _decided(table, posterior(_counted(table)), threshold)


def kept_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns; texts are read twice and never written or shuffled."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    seen = _counted(_voted(measured(plain.select(F.lit(0).alias("__id"), text), "__id", text)))
    out = _decided(_voted(measured(plain, names[0], text, tuple(names[1:]))), posterior(seen), threshold)
    return out.filter("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
