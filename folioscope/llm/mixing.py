"""Mixing sources to target weights by Pareto order sampling (operator 9).

Sources share all words by weight; a source's target stops at ``max_repeat`` times its own size and the
excess is shared again by weight until no target is above its stop.

Within a source a document is expected ``e`` times, in proportion to the square root of its words and at most
``max_repeat`` times, so that the expected words are the source's target.  It gets floor(e) certain whole
copies; what is left of e is its inclusion probability p in a Pareto order sample: documents are ranked by
the odds of a uniform number divided by the odds of p, and taken in that order, as many as bring the source's
words nearest to the target.

Uniform numbers are hashes of id, text and the number of the copy among rows that agree in both, so reruns
agree.  A hot source never meets in one task: ranks fall into bins of about ``BIN`` documents near the end of
the sample, bin totals decide all bins but one a source, and only that bin is ordered row by row.  Expected
copies follow from the sizes that occur and how often.  Texts are counted where they are read and never shuffled.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a source of its
own and comes last; rows with a null id take part; repeated rows are separate documents; equal ranks go by
row; an empty table gives an empty table; other columns are ignored by :func:`mix` and kept by
:func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text

#: Documents of one bin of the order sample, about; and copies of one document that one task writes.
BIN, RUN = 4096, 512
#: Rows up to which the table of sources is broadcast; beyond, the join is left to the planner.
BROADCAST_ROWS = 50_000
#: Documents up to which the decisions about them are broadcast (about 40 bytes each); beyond, the join is left to the planner.
MOVED_ROWS = 250_000


def word_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``size``, the words ``[^\\x20\\x09-\\x0D]+`` of each text (null: 0)."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        for part in parts:
            n = np.zeros(part.num_rows, np.int64)
            data, offsets = _text.buffers(part.column(part.num_columns - 1))
            for lo, hi, own, at in _text.pieces(data, offsets):
                n[lo:hi] = np.diff(_text.words(own, at)[2])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*part.schema.names[:-1], "size"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).transform(_spark.in_arrow, run, f"{schema}, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0) -> tuple[DataFrame, int]:
    """One row a source: size, documents, weight (by code point order, null last) and target; and their number."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    stats = _spark.stored(stats.withColumn("weight", weight), "sources")
    total, count = stats.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    stop = F.col("source_size") * max_repeat
    level, capped = 0.0, -1
    while True:
        held = F.col("weight") * level > stop
        n, at_stop, free = stats.agg(
            F.count_if(held), F.coalesce(F.sum(F.when(held, stop)), F.lit(0.0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - at_stop) / free
    return stats.withColumn("target", F.least(F.col("weight") * level, stop)), count


def rates(sized: DataFrame, stats: DataFrame, max_repeat: float) -> DataFrame:
    """Per source the factor r with which documents of size s are expected min(max_repeat, r * sqrt(s)) times.

    Sizes are looked at from the largest down: those so far are held at ``max_repeat``, and r follows from the
    words that are left.  The first place from where no size is above the stop gives r; where there is none,
    every document is at the stop.
    """
    by_size = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("times"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    words, roots = F.col("times") * F.col("size"), F.col("times") * F.pow("size", F.lit(1.5))
    table = by_size.withColumn("before", F.coalesce(F.sum(words).over(down), F.lit(0))).withColumn("roots_before", F.coalesce(F.sum(roots).over(down), F.lit(0.0)))
    table = _spark.stored(table, "by-size")
    whole = table.groupBy(F.col("source").alias("s0")).agg(F.sum(roots).alias("roots"))
    table = table.join(whole, F.col("source").eqNullSafe(F.col("s0"))).join(stats.select(F.col("source").alias("s1"), "target"), F.col("source").eqNullSafe(F.col("s1")))
    # what is left is at least the row's own part, whatever rounding leaves of the difference
    left = F.greatest(F.col("roots") - F.col("roots_before"), F.col("times") * F.pow("size", F.lit(1.5)))
    rate = F.greatest(F.col("target") - max_repeat * F.col("before"), F.lit(0.0)) / left
    table = table.withColumn("rate", rate).filter(F.col("rate") * F.sqrt("size") <= max_repeat + 1e-12)
    return table.groupBy(F.col("source").alias("s3")).agg(F.max_by("rate", "size").alias("rate"))


def _numbered(sized: DataFrame) -> DataFrame:
    """``nth``: the number of a row among those that agree in id and text (the key ``h``), 0 for most."""
    often = _spark.stored(sized.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "often")
    if often.isEmpty():
        return sized.withColumn("nth", F.lit(0).cast("long"))
    # rows of one key are numbered within each block of rows, and blocks one after another
    block = F.shiftright("row", 33)
    again = sized.join(often.select("h2"), F.col("h") == F.col("h2"), "left_semi").withColumn("block", block)
    sizes = again.groupBy(F.col("h").alias("h3"), F.col("block").alias("b3")).agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("h3").orderBy("b3").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = again.join(sizes.withColumn("base", base), (F.col("h") == F.col("h3")) & (F.col("block") == F.col("b3")))
    inside = F.row_number().over(Window.partitionBy("h", "block").orderBy("row")) - 1
    again = again.withColumn("nth", F.col("base") + inside).select(*sized.columns, "nth")
    return sized.join(often.select("h2"), F.col("h") == F.col("h2"), "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(again)


def _odds(p: Column) -> Column:
    return p / F.greatest(1 - p, F.lit(1e-12))


def mix(docs: DataFrame, seed: int = 9, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, ``h`` (a hash of id and text), size, source_size, target, ``expected`` and real ``copies``, and ``taken`` words."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("h"), F.col(text_col).alias("text"))
    # row numbers are written with the rows: a task that runs again can't change them later
    sized = _spark.stored(word_counts(keyed, ["doc_id", "source", "h"]).withColumn("row", F.monotonically_increasing_id()), "sizes")
    stats, count = targets(sized, weights, max_repeat)
    rate = _spark.stored(rates(sized, stats, max_repeat), "rates")
    stats = stats.join(rate, F.col("source").eqNullSafe(F.col("s3")), "left").withColumnRenamed("source", "s").drop("s3", "weight")
    stats = _spark.stored(stats, "stats")
    near = F.broadcast if count <= BROADCAST_ROWS else (lambda x: x)
    u = (F.shiftrightunsigned(F.xxhash64("h", "nth"), 11).cast("double") + 0.5) / float(2**53)
    expected = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.least(F.coalesce(F.col("rate") * F.sqrt("size"), F.lit(max_repeat)), F.lit(max_repeat)))
    rows = (
        _numbered(sized)
        .join(near(stats), F.col("source").eqNullSafe(F.col("s")), "inner")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("long"))
        .withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("q", _odds(u) / F.greatest(_odds(F.col("p")), F.lit(1e-12)))
        # q as a number between 0 and 1: near 1/2, where samples end, a bin holds BIN documents at most
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * F.ceil(F.col("n") / BIN)))
        .select("row", "doc_id", "h", "source", "size", "source_size", "target", "expected", "whole", "p", "q", "bin")
    )
    rows = _spark.stored(rows, "ranked")
    drawn = rows.filter("p > 0 and size > 0")
    sure = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    sure = sure.select(F.col("source").alias("s4"), F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("want"))
    order = Window.partitionBy("source").orderBy("bin")
    bins = drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).join(sure, F.col("source").eqNullSafe(F.col("s4")))
    bins = (
        bins.withColumn("upto", F.sum("bin_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("upto") >= F.col("want"))
        .groupBy(F.col("source").alias("s2"))
        .agg(F.min_by(F.struct("bin", (F.col("want") - F.col("upto") + F.col("bin_size")).alias("need")), "bin").alias("m"))
        .select("s2", F.col("m.bin").alias("deciding"), F.col("m.need").alias("need"))
    )
    drawn = drawn.join(near(_spark.stored(bins, "bins")), F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("deciding", F.coalesce("deciding", F.lit(2**62)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("q", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # in order, as long as a document brings the words nearer to what is needed
    asked = drawn.filter(F.col("bin") == F.col("deciding")).withColumn("before", before).filter(F.col("need") - F.col("before") > F.col("size") / 2)
    chosen = drawn.filter(F.col("bin") < F.col("deciding")).select("row").unionByName(asked.select("row"))
    out = rows.join(chosen.withColumn("one", F.lit(1).cast("long")), "row", "left").withColumn("copies", F.col("whole") + F.coalesce("one", F.lit(0).cast("long")))
    return out.select("doc_id", "h", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed table: each document as often as the mix takes it, with all its columns.

    Of rows that agree in id and text, one is written as often as all of them are taken.
    """
    # columns go by place, so that no name can clash
    names = [f"c{k}" for k in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    with _spark.temporary(docs.sparkSession) as keep:
        chosen = mix(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
        chosen = chosen.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("h2")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
        chosen = keep(_spark.stored(chosen, "chosen"))
    same = F.col(own_id).eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2"))
    keyed = docs.toDF(*names).withColumn("h", F.xxhash64(own_id, own_text, F.lit(seed)))
    single = chosen.filter("rows = 1 and copies <= 3")
    # a short list of decisions goes to the texts, so that no text moves
    out = keyed.join(F.broadcast(single) if chosen.count() <= MOVED_ROWS else single, same)
    hot = chosen.filter("rows > 1 or copies > 3")
    many = None
    if not hot.isEmpty():
        once = keyed.join(hot, same).dropDuplicates([own_id, "h"])
        runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int")))
        many = once.withColumn("run", runs).repartition("h", "run").withColumn("copies", F.least(F.col("copies") - F.col("run") * RUN, F.lit(RUN)))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    out = out.select(*names, each) if many is None else out.select(*names, each).unionByName(many.select(*names, each))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
