"""Token counts as an exact length histogram (operator 1).

Documents are reduced to their encoded length, lengths to a histogram, and suffix sums over the
histogram answer totals, quantiles and truncated totals for every context limit.  Only the histogram
meets in one task: it has at most one row a distinct length, whatever the number of documents.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram; rows
count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark
from .piece_codec import batches, codec


def token_lengths(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded length of every text."""
    _spark.ship(docs.sparkSession)

    def run(parts):
        own = codec(model)
        for part in parts:
            for lo, hi in batches(part.column(1)):
                n = own.counts(part.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .transform(_spark.in_arrow, run, f"id {kind}, n_tokens long")
        .withColumnRenamed("id", id_col)
    )


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row a distinct length L, by suffix sums.

    ``docs`` and ``tokens`` at exactly L; ``docs_ge`` and ``tokens_ge`` at L or more; ``truncated_total``,
    the tokens that a context limit of L keeps of the whole corpus; ``share_le``, the share of documents of
    at most L, from which any quantile is read.
    """
    hist = lengths.groupBy(F.col(length_col).alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    hist = hist.withColumn("tokens", F.col("length") * F.col("docs"))
    down = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return (
        hist.withColumn("docs_ge", F.sum("docs").over(down))
        .withColumn("tokens_ge", F.sum("tokens").over(down))
        .withColumn("all_docs", F.sum("docs").over(whole))
        .withColumn("all_tokens", F.sum("tokens").over(whole))
        .select(
            "length",
            "docs",
            "tokens",
            "docs_ge",
            "tokens_ge",
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_ge") + F.col("docs")) / F.col("all_docs")).alias("share_le"),
        )
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents doesn't exceed."""
    return histogram.filter(F.col("share_le") >= q).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens kept under any context limit, also between the histogram's lengths."""
    return histogram.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"))
