"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next one's documents; all but the last return the columns of ``documents``.

Defined results: an empty table passes every stage as an empty table; null and empty texts fail the quality
rules; of repeated rows one stays after near-dedup; extra columns pass the four filtering stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import _spark, mixing, near_dedup, piece_codec, quality, toxicity
from folioscope.llm.queries import piece_model

#: The first stage is a support vector machine trained on labels, which SQL can't express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 3 doesn't reject."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, _spark.read(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good by the posterior of operator 6."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (operator 7) the document with the smallest id."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of operator 9 takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded texts (operator 2), a row a document of the mix."""
    return piece_codec.digest_documents(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and read again."""
    docs = _spark.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _spark.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
