"""Rules about a file: repeated keys, DOIs and works, and censuses of styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _first(by: list[str]) -> Window:
    return Window.partitionBy("file_id", *by).orderBy("entry_seq")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """Second and later entries of a key, with the line of the first."""
    w = _first(["key"])
    out = entries.select("file_id", "entry_seq", "key", "lineno", F.first("lineno").over(w).alias("first_line"), F.row_number().over(w).alias("nth"))
    return out.filter("nth > 1")


def _with_doi(entries: DataFrame) -> DataFrame:
    return T.once(entries, doi=T.bare_doi(T.field("doi")))


def duplicate_dois(entries: DataFrame) -> DataFrame:
    """Second and later entries of a DOI, with the key of the first."""
    own = _with_doi(entries.select("file_id", "entry_seq", "key", "fields")).filter("doi <> ''").drop("fields")
    w = _first(["doi"])
    return own.select("*", F.first("key").over(w).alias("first_key"), F.row_number().over(w).alias("nth")).filter("nth > 1")


def duplicate_works(entries: DataFrame) -> DataFrame:
    """Entries whose title key, year and first surname occurred before, unless their DOI did.

    Both windows go over the same rows; an entry without a DOI is a partition of its own in that of the DOIs.
    """
    own = _with_doi(entries.select("file_id", "entry_seq", "key", "fields"))
    own = T.once(own, title_key=T.title_key(T.field("title")), year=T.field("year"), first=F.coalesce(F.try_element_at(T.authors(T.field("author")), F.lit(1)), F.lit("")))
    own = T.once(own.drop("fields"), surname=T.fold_surname(F.col("first")), alone=F.when(F.col("doi") == "", F.col("entry_seq"))).drop("first")
    own = own.select("*", F.row_number().over(_first(["doi", "alone"])).alias("of_doi")).filter("title_key <> ''").drop("doi", "alone")
    w = _first(["title_key", "year", "surname"])
    return own.select("*", F.first("key").over(w).alias("first_key"), F.row_number().over(w).alias("nth")).filter("nth > 1 and of_doi = 1").drop("of_doi")


def author_form_census(entries: DataFrame) -> DataFrame:
    """Per file the entries by form of names (with comma or without), where a file has both."""
    form = F.when(F.contains(T.field("author"), F.lit(",")), "comma").otherwise("space")
    count = entries.filter(T.filled("author")).groupBy("file_id", form.alias("form")).agg(F.count(F.lit(1)).alias("n"))
    both = count.groupBy("file_id").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("file_id")
    return count.join(both, "file_id", "left_semi")


def arxiv_style_census(entries: DataFrame) -> DataFrame:
    """Per file the entries by place of the arXiv number, where a file uses several."""
    style = F.when(T.filled("eprint"), "eprint").when(F.contains(F.lower(T.field("journal")), F.lit("arxiv")), "journal").when(F.contains(F.lower(T.field("doi")), F.lit("arxiv")), "doi")
    count = entries.withColumn("style", style).filter("style is not null").groupBy("file_id", "style").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "entry_seq").alias("first_key"))
    both = count.groupBy("file_id").agg(F.count(F.lit(1)).alias("styles")).filter("styles > 1").select("file_id")
    return count.join(both, "file_id", "left_semi")
