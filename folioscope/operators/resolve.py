"""Finding the record of each entry, persistent identifiers, related works and published versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ID = ["file_id", "entry_seq"]


def identifiers(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, doi, doi_from_url, arxiv_id, isbn, recid): the DOI field first, else one in the address or note.

    ``keep``: further columns of the entries.
    """
    own = T.bare_doi(T.field("doi"))
    mined = F.coalesce(F.nullif(T.doi_in(T.field("url")), F.lit("")), T.doi_in(T.field("note")))
    number = lambda name: F.nullif(T.arxiv_id(T.field(name)), F.lit(""))
    usable = T.filled("doi") & own.rlike(r"^10\.[0-9]{4,9}/\S") & ~T.placeholder_doi(own)
    return entries.select(
        *ID, "key", *keep, F.when(usable, own).otherwise(F.lower(mined)).alias("doi"), (~usable & (mined != "")).alias("doi_from_url"),
        F.coalesce(F.when(F.lower(T.field("archiveprefix")).isin("", "arxiv"), number("eprint")), F.when(F.contains(F.lower(T.field("journal")), F.lit("arxiv")), number("journal")), F.when(F.contains(T.field("url"), F.lit("arxiv.org")), number("url")), F.lit("")).alias("arxiv_id"),
        F.coalesce(F.nullif(T.isbn_in(T.field("isbn")), F.lit("")), T.isbn_in(T.field("note"))).alias("isbn"), T.inspire_recid(T.field("url")).alias("recid"),
    )


def resolutions(entries: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Records of every entry, (id, source, ord, ...): each source joined on its own identifier, in order of trust."""
    keys = {"crossref": "doi", "datacite": "doi", "arxiv": "arxiv_id", "inspire": "recid", "isbn": "isbn"}
    ids, out = identifiers(entries), None
    for ord_, (source, key) in enumerate(keys.items()):
        if source in records:
            own = records[source].withColumnRenamed("id", "rid").drop("source")
            met = ids.filter(F.col(key) != "").select(*ID, F.col(key).alias("want")).join(own, F.col("want") == F.col("rid")).drop("want", "rid")
            met = met.select(*ID, F.lit(source).alias("source"), F.lit(ord_).alias("ord"), *[c for c in own.columns if c != "rid"])
            out = met if out is None else out.unionByName(met)
    return out


def abstracts(found: DataFrame, others: DataFrame) -> DataFrame:
    """The first abstract by order of source, else that of the status service."""
    first = found.filter("abstract is not null and abstract <> ''").groupBy(*ID).agg(F.min_by("abstract", "ord").alias("a"))
    return first.join(others.select(*ID, F.col("abstract").alias("b")), ID, "full").select(*ID, F.coalesce("a", F.nullif("b", F.lit(""))).alias("abstract"))


def pid_check(entries: DataFrame, found: DataFrame, searched: DataFrame, from_year: int = 2005) -> DataFrame:
    """(id, key, category, field, suggested): what is to be said of an entry's persistent identifier.

    ``searched`` is (id, doi) of accepted search hits.
    """
    e = identifiers(entries, ("etype", "fields"))
    e = e.join(found.select(*ID).distinct().withColumn("known", F.lit(True)), ID, "left").join(searched.select(*ID, F.col("doi").alias("hit")), ID, "left")
    year = T.year_of(F.coalesce(F.nullif(T.field("year"), F.lit("")), T.field("date")))
    wanted = year.isNull() | (year >= from_year)
    book = F.col("etype").isin("book", "mvbook", "collection")
    has_doi, has_arxiv = (F.col("doi") != "") & ~F.col("doi_from_url"), F.col("arxiv_id") != ""
    category = (
        F.when(book, F.when((F.col("isbn") == "") & (F.col("doi") == "") & wanted, "pid_missing"))
        .when(~F.col("etype").isin("article", "inproceedings"), None)
        .when(has_doi, None)
        .when(F.col("doi_from_url") | F.col("hit").isNotNull(), "doi_available")
        .when(has_arxiv, None)
        .when(wanted, "pid_missing")
    )
    said = T.once(e, category=category).filter("category is not null")
    available = F.col("category") == "doi_available"
    suggested = F.when(available, F.coalesce(F.nullif("doi", F.lit("")), F.col("hit")))
    return said.select(*ID, "key", "category", F.when(available, "doi").alias("field"), suggested.alias("suggested"))


def retracted(entries: DataFrame, status: DataFrame) -> DataFrame:
    """Entries whose work the status service marks as withdrawn; ``status`` is (id, is_retracted) by DOI."""
    bad = status.filter("is_retracted").select(F.col("id").alias("doi"))
    return identifiers(entries).join(bad, "doi", "left_semi").select(*ID, "key")


def related_works(entries: DataFrame, relations: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, key, label, target): deposited relations and titles that speak of the entry's work, one row a target.

    ``relations`` is (id, label, target) by DOI; ``titles`` is (target, title, surname) of candidate works.
    """
    ids = identifiers(entries).filter("doi <> ''")
    linked = ids.join(relations.withColumnRenamed("id", "doi"), "doi").filter("target <> doi").select(*ID, "key", "label", "target", F.lit(0).alias("way"))
    own = entries.select(*ID, "key", T.words(T.title_key(T.field("title"))).alias("w"), T.fold_surname(F.coalesce(F.try_element_at(T.authors(T.field("author")), F.lit(1)), F.lit(""))).alias("surname"))
    named = titles.withColumn("label", T.related_label(F.col("title"))).filter("label is not null").select("target", "label", "surname", T.words(T.title_key(F.col("title"))).alias("tw"))
    shared = F.size(F.array_intersect("w", "tw")) / F.size("w")
    hits = own.filter(F.size("w") >= 4).join(named, "surname").filter(shared >= 0.6).select(*ID, "key", "label", "target", F.lit(1).alias("way"))
    both = linked.unionByName(hits)
    return both.groupBy(*ID, "key", "target").agg(F.min_by("label", F.struct("way", "label")).alias("label"))


def superseded_preprints(entries: DataFrame, records: DataFrame, published: DataFrame) -> DataFrame:
    """Preprints with a published version: (id, key, doi, agrees); ``published`` is (doi, title, surname)."""
    own = entries.filter(T.preprint()).select(*ID, "key", T.title_key(T.field("title")).alias("t"), T.fold_surname(F.coalesce(F.try_element_at(T.authors(T.field("author")), F.lit(1)), F.lit(""))).alias("s"))
    links = records.filter("source = 'arxiv' and doi is not null").select(*ID, F.lower("doi").alias("doi"))
    met = own.join(links, ID).join(published.select("doi", T.title_key(F.col("title")).alias("pt"), F.col("surname").alias("ps")), "doi")
    return met.select(*ID, "key", "doi", ((T.overlap(T.words(F.col("t")), T.words(F.col("pt"))) >= 0.6) & T.surname_match(F.col("s"), F.col("ps"))).alias("agrees"))


def type_verdict(etype, document_type):
    """The entry type that a record's document type asks for, where it differs and isn't a near relation."""
    near = {("inbook", "incollection"), ("incollection", "inbook"), ("collection", "book"), ("book", "collection"), ("misc", "preprint"), ("article", "preprint"), ("online", "preprint"), ("unpublished", "preprint")}
    fine = etype == document_type
    for a, b in sorted(near):
        fine = fine | ((etype == a) & (document_type == b))
    return F.when(document_type.isNotNull() & ~fine, document_type)
