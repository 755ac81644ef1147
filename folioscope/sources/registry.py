"""Snapshots of registry payloads to one schema of records, and the log of entry results.

A payload table is (id, status, body); bodies are parsed in the JVM.  Lookups are joins on these tables,
so no task ever waits for a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_CROSSREF = (
    "struct<message:struct<DOI:string,type:string,title:array<string>,`container-title`:array<string>,volume:string,issue:string,page:string,abstract:string,"
    "author:array<struct<family:string,given:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,relation:map<string,array<struct<id:string>>>,"
    "`updated-by`:array<struct<type:string,DOI:string>>>>"
)
_DATACITE = (
    "struct<data:struct<attributes:struct<creators:array<struct<familyName:string,givenName:string,name:string>>,titles:array<struct<title:string>>,"
    "publicationYear:int,publisher:string,version:string,types:struct<resourceTypeGeneral:string>>>>"
)
_OPENALEX = "struct<is_retracted:boolean,abstract_inverted_index:map<string,array<int>>>"
_INSPIRE = (
    "struct<metadata:struct<authors:array<struct<full_name:string>>,titles:array<struct<title:string>>,earliest_date:string,document_type:array<string>,"
    "publication_info:array<struct<year:int,journal_volume:string,journal_issue:string,page_start:string,artid:string,journal_title:string>>,abstracts:array<struct<value:string>>>>"
)
_OPENLIBRARY = "struct<title:string,publish_date:string,publishers:array<string>>"


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    names = ("title", "authors", "year", "volume", "number", "pages", "journal", "doi", "document_type", "abstract", "version")
    empty = lambda n: F.lit(None).cast("array<string>" if n == "authors" else "string")
    return df.select("id", F.lit(source).alias("source"), *[columns.get(n, empty(n)).cast("array<string>" if n == "authors" else "string").alias(n) for n in names])


def answered(payloads: DataFrame) -> DataFrame:
    return payloads.filter("status = 200 and body is not null")


def crossref(payloads: DataFrame) -> DataFrame:
    m = F.col("m")
    df = answered(payloads).select("id", F.from_json("body", _CROSSREF)["message"].alias("m")).filter("m is not null")
    names = F.transform(m["author"], lambda a: F.coalesce(F.when(a["family"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])), a["name"]))
    return _record(
        df, "crossref", title=T.without_markup(_first(m["title"])), authors=F.filter(names, lambda n: n != ""), year=_first(_first(m["issued"]["date-parts"])), volume=m["volume"], number=m["issue"],
        pages=m["page"], journal=_first(m["container-title"]), doi=F.lower(m["DOI"]), document_type=T.document_type(m["type"]), abstract=T.without_markup(m["abstract"]),
    )


def crossref_relations(payloads: DataFrame) -> DataFrame:
    """(id, label, target): deposited relations and updates of a work."""
    m = F.from_json("body", _CROSSREF)["message"]
    df = answered(payloads).select("id", m["relation"].alias("r"), m["updated-by"].alias("u"))
    one = df.select("id", F.explode("r").alias("label", "t")).select("id", "label", F.explode("t.id").alias("target"))
    return one.unionByName(df.select("id", F.explode("u").alias("x")).select("id", F.col("x.type").alias("label"), F.col("x.DOI").alias("target"))).withColumn("target", T.bare_doi(F.col("target"))).distinct()


def datacite(payloads: DataFrame) -> DataFrame:
    a = F.col("a")
    df = answered(payloads).select("id", F.from_json("body", _DATACITE)["data"]["attributes"].alias("a")).filter("a is not null")
    names = F.transform(a["creators"], lambda c: F.coalesce(F.when(c["familyName"].isNotNull(), F.concat_ws(", ", c["familyName"], c["givenName"])), c["name"]))
    return _record(df, "datacite", title=_first(a["titles"])["title"], authors=names, year=a["publicationYear"], journal=a["publisher"], document_type=T.document_type(a["types"]["resourceTypeGeneral"]), version=F.regexp_replace(a["version"], "^[vV](?=[0-9])", ""))


def openalex(payloads: DataFrame) -> DataFrame:
    """(id, is_retracted, abstract): the abstract put together from its inverted index."""
    df = answered(payloads).select("id", F.from_json("body", _OPENALEX).alias("w"))
    pairs = F.flatten(F.transform(F.map_entries("w.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return df.select("id", F.coalesce("w.is_retracted", F.lit(False)).alias("is_retracted"), F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ").alias("abstract"))


def inspire(payloads: DataFrame) -> DataFrame:
    m = F.col("m")
    df = answered(payloads).select("id", F.from_json("body", _INSPIRE)["metadata"].alias("m")).filter("m is not null")
    p = _first(m["publication_info"])
    year = F.coalesce(p["year"].cast("string"), F.substring(m["earliest_date"], 1, 4))
    pages = F.when(p["artid"].isNull(), p["page_start"])
    return _record(df, "inspire", title=_first(m["titles"])["title"], authors=F.transform(m["authors"], lambda a: a["full_name"]), year=year, volume=p["journal_volume"], number=p["journal_issue"], pages=pages, journal=p["journal_title"], document_type=_first(m["document_type"]), abstract=_first(m["abstracts"])["value"])


def open_library(payloads: DataFrame) -> DataFrame:
    b = F.col("b")
    df = answered(payloads).select("id", F.from_json("body", _OPENLIBRARY).alias("b")).filter("b.title is not null")
    return _record(df, "isbn", title=b["title"], year=F.regexp_extract(b["publish_date"], "([0-9]{4})", 1), journal=_first(b["publishers"]))


def arxiv(payloads: DataFrame) -> DataFrame:
    """Atom bodies; a feed without an entry gives no row."""
    body = F.regexp_extract("body", r"(?s)<entry>(.*?)</entry>", 1)
    df = answered(payloads).select("id", body.alias("e")).filter("e <> ''")
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<(?:arxiv:)?{t}\b[^>]*>(.*?)</", 1), r"\s+", " "))
    names = F.regexp_extract_all("e", F.lit(r"(?s)<author>\s*<name>(.*?)</name>"), 1)
    return _record(df, "arxiv", title=tag("title"), authors=names, year=F.substring(tag("published"), 1, 4), journal=F.nullif(tag("journal_ref"), F.lit("")), doi=F.nullif(tag("doi"), F.lit("")), document_type=F.lit("preprint"), abstract=tag("summary"))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line a key; whole-table rewrite, which the committer makes visible at once."""
    results.write.mode("overwrite").json(path)


def read_results(spark, path: str, schema: str) -> DataFrame:
    """Rows of a log; torn and blank lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
