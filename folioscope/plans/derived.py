"""A bibliography derived from the order tables by plain arithmetic, in Spark and as SQL, with planted defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NAMES = ["Adams", "Baker", "Clark", "Davis", "Evans", "Frank", "Gauss"]
FLAT = ["title", "author", "year", "journal", "booktitle", "volume", "pages", "doi", "isbn", "publisher"]

#: The same rows for DuckDB; ``flat`` and ``recs`` are the names of the derived tables.
SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(year(o_orderdate) AS BIGINT) AS y, lower(substr(o_orderpriority, 3)) AS p, o_orderkey % 4 AS m FROM orders
), digits AS (
  SELECT *, '978' || lpad(CAST(k AS VARCHAR), 9, '0') AS d12 FROM base
), checks AS (
  SELECT *, (10 - (list_sum([CAST(d12[i] AS BIGINT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10)) % 10 AS cd FROM digits
), flat AS (
  SELECT k AS entry_seq, 'o' || CASE WHEN k % 211 = 210 THEN k - 1 ELSE k END AS key,
    CASE WHEN m <= 1 THEN 'article' WHEN m = 2 THEN 'book' ELSE 'inproceedings' END AS etype,
    'Study of ' || p || ' flow in case ' || (c % 50) AS title,
    ['Adams', 'Baker', 'Clark', 'Davis', 'Evans', 'Frank', 'Gauss'][CAST(c % 7 AS INT) + 1] || ', A. and ' || ['Adams', 'Baker', 'Clark', 'Davis', 'Evans', 'Frank', 'Gauss'][CAST(k % 7 AS INT) + 1] || ', B.' AS author,
    CASE WHEN k % 31 = 0 THEN '' ELSE CAST(y AS VARCHAR) END AS year,
    CASE WHEN m <= 1 AND k % 5 <> 4 THEN 'Journal of Orders' ELSE '' END AS journal,
    CASE WHEN m = 3 AND k % 6 <> 5 THEN 'Proceedings of Orders' ELSE '' END AS booktitle,
    CAST(k % 90 + 1 AS VARCHAR) AS volume,
    ((k * 7) % 900 + 1) || '--' || ((k * 7) % 900 + 1 + k % 20) AS pages,
    CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN '10.5555/o' || (k - 1) ELSE '10.5555/o' || k END AS doi,
    CASE WHEN m = 2 THEN d12 || CASE WHEN k % 9 = 0 THEN (cd + 1) % 10 ELSE cd END ELSE '' END AS isbn,
    CASE WHEN m = 2 THEN 'House' ELSE '' END AS publisher, y, c
  FROM checks
), recs AS (
  SELECT entry_seq, 'crossref' AS source, 0 AS ord, CAST(y + CASE WHEN entry_seq % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS year, volume,
    ((entry_seq * 7) % 900 + 1 + CASE WHEN entry_seq % 11 = 0 THEN 1 ELSE 0 END) || '-' || ((entry_seq * 7) % 900 + 1 + entry_seq % 20 + CASE WHEN entry_seq % 11 = 0 THEN 1 ELSE 0 END) AS pages
  FROM flat WHERE doi <> ''
  UNION ALL
  SELECT entry_seq, 'datacite', 1, CAST(y + CASE WHEN entry_seq % 21 = 0 THEN 2 ELSE 0 END AS VARCHAR), CAST(entry_seq % 90 + 1 + CASE WHEN entry_seq % 29 = 0 THEN 3 ELSE 0 END AS VARCHAR), NULL
  FROM flat WHERE doi <> '' AND entry_seq % 3 = 0
)
"""


def _text(c: Column) -> Column:
    return c.cast("string")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file may be one row group, which one task reads: the rows are dealt out before any work on them
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate").cast("long")
    m = k % 4
    d12 = F.concat(F.lit("978"), F.lpad(_text(k), 9, "0"))
    total = sum((F.substring(d12, i, 1).cast("long") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    cd = (10 - total % 10) % 10
    name = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), (n % 7 + 1).cast("int"))
    start = (k * 7) % 900 + 1
    return o.select(
        F.lit("orders.bib").alias("file_id"),
        k.alias("entry_seq"),
        F.concat(F.lit("o"), _text(F.when(k % 211 == 210, k - 1).otherwise(k))).alias("key"),
        F.when(m <= 1, "article").when(m == 2, "book").otherwise("inproceedings").alias("etype"),
        F.concat(F.lit("Study of "), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(" flow in case "), _text(c % 50)).alias("title"),
        F.concat(name(c), F.lit(", A. and "), name(k), F.lit(", B.")).alias("author"),
        F.when(k % 31 == 0, "").otherwise(_text(y)).alias("year"),
        F.when((m <= 1) & (k % 5 != 4), "Journal of Orders").otherwise("").alias("journal"),
        F.when((m == 3) & (k % 6 != 5), "Proceedings of Orders").otherwise("").alias("booktitle"),
        _text(k % 90 + 1).alias("volume"),
        F.concat(_text(start), F.lit("--"), _text(start + k % 20)).alias("pages"),
        F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat(F.lit("10.5555/o"), _text(k - 1))).otherwise(F.concat(F.lit("10.5555/o"), _text(k))).alias("doi"),
        F.when(m == 2, F.concat(d12, _text(F.when(k % 9 == 0, (cd + 1) % 10).otherwise(cd)))).otherwise("").alias("isbn"),
        F.when(m == 2, "House").otherwise("").alias("publisher"),
        y.alias("y"),
        c.alias("c"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows as parsed entries."""
    rows = flat(spark, sf_dir)
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in FLAT]), lambda x: x["value"] != "")
    rows = T.once(rows.select("file_id", "entry_seq", "key", "etype", pairs.alias("occurrences")), fields=F.map_from_entries("occurrences"))
    return rows.select(
        "file_id", "entry_seq", "key", "etype", "fields", "occurrences",
        F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<int>))").alias("field_lines"), F.col("entry_seq").cast("int").alias("lineno"), F.lit("").alias("raw"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat(spark, sf_dir).filter("doi <> ''")
    k = F.col("entry_seq")
    start = (k * 7) % 900 + 1 + F.when(k % 11 == 0, 1).otherwise(0)
    name = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), (n % 7 + 1).cast("int"))
    swap = k % 19 == 0
    own, other = name(F.col("c")), name(k)
    one = rows.select(
        "file_id", "entry_seq", F.lit("crossref").alias("source"), F.lit(0).alias("ord"), F.when(k % 23 == 0, "Unlike matter altogether").otherwise(F.col("title")).alias("title"),
        F.array(F.when(swap, other).otherwise(own), F.when(swap, own).otherwise(other)).alias("authors"),
        _text(F.col("y") + F.when(k % 7 == 0, 1).otherwise(0)).alias("year"), "volume", F.lit(None).cast("string").alias("number"),
        F.concat(_text(start), F.lit("-"), _text(start + k % 20)).alias("pages"), "journal", "doi",
    )
    two = rows.filter(k % 3 == 0).select(
        "file_id", "entry_seq", F.lit("datacite").alias("source"), F.lit(1).alias("ord"), "title", F.array(own, other).alias("authors"),
        _text(F.col("y") + F.when(k % 21 == 0, 2).otherwise(0)).alias("year"), _text(k % 90 + 1 + F.when(k % 29 == 0, 3).otherwise(0)).alias("volume"),
        F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("pages"), "journal", "doi",
    )
    return one.unionByName(two)
