"""Queries of the engine on the provided tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import citations, compare, rules, status, windows
from ..streaming import resume
from . import audit as A
from . import derived as D
from . import planted

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, on_derived: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (D.SQL if on_derived else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE = "list_element(string_split(coalesce(text, ''), chr(10)), 1)"


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("line"))


_KEY = "trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _plain_key(c):
    """Letters and digits of the line; other characters part words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


@query(f"""WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents), k AS (SELECT doc_id, {_KEY} AS k FROM l)
SELECT doc_id, first_doc FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) AS first_doc FROM k WHERE k <> '') WHERE doc_id <> first_doc""")
def title_key_dups(spark, sf_dir):
    """Documents whose first line has the key of an earlier document's, with that document.

    The smallest id is an aggregate with map-side combining, so a key that many documents share isn't one task.
    """
    keys = first_lines(spark, sf_dir).select("doc_id", _plain_key(F.col("line")).alias("k")).filter("k <> ''")
    return keys.join(keys.groupBy("k").agg(F.min("doc_id").alias("first_doc")), "k").filter("doc_id <> first_doc").select("doc_id", "first_doc")


@query(f"""WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents), w AS (SELECT doc_id, regexp_extract_all(line, '([A-Za-z]{{2,}})', 1) AS ws FROM l)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words FROM w WHERE len(ws) >= 4 AND len([x FOR x IN ws IF x = upper(x)]) >= 0.6 * len(ws)""")
def miscased_titles(spark, sf_dir):
    rows = first_lines(spark, sf_dir).filter(T.miscased(F.col("line")))
    return rows.select("doc_id", F.size(F.regexp_extract_all("line", F.lit(r"([A-Za-z]{2,})"), 1)).cast("long").alias("n_words"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '&(?:[A-Za-z]+|#[0-9]+);')) AS BIGINT) AS n_entities FROM pages WHERE html IS NOT NULL")
def html_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.regexp_count("html", F.lit("&(?:[A-Za-z]+|#[0-9]+);")).cast("long").alias("n_entities"))


@query("SELECT page_id, CAST(length(regexp_replace(html, '<[^<>]*>', '', 'g')) AS BIGINT) AS n_chars FROM pages WHERE html IS NOT NULL")
def strip_tags_len(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.length(F.regexp_replace("html", "<[^<>]*>", "")).cast("long").alias("n_chars"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://blog\\.') THEN 'blog' WHEN regexp_matches(url, '/(news|press|events?)(/|$)') THEN 'news'
WHEN regexp_matches(url, '\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(url, '(thesis|dissertation)[^/]*$') THEN 'thesis' ELSE 'other' END AS class FROM pages""")
def url_class(spark, sf_dir):
    u = F.col("url")
    kind = F.when(u.rlike(r"^https?://blog\."), "blog").when(u.rlike("/(?:news|press|events?)(?:/|$)"), "news").when(u.rlike(r"\.pdf(?:$|[?#])"), "pdf").when(u.rlike("(?:thesis|dissertation)[^/]*$"), "thesis")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(kind, F.lit("other")).alias("class"))


@query("""SELECT conv_id, turn, string_agg(coalesce(text, ''), ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations""")
def context_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" | ", F.lag(own).over(w), own, F.lead(own).over(w)).alias("context"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def uncovered_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def covered_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT key, field, category FROM (
SELECT key, 'journal' AS field, 'missing_field' AS category FROM flat WHERE etype = 'article' AND journal = ''
UNION ALL SELECT key, 'booktitle', 'missing_field' FROM flat WHERE etype = 'inproceedings' AND booktitle = ''
UNION ALL SELECT key, 'year', 'missing_recommended' FROM flat WHERE year = '')""", True)
def required_fields(spark, sf_dir):
    return rules.entry_findings(D.entries(spark, sf_dir), only=["required_fields"]).select("key", "field", "category")


@query("""SELECT key FROM (SELECT key, isbn, list_sum([CAST(isbn[i] AS BIGINT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 14)]) AS t FROM flat WHERE isbn <> '') WHERE t % 10 <> 0""", True)
def checksum_isbn(spark, sf_dir):
    return rules.entry_findings(D.entries(spark, sf_dir), only=["identifier_formats"]).filter("field = 'isbn'").select("key")


@query("SELECT s_suppkey, s % 11 = 0 AS valid FROM (SELECT s_suppkey, list_sum([CAST(lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0')[i] AS BIGINT) * (9 - i) FOR i IN range(1, 9)]) AS s FROM supplier)")
def checksum_issn(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.issn_valid(F.lpad((F.col("s_suppkey") * 7919 % 100000000).cast("string"), 8, "0")).alias("valid"))


@query("""SELECT f.key, d.source, d.field FROM flat f JOIN (
SELECT r.entry_seq, r.source, 'year' AS field FROM recs r JOIN flat g USING (entry_seq) WHERE g.year <> '' AND r.year <> g.year
UNION ALL SELECT r.entry_seq, r.source, 'volume' FROM recs r JOIN flat g USING (entry_seq) WHERE r.volume <> g.volume
UNION ALL SELECT r.entry_seq, r.source, 'pages' FROM recs r JOIN flat g USING (entry_seq) WHERE r.pages IS NOT NULL AND r.pages <> replace(g.pages, '--', '-')) d USING (entry_seq)""", True)
def soft_field_diffs(spark, sf_dir):
    return compare.soft_field_diffs(D.entries(spark, sf_dir), D.records(spark, sf_dir)).select("key", "source", "field")


@query("SELECT f.key, r.source, 'year' AS field, r.year AS suggested FROM flat f JOIN recs r USING (entry_seq) WHERE f.year = '' AND r.source = 'crossref'", True)
def parity_suggestions(spark, sf_dir):
    return compare.missing_fields(D.entries(spark, sf_dir), D.records(spark, sf_dir).filter("source = 'crossref'")).select("key", "source", "field", "suggested")


@query("""SELECT f.key, 'year' AS field, a.year AS value_a, b.year AS value_b FROM flat f JOIN recs a ON a.entry_seq = f.entry_seq AND a.ord = 0 JOIN recs b ON b.entry_seq = f.entry_seq AND b.ord = 1
WHERE a.year <> b.year AND f.year <> a.year AND f.year <> b.year
UNION ALL SELECT f.key, 'volume', a.volume, b.volume FROM flat f JOIN recs a ON a.entry_seq = f.entry_seq AND a.ord = 0 JOIN recs b ON b.entry_seq = f.entry_seq AND b.ord = 1
WHERE a.volume <> b.volume AND f.volume <> a.volume AND f.volume <> b.volume""", True)
def cross_source_conflicts(spark, sf_dir):
    return compare.cross_source_conflicts(D.entries(spark, sf_dir), D.records(spark, sf_dir)).select("key", "field", "value_a", "value_b")


@query("SELECT key FROM flat WHERE doi <> '' AND entry_seq % 19 = 0 AND c % 7 <> entry_seq % 7", True)
def first_author_differs(spark, sf_dir):
    found = compare.author_diffs(D.entries(spark, sf_dir), D.records(spark, sf_dir).filter("source = 'crossref'"))
    return found.filter("first_differs").select("key")


@query("SELECT entry_seq, key FROM (SELECT entry_seq, key, row_number() OVER (PARTITION BY key ORDER BY entry_seq) AS n FROM flat) WHERE n > 1", True)
def duplicate_key(spark, sf_dir):
    return windows.duplicate_keys(D.entries(spark, sf_dir)).select("entry_seq", "key")


@query("SELECT entry_seq, key, first_key FROM (SELECT entry_seq, key, first(key) OVER w AS first_key, row_number() OVER w AS n FROM flat WHERE doi <> '' WINDOW w AS (PARTITION BY doi ORDER BY entry_seq)) WHERE n > 1", True)
def duplicate_doi(spark, sf_dir):
    return windows.duplicate_dois(D.entries(spark, sf_dir)).select("entry_seq", "key", "first_key")


@query("""SELECT entry_seq, key, first_key FROM (SELECT entry_seq, key, first(key) OVER w AS first_key, row_number() OVER w AS n FROM flat WINDOW w AS (PARTITION BY title, year, split_part(author, ',', 1) ORDER BY entry_seq)) x
WHERE n > 1 AND entry_seq NOT IN (SELECT entry_seq FROM (SELECT entry_seq, row_number() OVER (PARTITION BY doi ORDER BY entry_seq) AS n FROM flat WHERE doi <> '') WHERE n > 1)""", True)
def duplicate_fingerprint(spark, sf_dir):
    return windows.duplicate_works(D.entries(spark, sf_dir)).select("entry_seq", "key", "first_key")


_CITED = "(SELECT DISTINCT l_suppkey AS g, 'o' || CASE WHEN l_orderkey % 101 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS key FROM lineitem)"


def _cited(spark, sf_dir):
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.concat(F.lit("o"), F.when(k % 101 == 0, -1 - k).otherwise(k).cast("string")).alias("key")).distinct()


@query(f"SELECT DISTINCT key FROM {_CITED} WHERE key NOT IN (SELECT key FROM flat)", True)
def dropped_citations(spark, sf_dir):
    return citations.dropped(_cited(spark, sf_dir), D.flat(spark, sf_dir))


@query(f"SELECT key, entry_seq FROM flat WHERE key NOT IN (SELECT key FROM {_CITED})", True)
def uncited_entries(spark, sf_dir):
    return citations.uncited(D.flat(spark, sf_dir), _cited(spark, sf_dir)).select("key", "entry_seq")


@query("""SELECT l_orderkey AS group_id FROM (SELECT l_orderkey, l_linenumber, y, lag(y) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before
FROM (SELECT l_orderkey, l_linenumber, min(1990 + l_suppkey % 20) AS y FROM lineitem GROUP BY ALL)) GROUP BY l_orderkey HAVING count(*) FILTER (WHERE before > y) > 0""")
def citation_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min((1990 + F.col("l_suppkey") % 20).cast("int")).alias("y"))
    groups = lines.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("y").cast("string").alias("k")))), lambda x: x["k"]).alias("keys"))
    years = spark.range(1990, 2010).select(F.col("id").cast("string").alias("key"), F.col("id").cast("int").alias("year"))
    return citations.out_of_order(groups, years).select("group_id")


@query("""SELECT s_suppkey AS id, form, distance FROM (SELECT s_suppkey, form, levenshtein(lower(v), lower(form)) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY levenshtein(lower(v), lower(form)), length(form), form) AS n
FROM (SELECT s_suppkey, substr('NamekXyz', CAST(s_suppkey % 5 + 1 AS INT)) || (s_suppkey * 37) AS v FROM supplier), (SELECT DISTINCT substr('namexyz', CAST(n_nationkey % 4 + 1 AS INT)) || (n_nationkey * 91) AS form FROM nation)) WHERE n = 1""")
def closest_form(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.expr("substr('NamekXyz', int(s_suppkey % 5 + 1))"), (F.col("s_suppkey") * 37).cast("string")).alias("value"))
    forms = table(spark, sf_dir, "nation").select(F.concat(F.expr("substr('namexyz', int(n_nationkey % 4 + 1))"), (F.col("n_nationkey") * 91).cast("string")).alias("form")).distinct()
    return compare.closest_form(values, forms).select("id", "form", F.col("distance").cast("long").alias("distance"))


@query("""WITH h AS (SELECT f.entry_seq AS id, r.i AS rank, CASE WHEN (f.entry_seq + r.i) % 3 = 0 THEN f.title ELSE 'Other matter ' || r.i END AS t, f.y + (f.entry_seq + r.i) % 5 AS hy FROM flat f, (SELECT unnest(range(1, 5)) AS i) r)
SELECT id, min(rank) AS rank FROM h JOIN flat f ON f.entry_seq = h.id WHERE h.t = f.title AND hy - f.y <= 3 GROUP BY id""".replace("WITH h AS", ", h AS"), True)
def doi_search_accept(spark, sf_dir):
    rows = D.flat(spark, sf_dir).select("entry_seq", "title", F.split_part("author", F.lit(","), F.lit(1)).alias("name"), "y", "doi")
    rows = T.once(rows, surname=T.fold_surname(F.col("name")))
    wanted = rows.select(F.col("entry_seq").alias("id"), "title", "surname", F.col("y").alias("year"))
    rank = F.explode(F.sequence(F.lit(1), F.lit(4)))
    hits = rows.select("*", rank.alias("i")).select(
        F.col("entry_seq").alias("id"), F.col("i").cast("long").alias("rank"), F.when((F.col("entry_seq") + F.col("i")) % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("Other matter "), F.col("i").cast("string"))).alias("title"),
        "surname", (F.col("y") + (F.col("entry_seq") + F.col("i")) % 5).alias("year"), "doi",
    )
    return compare.accepted_hits(wanted, hits).select("id", "rank")


_CLASSIFIED = """, cats AS (
  SELECT f.entry_seq, f.key, f.doi <> '' AS has_id, (SELECT count(*) FROM recs r WHERE r.entry_seq = f.entry_seq) AS sources,
    EXISTS (SELECT 1 FROM recs r WHERE r.entry_seq = f.entry_seq AND ((f.year <> '' AND r.year <> f.year) OR r.volume <> f.volume OR (f.etype <> 'book' AND r.pages IS NOT NULL AND r.pages <> replace(f.pages, '--', '-'))))
      OR (f.doi <> '' AND f.entry_seq % 23 = 0 AND NOT (f.entry_seq % 19 = 0 AND f.c % 7 <> f.entry_seq % 7))
      OR (f.doi <> '' AND f.entry_seq % 19 = 0 AND f.c % 7 <> f.entry_seq % 7) AS mm,
    (SELECT count(*) FROM recs a JOIN recs b ON a.entry_seq = b.entry_seq AND a.ord < b.ord WHERE a.entry_seq = f.entry_seq AND a.year <> b.year AND f.year <> a.year AND f.year <> b.year)
      + (SELECT count(*) FROM recs a JOIN recs b ON a.entry_seq = b.entry_seq AND a.ord < b.ord WHERE a.entry_seq = f.entry_seq AND a.volume <> b.volume AND f.volume <> a.volume AND f.volume <> b.volume) AS sc,
    f.doi <> '' AND f.entry_seq % 437 = 0 AND f.c % 7 <> f.entry_seq % 7 AS wrong,
    (f.etype = 'book' AND f.isbn = '' AND f.doi = '' OR f.etype IN ('article', 'inproceedings') AND f.doi = '') AND (f.year = '' OR f.year >= '2005') AS nopid
  FROM flat f
), st AS (
  SELECT *, CASE WHEN wrong THEN 'mismatch' WHEN sources = 0 THEN 'unverified' ELSE 'verified' END AS status,
    CASE WHEN sources = 0 AND has_id THEN 0.1 WHEN sources = 0 THEN 0.2 WHEN wrong THEN 0.3 WHEN sc > 0 THEN 0.7 WHEN mm THEN 0.75 WHEN sources = 1 THEN 0.95 ELSE 1.0 END AS confidence
  FROM cats
)
"""


@query(_CLASSIFIED + "SELECT entry_seq, status, CAST(confidence AS DOUBLE) AS confidence FROM st", True)
def classify_status(spark, sf_dir):
    return A.audit(D.entries(spark, sf_dir), D.records(spark, sf_dir)).entries.select("entry_seq", "status", "confidence")


@query(_CLASSIFIED + """, dup AS (
  SELECT (SELECT count(*) - count(DISTINCT key) FROM flat) + (SELECT count(*) - count(DISTINCT doi) FROM flat WHERE doi <> '') + (SELECT count(*) FROM (
    SELECT entry_seq, row_number() OVER (PARTITION BY title, year, split_part(author, ',', 1) ORDER BY entry_seq) AS n FROM flat) WHERE n > 1 AND entry_seq NOT IN
    (SELECT entry_seq FROM (SELECT entry_seq, row_number() OVER (PARTITION BY doi ORDER BY entry_seq) AS n FROM flat WHERE doi <> '') WHERE n > 1)) AS d
)
SELECT count(*) AS checked, count(*) FILTER (WHERE status = 'verified' AND NOT (mm OR sc > 0)) AS verified, count(*) FILTER (WHERE status = 'verified' AND (mm OR sc > 0)) AS verified_with_caveat,
  count(*) FILTER (WHERE status = 'unverified') AS unverified, count(*) FILTER (WHERE wrong) AS mismatch, max(d) AS duplicates, CAST(sum(sc) AS BIGINT) AS source_conflicts,
  round_even(CAST(count(*) FILTER (WHERE has_id) AS DOUBLE) / count(*), 3) AS doi_coverage,
  CAST(round_even(greatest(CAST(sum(CASE WHEN wrong THEN 20 WHEN status = 'unverified' THEN 30 WHEN mm THEN 80 WHEN nopid THEN 85 ELSE 100 END) AS DOUBLE) / count(*) - 10 * max(d), 0), 0) AS INTEGER) AS integrity_score,
  CAST(round_even(CAST(sum(CASE WHEN wrong THEN 30 WHEN status = 'unverified' THEN 10 ELSE 100 END) AS DOUBLE) / count(*), 0) AS INTEGER) AS confidence_score
FROM st, dup""", True)
def integrity_summary(spark, sf_dir):
    return A.audit(D.entries(spark, sf_dir), D.records(spark, sf_dir)).summary


@query("""SELECT entry_seq, key, field, category, severity FROM (
SELECT entry_seq, key, 'year' AS field, 'missing_recommended' AS category, 'error' AS severity FROM flat WHERE year = ''
UNION ALL SELECT entry_seq, key, 'journal', 'missing_field', 'error' FROM flat WHERE etype = 'article' AND journal = ''
UNION ALL SELECT entry_seq, key, 'booktitle', 'missing_field', 'error' FROM flat WHERE etype = 'inproceedings' AND booktitle = '')""", True)
def severity_override(spark, sf_dir):
    """A caller's pin turns the recommendation about years into an error."""
    found = rules.entry_findings(D.entries(spark, sf_dir), only=["required_fields"])
    return status.pinned(found, {"missing_recommended": "error"}).select("entry_seq", "key", "field", "category", "severity")


@query("SELECT entry_seq, field FROM (SELECT entry_seq, 'journal' AS field FROM flat WHERE etype = 'article' AND journal = '' UNION ALL SELECT entry_seq, 'booktitle' FROM flat WHERE etype = 'inproceedings' AND booktitle = '' UNION ALL SELECT entry_seq, 'year' FROM flat WHERE year = '')", True)
def supersede_live(spark, sf_dir):
    """Findings that no declared edge withdraws; a missing field isn't withdrawn by a record."""
    entries = D.entries(spark, sf_dir)
    found = rules.entry_findings(entries, only=["required_fields"])
    asked = entries.select("file_id", "entry_seq", F.explode(F.array(F.lit("missing_field"), F.lit("missing_locator"))).alias("category"))
    return status.live(status.stamped(found, asked)).select("entry_seq", "field")


@query("SELECT category, \"group\", pinned FROM (VALUES " + ", ".join(f"('{c}', '{g}', {repr(p) if p else 'NULL'})" for c, g, p in C.categories()) + ") AS t(category, \"group\", pinned)")
def catalog_rows(spark, sf_dir):
    return C.catalog(spark).select("category", "group", "pinned")


@query("""SELECT o_orderkey AS entry_seq, CASE WHEN o_orderkey % 3 = 0 THEN 'offline online llm' WHEN o_orderkey % 4 = 0 THEN 'offline online llm' WHEN o_orderkey % 4 = 1 THEN 'online llm' ELSE 'llm' END AS todo
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 <> 3""")
def phase_todo(spark, sf_dir):
    """Phases left of entries with saved results: a changed text asks for all, rating asks for the record phase first."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k.alias("entry_seq"), k.cast("string").alias("key"), F.concat(F.lit("text "), k.cast("string")).alias("raw"))
    phases = F.array(*map(F.lit, ("offline", "online", "llm")))
    done = own.select("key", F.sha2(F.when(F.col("entry_seq") % 3 == 0, "an older text").otherwise(F.col("raw")), 256).alias("raw_hash"), F.slice(phases, F.lit(1), (F.col("entry_seq") % 4).cast("int")).alias("done"))
    todo = resume.needed(own.select("key", "raw"), done, ["offline", "llm"]).filter(F.size("todo") > 0)
    in_order = F.array_join(F.array_intersect(phases, "todo"), " ")
    return todo.select(F.col("key").cast("long").alias("entry_seq"), in_order.alias("todo"))


@query("""WITH l AS (SELECT DISTINCT lower(regexp_replace(list_element(string_split(coalesce(text, ''), chr(10)), 1), '[^A-Za-z0-9 ]', ' ', 'g')) AS line FROM documents),
w AS (SELECT line, list_distinct([x FOR x IN string_split(line, ' ') IF x <> '']) AS ws FROM l), b AS (SELECT item_id, list_distinct([x FOR x IN string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g')), ' ') IF x <> '']) AS ws FROM benchmark)
SELECT b.item_id, count(*) AS n FROM b JOIN w ON len(list_intersect(b.ws, w.ws)) >= 0.2 * len(list_distinct(list_concat(b.ws, w.ws))) AND len(w.ws) > 0 AND len(b.ws) > 0 GROUP BY b.item_id""")
def jaccard_pairs(spark, sf_dir):
    """Benchmark items against the distinct first lines of documents (a line stands for a title): lines that share a fifth of the words.

    Words are joined, and shared words counted, so no line meets an item with which it shares nothing.
    """
    plain = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9 ]", " ")), " "), lambda x: x != ""))
    lines = first_lines(spark, sf_dir).select(F.lower(F.regexp_replace("line", "[^A-Za-z0-9 ]", " ")).alias("line")).distinct().select(F.xxhash64("line").alias("id"), plain(F.col("line")).alias("ws"))
    items = table(spark, sf_dir, "benchmark").select("item_id", plain(F.coalesce("text", F.lit(""))).alias("bs"))
    a = items.select("item_id", F.size("bs").alias("nb"), F.explode("bs").alias("w"))
    b = lines.select("id", F.size("ws").alias("nw"), F.explode("ws").alias("w"))
    met = a.join(b, "w").groupBy("item_id", "id", "nb", "nw").agg(F.count(F.lit(1)).alias("both"))
    return met.filter(F.col("both") >= 0.2 * (F.col("nb") + F.col("nw") - F.col("both"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES.update(planted.QUERIES)
ORACLES.update(planted.ORACLES)
