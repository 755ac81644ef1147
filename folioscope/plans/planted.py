"""Queries over planted cases: every order stands for one of a list of cases, whose outcome is written down by hand.

The Spark side builds entries (or values) from the cases and runs the operator; the SQL joins the orders with the
written outcomes and knows nothing of the operator.  Each list holds cases that hit and look-alikes that don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, resolve, rules, windows

#: By rule: (type, fields, outcomes); an outcome is (category, field), the field empty where the finding has none.
#: The pseudo field ``raw`` is the text of the entry.
RULES: dict[str, list[tuple[str, dict[str, str], list[tuple[str, str]]]]] = {
    "misplaced_field": [
        ("article", {"journal": "42"}, [("misplaced_field", "journal")]), ("article", {"number": "1999"}, [("misplaced_field", "number")]), ("article", {"number": "12-03-1999"}, [("misplaced_field", "number")]),
        ("article", {"journal": "Physics 42", "number": "12"}, []), ("article", {"issue": "2004-05-06"}, [("misplaced_field", "issue")]),
    ],
    "entry_type_known": [("article", {}, []), ("artcle", {}, [("syntax", "")]), ("phdthesis", {}, []), ("inprocedings", {}, [("syntax", "")]), ("www", {}, [])],
    "biblatex_field_validity": [("article", {"journal": "J", "title": "T"}, []), ("article", {"booktitle": "B"}, [("biblatex_validity", "")]), ("book", {"pagetotal": "9"}, []), ("online", {"volume": "3"}, [("biblatex_validity", "")])],
    "legacy_month": [("article", {"month": "jan"}, []), ("article", {"month": "January"}, [("style", "month")]), ("article", {"month": "mar", "raw": "month = {mar}"}, [("style", "month")]), ("article", {"month": "7"}, [])],
    "year_sanity": [
        ("article", {"year": "1999"}, []), ("article", {"year": "1066"}, [("identifier_format", "year")]), ("article", {"year": "to appear"}, [("identifier_format", "year")]), ("article", {"date": "2001-05"}, []),
        ("article", {"year": "2003a"}, [("style", "year")]), ("article", {"date": "someday"}, [("identifier_format", "date")]),
    ],
    "title_caps": [
        ("article", {"title": "A study of DNA in cells"}, [("title_capitalization", "title")]), ("article", {"title": "A study of {DNA} in cells"}, []), ("article", {"title": "FLOW OF WATER UNDER LARGE STONES"}, [("title_case", "title")]),
        ("article", {"title": "The pH of rain"}, [("title_capitalization", "title")]), ("article", {"title": "Water under stones"}, []),
    ],
    "title_punctuation": [("article", {"title": "Rivers of the north."}, [("style", "title")]), ("article", {"title": "Rivers and so on..."}, []), ("article", {"title": "The papers of Miller et al."}, []), ("article", {"title": "{Rivers.}"}, [("style", "title")]), ("article", {"title": "Rivers"}, [])],
    "truncated_authors": [
        ("article", {"author": "Miller, A. et al."}, [("author_completeness", "author")]), ("article", {"author": "Miller, A. and others"}, [("author_truncated_marker", "author")]), ("article", {"author": "Miller, A. and Alder, B."}, []),
        ("book", {"editor": "Alder, B. and others"}, [("author_truncated_marker", "editor")]), ("article", {"author": "Etal, Maria"}, []),
    ],
    "glued_and_separator": [("article", {"author": "Miller, A.and Alder, B."}, [("author_format", "author")]), ("article", {"author": "Miller, A. and Alder, B."}, []), ("article", {"author": "Anderson, Sandra"}, [])],
    "shouted_authors": [("article", {"author": "MILLER, Anna"}, [("author_format", "author")]), ("article", {"author": "MILLER, Anna and ALDER, Ben"}, [("author_format", "author")]), ("article", {"author": "CERN, Anna and Alder, Ben"}, []), ("article", {"author": "Miller, A."}, [])],
    "marker_in_author_name": [("article", {"author": "Miller1, Anna"}, [("author_format", "author")]), ("article", {"author": "Miller, Anna*"}, [("author_format", "author")]), ("article", {"author": "Miller, Anna and Alder, Ben"}, []), ("article", {"author": "Miller\\hspace{2pt}, Anna"}, [("author_format", "author")])],
    "encoding": [("article", {"raw": "plain text"}, []), ("article", {"raw": "MÃ¼ller"}, [("encoding", "")]), ("article", {"raw": "Müller"}, []), ("article", {"raw": "a​b"}, [("encoding", "")]), ("article", {"raw": "lost � sign"}, [("encoding", "")])],
    "page_dashes": [("article", {"pages": "1--9"}, []), ("article", {"pages": "1-9"}, [("style", "pages")]), ("article", {"pages": "1–9"}, [("style", "pages")]), ("article", {"pages": "e12-a"}, []), ("article", {"pages": "17"}, [])],
    "page_sanity": [("article", {"pages": "90--12"}, [("style", "pages")]), ("article", {"pages": "190--8"}, []), ("article", {"pages": "xii--xv"}, []), ("article", {"pages": "forthcoming"}, [("style", "pages")]), ("article", {"pages": "S12--S19"}, []), ("article", {"pages": "12--90"}, [])],
    "numpages_agreement": [("article", {"pages": "1--9", "numpages": "9"}, []), ("article", {"pages": "1--9", "numpages": "8"}, [("style", "numpages")]), ("article", {"pages": "e12", "numpages": "8"}, [])],
    "arxiv_consistency": [
        ("article", {"eprint": "2001.01234", "journal": "arXiv:2001.01234"}, []), ("article", {"eprint": "2001.01234", "journal": "arXiv:2001.09999"}, [("identifier_format", "eprint")]), ("article", {"journal": "ArXiv e-prints 2001.01234"}, [("style", "journal")]),
        ("article", {"journal": "arXiv"}, [("style", "journal")]), ("article", {"journal": "Physics"}, []), ("article", {"eprint": "2001.01234", "doi": "10.48550/arXiv.2001.05555"}, [("identifier_format", "eprint")]),
    ],
    "identifier_in_url": [
        ("article", {"url": "https://doi.org/10.5555/abc"}, [("identifier_placement", "doi")]), ("article", {"url": "https://doi.org/10.5555/abc", "doi": "10.5555/abc"}, []), ("article", {"url": "https://arxiv.org/abs/2001.01234"}, [("identifier_placement", "eprint")]),
        ("article", {"url": "https://example.org/10.5555/abc"}, []), ("article", {"url": "https://arxiv.org/abs/2001.01234", "eprint": "2001.01234"}, []),
    ],
    "online_needs_urldate": [
        ("online", {"url": "https://example.org/a"}, [("style", "urldate")]), ("online", {"url": "https://example.org/a", "urldate": "2020-01-01"}, []), ("article", {"url": "https://blog.example.org/a"}, [("style", "urldate")]), ("article", {"url": "https://example.org/a"}, []),
        ("misc", {"url": "https://example.org/news/a", "doi": "10.5555/abc"}, []),
    ],
    "doi_format": [
        ("article", {"doi": "10.5555/abc"}, []), ("article", {"doi": "https://doi.org/10.5555/abc"}, [("style", "doi")]), ("article", {"doi": "doi:10.5555/abc"}, [("style", "doi")]), ("article", {"doi": "5555/abc"}, [("identifier_format", "doi")]),
        ("article", {"doi": "10.5555/abc."}, [("identifier_format", "doi")]), ("article", {"doi": "10.5555/ABC"}, []), ("article", {}, []),
    ],
    "identifier_formats": [
        ("book", {"isbn": "9780306406157"}, []), ("book", {"isbn": "978-0-306-40615-7"}, []), ("book", {"isbn": "9780306406158"}, [("identifier_format", "isbn")]), ("book", {"isbn": "0-306-40615-2"}, []), ("article", {"issn": "0378-5955"}, []),
        ("article", {"issn": "0378-5956"}, [("identifier_format", "issn")]), ("book", {"isbn": "0378-5955"}, [("identifier_format", "isbn")]), ("article", {"orcid": "0000-0002-1825-0097"}, []), ("article", {"orcid": "0000-0002-1825-0098"}, [("identifier_format", "orcid")]),
    ],
    "required_fields": [
        ("thesis", {"author": "A", "title": "T", "type": "phd", "institution": "I", "year": "2000"}, []), ("phdthesis", {"author": "A", "title": "T", "school": "S", "year": "2000"}, []), ("thesis", {"author": "A", "title": "T", "type": "phd", "year": "2000"}, [("missing_field", "institution")]),
        ("online", {"title": "T"}, [("missing_field", "url")]), ("online", {"title": "T", "url": "u"}, []), ("book", {"title": "T", "editor": "E", "year": "2000"}, [("entrytype_suggestion", "author")]), ("inproceedings", {"title": "T", "author": "A", "crossref": "x"}, []),
        ("article", {"author": "A", "title": "T", "date": "2000", "journaltitle": "J", "volume": "1", "pages": "2"}, []), ("article", {"author": "A", "title": "T", "year": "2000", "eprint": "2001.01234"}, []), ("unheard", {"year": "2000"}, [("missing_field", "title")]),
    ],
}

_s = lambda f: lambda *c: f(*c).cast("string")
#: By name: the expression over the inputs, and cases of inputs and outcome (None for null).
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[tuple[tuple[str, ...], str | None]]]] = {
    "deaccent": (T.deaccent, [(("Müller",), "muller"), (("Æther",), "aether"), (("Straße",), "strasse"), (("Łódź",), "lodz"), (("plain",), "plain")]),
    "clean_tex": (T.clean_tex, [((r"G{\"o}del",), "Godel"), ((r"\emph{Late} nights",), "Late nights"), (("{DNA} and $x$",), "DNA and x"), ((r"Smith \& Sons",), "Smith & Sons"), (("a~b  c",), "a b c")]),
    "title_key": (T.title_key, [(("On the {DNA} of Cats: A Study",), "on the dna of cats a study"), (("Müller & Söhne",), "muller and sohne"), (("<i>In vitro</i> work",), "in vitro work"), (("---",), "")]),
    "bare_doi": (T.bare_doi, [(("https://doi.org/10.5555/ABC",), "10.5555/abc"), (("doi: 10.5555/x",), "10.5555/x"), (("http://dx.doi.org/10.1/y",), "10.1/y"), ((" 10.5555/z ",), "10.5555/z")]),
    "doi_in": (T.doi_in, [(("see https://doi.org/10.5555/abc.",), "10.5555/abc"), (("none here",), ""), (("10.5555/a?b=1",), "10.5555/a")]),
    "arxiv_id": (T.arxiv_id, [(("arXiv:2001.01234v2",), "2001.01234"), (("hep-th/9901001",), "hep-th/9901001"), (("math.AG/0309136v1",), "math.AG/0309136"), (("no number",), "")]),
    "arxiv_version": (_s(T.arxiv_version), [(("2001.01234v2",), "2"), (("2001.01234",), None), (("hep-th/9901001v11",), "11")]),
    "authors": (lambda c: F.array_join(T.authors(c), "|"), [(("Adams, A. and Baker, B.",), "Adams, A.|Baker, B."), (("{Barnes and Noble} and Adams, A",), "{Barnes and Noble}|Adams, A"), (("Sandra Anderson",), "Sandra Anderson"), (("",), "")]),
    "surname": (T.surname, [(("Adams, Anna",), "Adams"), (("Anna Adams",), "Adams"), (("Anna Adams Jr.",), "Adams"), (("{The Team}",), "{The Team}"), (("van Dyke, Dick",), "van Dyke")]),
    "fold_surname": (T.fold_surname, [(("Müller, A.",), "muller"), (("Mueller, A.",), "muller"), (("O-Brien, C.",), "obrien"), ((r"G{\"o}del, K.",), "godel")]),
    "surname_match": (_s(T.surname_match), [(("dyke", "vandyke"), "true"), (("dyke", "dyke"), "true"), (("dyke", "dike"), "false"), (("", ""), "false"), (("dyke", "mcdyke"), "false")]),
    "truncated": (_s(T.truncated), [(("Adams et al.",), "true"), (("Adams and others",), "true"), (("Metal, Anna",), "false")]),
    "collaboration": (_s(T.collaboration), [(("{The ATLAS Collaboration}",), "true"), (("Adams, Anna",), "false"), (("Genome Consortium",), "true")]),
    "iso4": (_s(T.iso4), [(("J. Phys. Chem.", "Journal of Physical Chemistry"), "false"), (("Jour. Phys. Chem.", "Journal of Physical Chemistry"), "true"), (("Phys. Rev.", "Physical Review"), "true"), (("Phys. Rev.", "Chemical Review"), "false"), (("Nature", "Nature Physics"), "false")]),
    "web_source": (_s(T.web_source), [(("https://blog.example.org/x",), "true"), (("https://example.org/news/today",), "true"), (("https://example.org/newsletters",), "false"), (("https://example.org/a.pdf",), "true"), (("https://example.org/article",), "false")]),
    "thesis_url": (_s(T.thesis_url), [(("https://example.edu/theses/12",), "true"), (("https://example.edu/my-dissertation.pdf",), "true"), (("https://example.edu/paper",), "false")]),
    "isbn_in": (T.isbn_in, [(("ISBN 978-0-306-40615-7, paper",), "9780306406157"), (("no number",), ""), (("9790306406157",), "9790306406157")]),
    "inspire_recid": (T.inspire_recid, [(("https://inspirehep.net/literature/4321",), "4321"), (("https://inspirehep.net/record/17",), "17"), (("https://example.org/literature/4321",), "")]),
    "placeholder_doi": (_s(T.placeholder_doi), [(("10.1103/PhysRevD.0.0",), "true"), (("10.1103/PhysRevD.12.3",), "false")]),
    "book_series_doi": (_s(T.book_series_doi), [(("10.1007/978-3-540-12345-6_7",), "true"), (("10.1007/s00220-001-0001-0",), "false")]),
    "release_title": (T.release_title, [(("owner/tool: A Tool v1.2.3",), "A Tool"), (("A Tool",), "A Tool"), (("A Tool (2.0.1)",), "A Tool")]),
    "transient": (lambda c: T.transient(c.cast("int")).cast("string"), [(("429",), "true"), (("503",), "true"), (("404",), "false"), (("200",), "false"), (("-1",), "true")]),
    "related_label": (T.related_label, [(("Retraction: Rivers",), "retraction"), (("Erratum to: Rivers",), "erratum"), (("Comment on Rivers",), "comment"), (("Reply to Miller",), "reply"), (("Rivers",), None), (("Correction to Rivers",), "corrigendum")]),
    "document_type": (T.document_type, [(("journal-article",), "article"), (("Book-Chapter",), "incollection"), (("posted-content",), "preprint"), (("peer-review",), None)]),
    "preprint_container": (_s(T.preprint_container), [(("arXiv",), "true"), (("SSRN Electronic Journal",), "true"), (("Nature",), "false")]),
    "has_markup": (_s(T.has_markup), [(("<i>x</i>",), "true"), (("a &lt; b",), "true"), (("a < b",), "false"), (("plain",), "false")]),
    "without_markup": (T.without_markup, [(("<i>In</i>  vitro",), "In vitro"), (("plain",), "plain")]),
    "given_verdict": (T.given_verdict, [(("A.", "Anna"), "abbreviates"), (("Anna", "A."), "refines"), (("Anna", "Anna"), "same"), (("Anna", "Berta"), "differs"), (("", "Anna"), None)]),
    "year_of": (_s(T.year_of), [(("2001-05-06",), "2001"), (("in 2001",), None), (("1999",), "1999")]),
    "norm_pages": (T.norm_pages, [(("12--19",), "12-19"), (("12 – 19",), "12-19"), (("123 EP -",), "123-"), (("e12",), "e12")]),
    "orcid_valid": (_s(T.orcid_valid), [(("0000-0002-1825-0097",), "true"), (("https://orcid.org/0000-0001-5109-3700",), "true"), (("0000-0002-1825-0098",), "false"), (("0000-0002-1694-233X",), "true")]),
    "overlap": (lambda a, b: F.bround(T.overlap(T.words(a), T.words(b)), 3).cast("string"), [(("a b c", "b c d"), "0.5"), (("a", "b"), "0.0"), (("a b", "b a"), "1.0"), (("", "a"), "0.0")]),
    "shortened": (_s(T.shortened), [(("rivers", "rivers of the north"), "true"), (("river", "rivers of the north"), "false"), (("rivers", "rivers"), "false")]),
    "fragment": (_s(T.fragment), [(("of the cold north", "rivers of the cold north today"), "true"), (("the north", "rivers of the north"), "false")]),
    "similar": (_s(T.similar), [(("rivers", "rivers of the north"), "true"), (("a b c d e f g h i j", "a b c d e f g h i k"), "false"), (("a b", "a b"), "true"), (("rivers", "stones"), "false")]),
    "title_verdict": (
        compare.title_verdict,
        [(("Rivers of the North", "Rivers of the North"), None), (("Rivers of the North", "Rivers of the north"), "casing"), (("Rivers: of the North", "Rivers of the North"), "punctuation"), (("Rain fall", "Rainfall"), "spacing"), (("Rivers", "Rivers of the North"), "shortened"),
         (("Rivers of the North", "Stones and light"), "container"), (("Rivers of the cold North", "Rivers of the wet South today"), "strong"), (("Rivers of the cold North Sea", "Rivers of the cold South Sea"), "slight"), (("", "Rivers"), None)],
    ),
    "journal_verdict": (
        compare.journal_verdict,
        [(("The Journal of Rivers", "Journal of Rivers"), "same"), (("Phys. Rev.", "Physical Review"), "abbreviation"), (("Phisical Review", "Physical Review"), "spelling"), (("Nature", "Physical Review"), "different"), (("", "Nature"), None)],
    ),
    "type_verdict": (resolve.type_verdict, [(("article", "article"), None), (("article", "inproceedings"), "inproceedings"), (("inbook", "incollection"), None), (("article", "preprint"), None), (("book", "thesis"), "thesis")]),
}


def _quoted(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def _case(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("entry_seq"), (k % n).cast("int").alias("case"))


def _rule_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    cases = RULES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = [(k, kind, {f: v for f, v in fields.items() if f != "raw"}, fields.get("raw", "")) for k, (kind, fields, _) in enumerate(cases)]
        planted = spark.createDataFrame(raw, "case int, etype string, fields map<string,string>, raw string")
        entries = _case(spark, sf_dir, len(cases)).join(F.broadcast(planted), "case").select(
            F.lit("planted.bib").alias("file_id"), "entry_seq", F.col("entry_seq").cast("string").alias("key"), "etype", "fields", "raw", F.col("entry_seq").cast("int").alias("lineno"),
            F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("occurrences"), F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<int>))").alias("field_lines"),
        )
        return rules.entry_findings(entries, only=[name]).select("entry_seq", "category", F.coalesce("field", F.lit("")).alias("field"))

    run.__name__ = f"rule_{name}"
    run.__doc__ = f"Findings of the rule {name} on planted entries."
    return run


def _rule_sql(name: str) -> str:
    rows = [f"({k}, {_quoted(c)}, {_quoted(f)})" for k, (_, _, found) in enumerate(RULES[name]) for c, f in found]
    return f"SELECT o_orderkey AS entry_seq, category, field FROM orders JOIN (VALUES {', '.join(rows)}) AS t(n, category, field) ON o_orderkey % {len(RULES[name])} = n"


def _function_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build, cases = FUNCTIONS[name]
    width = len(cases[0][0])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planted = spark.createDataFrame([(k, *given) for k, (given, _) in enumerate(cases)], "case int, " + ", ".join(f"v{i} string" for i in range(width)))
        # the inputs are columns, so that nothing is folded to a constant
        return _case(spark, sf_dir, len(cases)).join(F.broadcast(planted), "case").select("entry_seq", build(*[F.col(f"v{i}") for i in range(width)]).alias("result"))

    run.__name__ = f"fn_{name}"
    run.__doc__ = f"The function {name} on planted values."
    return run


def _function_sql(name: str) -> str:
    cases = FUNCTIONS[name][1]
    rows = ", ".join(f"({k}, {_quoted(out)})" for k, (_, out) in enumerate(cases))
    return f"SELECT o_orderkey AS entry_seq, result FROM orders JOIN (VALUES {rows}) AS t(n, result) ON o_orderkey % {len(cases)} = n"


def author_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of name forms: files by customer, of which some hold both forms."""
    k = F.col("o_orderkey")
    name = F.when((F.col("o_custkey") % 2 == 0) & (k % 3 == 0), "Anna Adams").otherwise("Adams, Anna")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("file_id"), k.alias("entry_seq"), F.create_map(F.lit("author"), name).alias("fields"))
    return windows.author_form_census(rows).select("file_id", "form", "n")


AUTHOR_FORMS_SQL = """WITH c AS (SELECT 'f' || (o_custkey % 40) AS file_id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'space' ELSE 'comma' END AS form, count(*) AS n FROM orders GROUP BY ALL)
SELECT file_id, form, n FROM c WHERE file_id IN (SELECT file_id FROM c GROUP BY file_id HAVING count(*) > 1)"""


def arxiv_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of places of the arXiv number: files by customer, some with several."""
    k = F.col("o_orderkey")
    at = F.when((F.col("o_custkey") % 3 == 0) & (k % 5 == 0), "journal").when((F.col("o_custkey") % 3 == 1) & (k % 7 == 0), "doi").otherwise("eprint")
    value = F.when(at == "eprint", "2001.01234").otherwise("arXiv:2001.01234")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("file_id"), k.alias("entry_seq"), k.cast("string").alias("key"), F.create_map(at, value).alias("fields"))
    return windows.arxiv_style_census(rows).select("file_id", "style", "n", "first_key")


ARXIV_STYLES_SQL = """WITH c AS (SELECT 'f' || (o_custkey % 40) AS file_id, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'journal' WHEN o_custkey % 3 = 1 AND o_orderkey % 7 = 0 THEN 'doi' ELSE 'eprint' END AS style,
count(*) AS n, CAST(min(o_orderkey) AS VARCHAR) AS first_key FROM orders GROUP BY ALL) SELECT file_id, style, n, first_key FROM c WHERE file_id IN (SELECT file_id FROM c GROUP BY file_id HAVING count(*) > 1)"""

QUERIES = {f"rule_{n}": _rule_query(n) for n in RULES} | {f"fn_{n}": _function_query(n) for n in FUNCTIONS} | {"author_form_census": author_forms, "arxiv_style_census": arxiv_styles}
ORACLES = {f"rule_{n}": _rule_sql(n) for n in RULES} | {f"fn_{n}": _function_sql(n) for n in FUNCTIONS} | {"author_form_census": AUTHOR_FORMS_SQL, "arxiv_style_census": ARXIV_STYLES_SQL}
