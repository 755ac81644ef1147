import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import catalog, compare, rules, status
from folioscope.sources import bibtex, tex

BIB = """% a comment with @article{hidden, title={x}}
@string{jo = "Journal of "}
@article{one,
  author = {Adams, A. and Baker, B.},
  title = {A short study.},
  journal = jo # "Rivers",
  year = 2001,
  pages = {10-12},
  doi = {https://doi.org/10.1234/ABC}
}
@book{two, editor = {Clark, C.}, title = {Whole}, publisher = {P}, year = {2002}, isbn = {9783161484101}}
@article{broken, title = {never closed

@misc{three, title = {T}, title = {U}, month = {January}}
@article{one, title = {QUITE A LOUD TITLE HERE}, author = {Davis, D. and others}, year = {20}}
"""


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame([("f.bib", BIB), ("empty.bib", ""), ("nul.bib", None)], "file_id string, text string")
    return bibtex.parse_files(frame).cache()


def test_parser(parsed):
    rows = {(r.file_id, r.entry_seq): r for r in bibtex.entries(parsed).collect()}
    assert [r.key for r in sorted(rows.values(), key=lambda r: r.entry_seq)] == ["one", "two", "three", "one"]
    assert rows["f.bib", 0].fields["journal"] == "Journal of Rivers"
    assert rows["f.bib", 2].fields["title"] == "U"
    kinds = {(r.file_id, r.kind) for r in bibtex.problems(parsed).collect()}
    assert kinds == {("f.bib", "unclosed"), ("f.bib", "unbalanced"), ("nul.bib", "binary")}


def test_rules(parsed):
    found = rules.entry_findings(bibtex.entries(parsed))
    got = {(r.entry_seq, r.category, r.field) for r in found.collect()}
    assert (0, "style", "pages") in got and (0, "style", "doi") in got and (0, "style", "title") in got
    assert (1, "entrytype_suggestion", "author") in got and (1, "identifier_format", "isbn") in got
    assert (2, "duplicate_field_conflict", "title") in got and (2, "style", "month") in got
    assert (3, "title_case", "title") in got and (3, "author_truncated_marker", "author") in got and (3, "identifier_format", "year") in got
    assert not any(c == "missing_field" and s == 0 for s, c, _ in got)


def test_severity_and_suppression_ignore_order(spark):
    schema = "file_id string, entry_seq int, category string, severity string, suggested string, layer string"
    rows = [("f", 0, "title_case", "note", None, "static"), ("f", 0, "encoding", "error", None, "static"), ("f", 1, "title_case", "note", None, "static")]
    away = spark.createDataFrame([("f", 0, "title_case"), ("f", 0, "encoding")], "file_id string, entry_seq int, category string")
    for order in (rows, rows[::-1]):
        out = status.stamped(status.pinned(spark.createDataFrame(order, schema)), away)
        got = {(r.entry_seq, r.category): (r.severity, r.suppressed_by) for r in out.collect()}
        assert got == {(0, "title_case"): ("note", "record"), (0, "encoding"): ("note", None), (1, "title_case"): ("note", None)}


def test_catalog(spark):
    assert catalog.catalog(spark).count() == 48


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (T.isbn_valid, "978-3-16-148410-0", True), (T.isbn_valid, "9783161484101", False), (T.isbn_valid, "080442957X", True), (T.isbn_valid, "", False),
        (T.issn_valid, "0378-5955", True), (T.issn_valid, "0378-5954", False), (T.orcid_valid, "0000-0002-1825-0097", True), (T.orcid_valid, "0000-0002-1825-0098", False),
        (T.title_key, "The {\\\"O}stlund Effect & $x$", "the ostlund effect and x"), (T.bare_doi, "https://doi.org/10.1/AB", "10.1/ab"), (T.norm_pages, "12 -- 15", "12-15"),
        (T.fold_surname, "M{\\\"u}ller, Jo", "muller"), (T.fold_surname, "Jo van Mueller", "muller"), (T.arxiv_id, "arXiv:2101.01234v2", "2101.01234"),
    ],
)
def test_functions(spark, build, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("A B c d", "A B c d", None), ("a b c d", "A b c d", "casing"), ("a b: c d", "a b c d", "punctuation"), ("a b c d e", "a b c", "shortened"), ("x y", "p q", "container"), ("a b c d e f g", "a b c d e f z", "slight")],
)
def test_title_verdict(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(compare.title_verdict(F.col("a"), F.col("b"))).first()[0] == want


def test_tex(spark):
    text = "First one. Second \\cite{a, b} here. Third. % \\cite{c}\nFourth \\parencite[p. 1]{b}."
    rows = tex.citations(spark.createDataFrame([("m.tex", text)], "path string, text string")).collect()
    assert [list(r["keys"]) for r in rows] == [["a", "b"], ["b"]] and rows[0].context == "First one. Second \\cite{a, b} here. Third."
