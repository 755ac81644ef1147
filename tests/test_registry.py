import json

import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope.functions import text as T
from folioscope.functions.braces import protect
from folioscope.operators import rating, resolve
from folioscope.plans import render
from folioscope.plans.audit import audit
from folioscope.sources import bibtex, registry

WORK = {
    "message": {
        "DOI": "10.1234/AB", "type": "journal-article", "title": ["A study of <i>rivers</i> and their stones"], "container-title": ["Journal of Rivers"], "volume": "4", "page": "1-9",
        "author": [{"family": "Adams", "given": "Ann"}, {"name": "The Group"}], "issued": {"date-parts": [[2010, 5]]}, "relation": {"is-preprint-of": [{"id": "10.9/z"}]},
        "updated-by": [{"type": "erratum", "DOI": "10.1234/AB-e"}],
    }
}
BIB = """@article{a, author={Adams, A.}, title={A study of rivers and their stones}, journal={Journal of Rivers}, year={2011}, volume={4}, url={https://doi.org/10.1234/AB}}
@article{b, author={Baker, B.}, title={Other}, journal={arXiv preprint arXiv:2101.00001}, year={2021}}
@book{c, author={Clark, C.}, title={Book}, publisher={P}, year={2015}}
"""


def payloads(spark, *rows):
    return spark.createDataFrame([(i, s, b if b is None or isinstance(b, str) else json.dumps(b)) for i, s, b in rows], "id string, status int, body string")


@pytest.fixture(scope="module")
def entries(spark):
    return bibtex.entries(bibtex.parse_files(spark.createDataFrame([("f.bib", BIB)], "file_id string, text string"))).cache()


def test_payloads(spark):
    df = payloads(spark, ("10.1234/ab", 200, WORK), ("x", 404, None), ("y", 200, "{torn"))
    r = registry.crossref(df).collect()
    assert len(r) == 1 and r[0].title == "A study of rivers and their stones" and r[0].authors == ["Adams, Ann", "The Group"] and r[0].year == "2010" and r[0].document_type == "article"
    assert {(x.label, x.target) for x in registry.crossref_relations(df).collect()} == {("is-preprint-of", "10.9/z"), ("erratum", "10.1234/ab-e")}
    w = registry.openalex(payloads(spark, ("d", 200, {"is_retracted": True, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}))).first()
    assert (w.is_retracted, w.abstract) == (True, "a b a")
    atom = "<feed><entry><title>A\n b</title><published>2021-01-02</published><author><name>X Y</name></author><summary>S</summary><arxiv:doi>10.1/q</arxiv:doi></entry></feed>"
    a = registry.arxiv(payloads(spark, ("2101.00001", 200, atom), ("n", 200, "<feed></feed>"))).collect()
    assert [(r.title, r.year, r.authors, r.doi) for r in a] == [("A b", "2021", ["X Y"], "10.1/q")]


def test_resolution(spark, entries):
    records = {"crossref": registry.crossref(payloads(spark, ("10.1234/ab", 200, WORK)))}
    found = resolve.resolutions(entries, records)
    assert [(r.entry_seq, r.source) for r in found.collect()] == [(0, "crossref")]
    none = spark.createDataFrame([], "file_id string, entry_seq int, doi string")
    got = {(r.key, r.category, r.suggested) for r in resolve.pid_check(entries, found, none).collect()}
    assert got == {("a", "doi_available", "10.1234/ab"), ("c", "pid_missing", None)}
    relations = registry.crossref_relations(payloads(spark, ("10.1234/ab", 200, WORK)))
    titles = spark.createDataFrame([("10.7/e", "Erratum: a study of rivers and their stones", "adams"), ("10.7/f", "A study of lakes", "adams")], "target string, title string, surname string")
    assert {(r.label, r.target) for r in resolve.related_works(entries, relations, titles).collect()} == {("is-preprint-of", "10.9/z"), ("erratum", "10.1234/ab-e"), ("erratum", "10.7/e")}
    bad = spark.createDataFrame([("10.1234/ab", True)], "id string, is_retracted boolean")
    assert [r.key for r in resolve.retracted(entries, bad).collect()] == ["a"]


def test_audit_and_report(spark, entries):
    records = resolve.resolutions(entries, {"crossref": registry.crossref(payloads(spark, ("10.1234/ab", 200, WORK)))})
    result = audit(entries, records)
    got = {(r.key, r.category, r.field) for r in result.findings.collect()}
    assert ("a", "metadata_mismatch", "year") in got and ("a", "parity_suggestion", "doi") in got
    text = list(render.lines(result))
    assert text[0].startswith("a ") and any("integrity" in x for x in text)


def test_rating(spark, entries):
    contexts = spark.createDataFrame([("m.tex", 1, ["a", "b"], "We follow it.")], "path string, line int, keys array<string>, context string")
    abstracts = spark.createDataFrame([("a", "About rivers."), ("b", None)], "key string, abstract string")
    rows = rating.prompts(entries, contexts, abstracts)
    assert [r.key for r in rows.collect()] == ["a"]
    replies = spark.createDataFrame([("a", 'Sure: {"score": 2, "wrong_paper": false, "reason": "r"}'), ("b", None), ("c", '{"score": 9}')], "key string, reply string")
    assert {(r.key, r.category) for r in rating.findings(replies).collect()} == {("a", "llm_relevance"), ("b", "llm_unavailable"), ("c", "llm_ok")}
    assert [r.reply for r in rating.asked(rows, lambda p: "x" if "rivers" in p else "y").collect()] == ["x"]


def test_command(spark, tmp_path, capsys):
    (tmp_path / "f.bib").write_text("@misc{x, title={T}}\n@article{y, title={U}, author={A, B}}\n")
    assert cli.main([str(tmp_path)]) == 1 and "missing_field" in capsys.readouterr().out
    assert cli.main(["--list-rules"]) == 0


def test_braces():
    assert protect("On DNA and {DNA} of RNA", ["DNA", "RNA"]) == "On {DNA} and {DNA} of {RNA}"


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [(T.arxiv_version, "2101.00001v3", 3), (T.arxiv_version, "2101.00001", None), (T.related_label, "Erratum: x", "erratum"), (T.related_label, "On retractions", None), (T.release_title, "org/tool: Tool v1.2.3", "Tool"), (T.isbn_in, "ISBN 978-3-16-148410-0.", "9783161484100")],
)
def test_more_functions(spark, build, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0] == want
