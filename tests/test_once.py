"""Costly values are computed once a row, and shortcuts give what the long way gives."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import compare, windows
from folioscope.plans import audit
from folioscope.plans import derived as D

#: A pattern that title_key has once.
KEY = "<[^<>]*>"


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """Wanted works and their hits, read from files, so that nothing is folded to a constant."""
    folder = str(tmp_path_factory.mktemp("searched"))
    title = "Rivers of the cold North Sea today"
    spark.createDataFrame([(k, title, "adams", 2001) for k in range(10)] + [(10, "Rivers", "adams", 2001), (11, None, "adams", 2001)], "id long, title string, surname string, year long").write.parquet(f"{folder}/wanted")
    hits = [
        (0, 1, "Other", "adams", 2001), (0, 2, "Rivers of the cold {North} Sea today", "adams", 2004), (1, 1, title, "adams", 2005), (2, 1, title, "baker", 2001), (3, 1, title, "vanadams", 1998),
        (4, 1, "Cold North Sea today", "adams", 2002), (4, 2, title, "adams", 2001), (5, 1, "Cold North Sea today", "adams", 2003), (6, 1, "Rivers of", "adams", 2002), (7, 1, "Rivers of the cold North Sea today and then", "adams", 2003),
        (8, 9, title, "adams", 2001), (9, 1, None, "adams", 2001), (9, 2, title, "", 2001), (9, 3, title, "adams", None), (10, 1, "Rivers", "adams", 2001), (11, 1, None, "adams", 2001), (6, 2, "today Sea North cold the of Rivers brook", "adams", 2001),
    ]
    spark.createDataFrame([(*h, f"d{n}") for n, h in enumerate(hits)], "id long, rank long, title string, surname string, year long, doi string").write.parquet(f"{folder}/hits")
    return spark.read.parquet(f"{folder}/wanted"), spark.read.parquet(f"{folder}/hits")


def test_hits_are_the_same(searched):
    got = {r.id: (r.doi, r["rank"]) for r in compare.accepted_hits(*searched).collect()}
    assert got == {0: ("d1", 2), 3: ("d4", 1), 4: ("d5", 1), 6: ("d8", 1)}


def test_keys_of_hits_are_made_once(searched):
    assert planned(compare.accepted_hits(*searched)).count(KEY) == 2


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (T.title_key, "  Rain,\tfall_now 42! ", "rain fall now 42"), (T.title_key, "A~b <i>c</i> & d", "a b c and d"), (T.title_key, "Éa—ß \\emph{x}", "ea ss x"), (T.title_key, "K one", "k one"), (T.title_key, "🙂 a", "a"),
        (T.title_key, "", ""), (T.title_key, None, None), (T.fold_surname, "Anna O'Brien Jr.", "obrien"), (T.fold_surname, "{The Oe Team}", "theoteam"), (T.fold_surname, "Møller, A.", "moller"), (T.fold_surname, None, None), (T.fold_surname, "", ""),
    ],
)
def test_shortcuts(spark, build, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0] == want


def test_surname_match(spark):
    rows = [("adams", "adams", True), ("vanadams", "adams", True), ("adams", "delaadams", True), ("xadams", "adams", False), ("", "", False), ("van", "", False), ("adams", "baker", False), (None, "adams", None)]
    made = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in made.withColumn("got", T.surname_match(F.col("a"), F.col("b"))).collect())


def test_duplicate_works(spark, tmp_path):
    """Second entries of a work, unless their DOI occurred before; entries without a DOI or a title aren't one group."""
    rows = [
        (1, "Rivers", "10.1/a", "Adams, A."), (2, "{Rivers}", "10.1/A", "Adams, B."), (3, "rivers!", "", "Adams, A. and Baker, B."), (4, "Rivers", "", "Baker, B."), (5, "", "10.1/a", "Adams, A."), (6, "", "", ""), (7, "", "", ""),
        (8, "Rivers", "10.1/b", "Adams, A."), (9, "Stones", "10.1/b", "Clark, C."), (10, "Stones", "10.1/c", "Clark, C."), (11, "Rivers", "", "Baker, C."),
    ]
    raw = spark.createDataFrame([("f", k, f"k{k}", {n: v for n, v in (("title", t), ("doi", d), ("author", a)) if v}) for k, t, d, a in rows], "file_id string, entry_seq long, key string, fields map<string,string>")
    raw.write.parquet(str(tmp_path / "e"))
    found = windows.duplicate_works(spark.read.parquet(str(tmp_path / "e")))
    assert {(r.entry_seq, r.first_key) for r in found.collect()} == {(3, "k1"), (8, "k1"), (10, "k9"), (11, "k4")}
    assert planned(found).count(KEY) == 1


def test_entries_are_made_in_several_tasks(spark, sf):
    made = D.entries(spark, sf)
    assert made.rdd.getNumPartitions() > 1
    assert planned(made.filter((T.field("title") != "") & (T.field("doi") != ""))).count("map_from_entries") == 1


def test_descriptions_are_compared_in_one_pass(spark, sf):
    entries, records = D.entries(spark, sf), D.records(spark, sf)
    assert "Union" not in planned(audit.description_findings(entries, records))
