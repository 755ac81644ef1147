import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import queries as Q
from folioscope.streaming import resume


@pytest.fixture(scope="module")
def db(sf):
    own = duckdb.connect()
    for name in os.listdir(sf):
        own.sql(f"create view {name.split('.')[0]} as from '{sf}/{name}'")
    return own


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_sql(spark, sf, db, name):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), db.sql(Q.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    one, two = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert one.equals(two)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_resume(spark, sf, tmp_path):
    entries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, raw string")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    done = spark.createDataFrame([("a", h("x"), ["offline", "online"]), ("b", h("old"), ["offline", "online"])], "key string, raw_hash string, done array<string>")
    todo = {r.key: list(r.todo) for r in resume.needed(entries, done, ["offline", "llm"]).collect()}
    assert todo == {"a": ["llm"], "b": ["offline", "online", "llm"], "c": ["offline", "online", "llm"]}


def test_stream_last_state(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(sf + "/even*.parquet")
    run = resume.keep_last(stream.select("user_id", "event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", "event_id")
    run.awaitTermination(120)
    last = sorted(os.listdir(tmp_path / "out"))[-1]
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()}
    want = {r.user_id: r.event_id for r in Q.QUERIES["last_write_wins"](spark, sf).collect()}
    assert got == want
