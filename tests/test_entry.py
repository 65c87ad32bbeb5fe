import duckdb
import pytest

import __spark_entry__ as entry
from vecspan.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())


def test_ingest_takes_the_whole_table(spark, data):
    ids = [str(r.vec_id) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()]
    rows = QUERIES["ingest_directory"](spark, data).collect()
    assert sorted(r.id for r in rows if r.reason is None) == sorted([*ids, "0", "long"])
    rejected = ["bad_id", "bad_text", "bad_metadata", "bad_embedding", "wrong_dim", *["not_object"] * 3, *["parse_error"] * 2]
    assert sorted(r.reason for r in rows if r.reason) == sorted(rejected)
