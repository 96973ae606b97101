"""Faults that only larger tables showed, each in a small form."""

import json
import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import ORACLES, QUERIES

from grainsift.sources import connectors as C
from grainsift.sources import files as IO
from grainsift.streaming import events as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compound_details_are_not_broadcast(spark, sf):
    df = QUERIES["s15h_compounds"](spark, sf)
    assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    df.collect()
    assert "Broadcast" not in plan(df)


def test_compound_details_without_title_or_text(spark):
    searches = spark.createDataFrame([("q", json.dumps({"IdentifierList": {"CID": [1, 2, 3, 4]}}))], "query string, json string")
    info = lambda *x: json.dumps({"InformationList": {"Information": list(x)}})
    details = spark.createDataFrame([(1, info({"Description": "é" * 2001})), (2, info({"Title": "Two"}, {"Title": "other"})), (3, info())], "cid long, json string")
    got = {r.source_id: (r.title, r.abstract) for r in C.compounds(searches, details).collect()}
    assert got == {"1": ("PubChem: CID:1", "é" * 2000), "2": ("PubChem: Two", ""), "3": ("PubChem: CID:3", ""), "4": ("PubChem: CID:4", "")}


@pytest.fixture
def settings(spark):
    """Sets settings of the session until the end of a test."""
    old = {}

    def put(name, value):
        old.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        spark.conf.set(name, value)


def from_sql(name, folder, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.sql(ORACLES[name])
    return want.columns, sorted(want.fetchall(), key=str)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """Documents out of order whose two key columns differ much in size from the rows of a sheet; some without source."""
    folder = tmp_path_factory.mktemp("sources")
    source = F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 5))
    spark.range(30_000).select(F.expr("id * 7919 % 30000").alias("doc_id"), source.alias("source"), F.sha2(F.col("id").cast("string"), 512).alias("lang")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("advisory", ["64MB", "200KB"])
def test_sheets_hold_all_rows_where_parts_are_joined(spark, settings, sources, advisory):
    settings("spark.sql.shuffle.partitions", "40")
    settings("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    settings("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    df = QUERIES["k11_blind_sheets"](spark, sources)
    columns, want = from_sql("k11_blind_sheets", sources, "documents")
    assert df.columns == columns and sorted(map(tuple, df.collect()), key=str) == want


def test_generated_ids_of_more_than_five_digits(spark, tmp_path):
    spark.range(100_020).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["k5_generated_ids"](spark, str(tmp_path))
    columns, want = from_sql("k5_generated_ids", str(tmp_path), "documents")
    assert df.columns == columns and sorted(map(tuple, df.collect()), key=str) == want
    rows = IO.numbered(spark.read.parquet(f"{tmp_path}/documents.parquet"), ["source", "doc_id"], "item_%05d", 1).orderBy("source", "doc_id")
    assert [r.id for r in rows.collect()] == [f"item_{i:05d}" for i in range(1, 100_021)]


def test_exact_sum_against_fractions():
    rnd = random.Random(8)
    for n in range(60):
        values = [rnd.choice((-1, 1)) * rnd.random() * 10 ** rnd.randint(-20, 20) for _ in range(n)]
        parts = E.exact_sum(values)
        assert sum(map(Fraction, parts)) == sum(map(Fraction, values)) and (not parts or parts[0] == math.fsum(values))
    assert E.exact_sum([1.5, -1.5]) == [] and E.exact_sum([math.inf, 1.0]) == [math.inf]


def test_spend_alerts_at_a_multiple_of_the_cap(spark, tmp_path):
    """Six equal values that are the cap in full and less if summed as doubles in a row, one a file."""
    total = 0.0
    for _ in range(6):  # sum() of Python compensates
        total += 0.09
    assert total < 0.54 == math.fsum([0.09] * 6)
    rows = spark.createDataFrame([(1, 0.09), (2, 0.045), (3, None)], "user_id long, value double").coalesce(1)
    for _ in range(6):
        rows.write.mode("append").parquet(str(tmp_path / "e"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = E.drained(E.spend_alerts(E.stream_of(spark, str(tmp_path / "e"), rows.schema, 1), "user_id", 0.54), "spend").collect()
    finally:
        spark.conf.set(provider, old)
    assert list(map(tuple, got)) == [("1", 1)]
