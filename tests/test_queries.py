"""Every named query against its SQL counterpart in DuckDB, and against the known counts."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from hearthlog.plans.catalog import all_queries
from hearthlog.plans.oracle import all_oracles
from tests.conftest import SMALL

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = ordered(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())
    assert got == want and got


@pytest.mark.parametrize(
    "name",
    ["daily_stats_7d", "sensor_statistics_nested", "recent_readings", "accepted_readings", "alerts_fired", "orphans",
     "name_taken", "canonical_rules"],
)
def test_query_without_broadcasts(spark, duck, name):
    """The same results when every table is too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in names:
        spark.conf.set(setting, "-1")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        test_query(spark, duck, name)
    finally:
        for setting in names:
            spark.conf.unset(setting)


def test_no_query_pairs_all_rows(spark):
    """No cross or nested-loop join even without broadcasts, and Python only behind the caps."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in QUERIES:
            if name.startswith("stream_"):
                continue
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
            assert ("InArrow" in plan) == (name.startswith(("alerts_", "alert_e", "alert_mes", "cap_", "rule_c", "rules_a"))), name
            assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_known_counts(spark):
    count = lambda name: QUERIES[name](spark, SMALL).count()
    outcomes = {r.outcome: r.requests for r in QUERIES["ingest_outcomes"](spark, SMALL).collect()}
    assert outcomes == {
        "ACCEPTED": 832, "INVALID_REQUEST_400": 47, "INVALID_TOKEN_401": 11, "INACTIVE_409": 100, "TYPE_MISMATCH_400": 10,
    }
    assert count("recent_readings") == 130
    assert count("alert_matches") == 245 and count("alerts_fired") == 72
    assert count("retained_readings") == 384
    daily = QUERIES["daily_stats_7d"](spark, SMALL)
    assert daily.count() == 105 and daily.where("value IS NOT NULL").count() == 81
    assert daily.where("sensor_type = 'MOTION'").groupBy().sum("value").first()[0] == 27


def test_entry(spark):
    assert contract.entry(spark).columns == ["sensor_id", "sensor_type", "local_date", "value"]
