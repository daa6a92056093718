"""Cooldown and window caps against a plain walk, on both plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import throttle
from tests.conftest import at

MINUTE = 60_000_000
START = 1_700_000_000_000_000


def walk(rows, width_us, limit, seed_us=None):
    """rows: (time, id) of one key; returns the admitted ids."""
    admitted = set()
    end, used = (None, 0) if seed_us is None else (seed_us + width_us, limit)
    for time, row_id in sorted(rows):
        if end is None or time >= end:
            end, used = time + width_us, 0
        if used < limit:
            used += 1
            admitted.add(row_id)
    return admitted


def frame(spark, rows):
    """rows: (key, time_us, id, width_minutes, seed_us)."""
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, w int, seed bigint")
    return df.select(
        "k", "id", "w", F.timestamp_micros("us").alias("at"), F.timestamp_micros("seed").alias("last")
    )


def run(df, limit, **sizes):
    flagged = throttle.cap_per_window(
        df, "k", "at", "id", F.col("w"), limit, last_admitted=F.col("last"), **sizes
    )
    assert set(flagged.columns) == set(df.columns) | {"allowed"}
    rows = flagged.select("k", "id", "allowed").collect()
    assert len(rows) == df.count()
    return {(row.k, row.id) for row in rows if row.allowed}


def random_rows(seed, shape):
    rng = random.Random(seed)
    rows, next_id = [], 0
    for key in ("hot", "warm", "cold"):
        width = rng.choice([1, 3, 60, 1440])
        n = {"hot": 1500, "warm": 300, "cold": 5}[key]
        span = width * MINUTE * rng.choice([2, 7, 40])
        seed_us = START + rng.randrange(span // 2) if rng.random() < 0.5 else None
        for _ in range(n):
            if shape == "uniform":
                time = START + rng.randrange(span)
            elif shape == "bursts":
                time = START + rng.randrange(5) * (span // 5) + rng.randrange(max(1, span // 500))
            elif shape == "periodic":
                time = START + rng.randrange(40) * (width * MINUTE // 3)
            else:  # same phase of every window, microseconds apart
                time = START + rng.randrange(40) * width * MINUTE + rng.randrange(4)
            rows.append((key, time, next_id, width, seed_us))
            next_id += 1
    rng.shuffle(rows)
    return rows


def expected(rows, limit):
    admitted = set()
    for key in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == key]
        got = walk([(r[1], r[2]) for r in mine], mine[0][3] * MINUTE, limit, mine[0][4])
        admitted |= {(key, row_id) for row_id in got}
    return admitted


@pytest.mark.parametrize("shape", ["uniform", "bursts", "periodic", "aligned"])
@pytest.mark.parametrize("limit", [1, 3])
def test_both_plans_equal_the_walk(spark, shape, limit):
    rows = random_rows(f"{shape}{limit}", shape)
    want, df = expected(rows, limit), frame(spark, rows)
    assert run(df, limit) == want
    assert run(df, limit, hot_key_events=200, stripe_events=250) == want


@pytest.mark.parametrize("shape", ["uniform", "periodic"])
def test_folding_over_levels(spark, shape):
    rows = random_rows(f"levels-{shape}", shape)
    assert run(frame(spark, rows), 1, hot_key_events=200, stripe_events=100, fan_out=2) == expected(rows, 1)


def test_state_crosses_arrow_batches(spark):
    rows = random_rows("batches", "uniform")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "37")
    try:
        assert run(frame(spark, rows), 1) == expected(rows, 1)
        assert run(frame(spark, rows), 3) == expected(rows, 3)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("sizes", [{}, {"hot_key_events": 1, "stripe_events": 1}])
def test_cooldown_edges(spark, sizes):
    hour = 60 * MINUTE
    rows = [
        ("a", START, 1, 60, None),
        ("a", START, 2, 60, None),  # same instant, later id
        ("a", START + hour - 1, 3, 60, None),  # one microsecond early
        ("a", START + hour, 4, 60, None),  # exactly at the end
        ("a", START + hour + 5, 5, 60, None),
        ("a", START + 2 * hour, 6, 60, None),  # counted from the firing, not from 5
        ("b", START + hour - 1, 7, 60, START),  # blocked by the seed
        ("b", START + hour, 8, 60, START),
        ("b", START - 5, 9, 60, START),  # older than the last firing
    ]
    assert run(frame(spark, rows), 1, **sizes) == {("a", 1), ("a", 4), ("a", 6), ("b", 8)}


@pytest.mark.parametrize("sizes", [{}, {"hot_key_events": 1, "stripe_events": 1}])
def test_cap_edges(spark, sizes):
    hour = 60 * MINUTE
    rows = [
        ("a", START, 1, 60, None),
        ("a", START + 10, 2, 60, None),
        ("a", START + 20, 3, 60, None),  # third of two: refused
        ("a", START + hour - 1, 4, 60, None),  # refused, does not extend
        ("a", START + hour, 5, 60, None),  # new window exactly at the end
        ("a", START + hour + 1, 6, 60, None),
        ("a", START + hour + 2, 7, 60, None),
    ]
    assert run(frame(spark, rows), 2, **sizes) == {("a", 1), ("a", 2), ("a", 5), ("a", 6)}


def test_two_keys_are_both_consumed(spark):
    minute = lambda n: at(f"2024-01-01 00:{n:02d}:00")
    rows = [
        (1, minute(0), "x", "c"),
        (2, minute(1), "x", "c"),  # refused by the address, still counted by the client
        (3, minute(2), "y", "c"),  # refused by the client
        (4, minute(3), "z", " "),
        (5, minute(4), "w", None),  # same unknown client as 4
        (6, minute(5), "v", " [unknown] "),
    ]
    df = spark.createDataFrame(rows, "id bigint, at timestamp, a string, c string")
    flagged = throttle.cap_two_keys(df, "a", "c", "at", "id", 1, 2, 15).orderBy("id").collect()
    assert [row.address_allowed for row in flagged] == [True, False, True, True, True, True]
    assert [row.client_allowed for row in flagged] == [True, True, False, True, True, False]
    assert [row.allowed for row in flagged] == [True, False, False, True, True, False]


def test_two_keys_keep_other_columns(spark):
    rows = [(n, "a", "c", at("2024-01-01 00:00:00") + dt.timedelta(minutes=n), f"note {n}") for n in range(4)]
    df = spark.createDataFrame(rows, "id bigint, a string, c string, at timestamp, note string")
    flagged = throttle.cap_two_keys(df, "a", "c", "at", "id", 1, 2, 15).orderBy("id").collect()
    assert [(r.note, r.address_allowed, r.client_allowed, r.allowed) for r in flagged] == [
        ("note 0", True, True, True), ("note 1", False, True, False), ("note 2", False, False, False),
        ("note 3", False, False, False),
    ]
