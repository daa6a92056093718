"""Keyed state, event-time slots, folding and file exchange, each against its batch twin."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.operators import alerts, recent, retention, stats, throttle
from hearthlog.schema import READINGS
from hearthlog.sources import driver_tables, files, sinks
from hearthlog.sources.tables import read_readings
from hearthlog.streaming import folding, jobs, keyed, windows
from tests.conftest import SMALL, at
from tests.test_streaming import same, stream_of

FACT_DAYS = dt.date(2023, 12, 1), dt.date(2024, 3, 1)


def plain_admit(times, width, limit, anchor, used):
    flags = []
    for t in times:
        if anchor is None or t >= anchor + width:
            anchor, used = t, 0
        flags.append(used < limit)
        used += used < limit
    return flags, anchor, used


def test_admit_matches_a_plain_walk():
    rng = random.Random(4)
    for _ in range(300):
        times = sorted(rng.randrange(100) for _ in range(rng.randrange(30)))
        state = rng.choice([(None, 0), (rng.randrange(100), rng.randrange(4))])
        width, limit = rng.randrange(1, 30), rng.randrange(1, 4)
        flags, anchor, used = keyed.admit(np.array(times, dtype=np.int64), width, limit, *state)
        assert (flags.tolist(), anchor, used) == plain_admit(times, width, limit, *state)


def append(spark, rows, path, layout=READINGS):
    spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(path)


def test_cooldown_starts_from_the_rules_and_survives_restarts(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))
    rule = driver_tables.rules(spark, SMALL).where("enabled AND rule_type = 'NUMERIC_THRESHOLD'").first()
    values = {**rule.asDict(), "threshold_value": 0.0, "comparison_operator": "ABOVE", "cooldown_minutes": 60}
    values["last_triggered_at"] = at("2024-01-01 11:30:00")
    rules = spark.createDataFrame([values], driver_tables.rules(spark, SMALL).schema)
    users = driver_tables.users(spark, SMALL).withColumn("email_verified_at", F.lit(at("2023-12-02 00:00:00")))
    moments = [("12:29:59.999999", 1), ("12:30:00", 2), ("13:29:00", 3), ("13:30:00", 4), ("13:00:00", 5), ("14:30:00", 6)]
    for moment, n in moments:
        append(spark, [(n, rule.sensor_id, 50.0, None, rule.threshold_unit, at(f"2024-01-01 {moment}"))], feed)
        keyed.stream_cooldown(stream_of(spark, READINGS, feed), rules, users, out, checkpoint, True).awaitTermination()
    # Number 5 comes late, while the rule cools down.
    assert sorted(r.reading_id for r in jobs.read_outbox(spark, out).collect()) == [2, 4, 6]
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "window").load()
    assert state.count() == 1
    suppressed = spark.read.parquet(f"{out}/suppressed").agg(F.sum("n_suppressed")).first()[0]
    assert suppressed == 3


def test_ended_windows_leave_the_state_store(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))
    layout = "id bigint, requested_at timestamp, address_key string, client_key string"
    requests, total, removed = [], [], 0
    for day in range(3):
        rows = [(day * 100 + n, at(f"2024-01-0{day + 1} 12:00:{n:02}"), f"a{day}-{n % 20}", f"c{day}") for n in range(60)]
        requests += rows
        append(spark, rows, feed, layout)
        run = keyed.stream_caps(
            stream_of(spark, layout, feed), out, checkpoint, address_limit=2, client_limit=10, width_minutes=15, available_now=True
        )
        run.awaitTermination()
        states = [p["stateOperators"] for p in run.recentProgress]
        total.append([s["numRowsTotal"] for s in states[-1]])
        removed += sum(s["numRowsRemoved"] for p in states for s in p)
    # One day's keys at most are held: 20 addresses in one state, one client in the other.
    assert max(sum(t) for t in total) <= 2 * (20 + 1) and removed >= 2 * 21
    batch = throttle.cap_two_keys(
        spark.createDataFrame(requests, layout), "address_key", "client_key", "requested_at", "id",
        address_limit=2, client_limit=10, width_minutes=15,
    )
    assert same(batch.select("id", "address_allowed", "client_allowed", "allowed"), keyed.read_verdicts(spark, out))


def test_late_readings_become_corrections(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))
    reading = lambda n, moment, value: (n, 1, value, None, "C", at(f"2024-01-01 {moment}"))
    batches = [
        [reading(1, "12:01:00", 1.0), reading(2, "12:20:00", 2.0)],
        [reading(3, "15:00:00", 4.0), reading(4, "12:02:00", 8.0)],
        # Later than an hour behind 15:00.
        [reading(5, "12:03:00", 16.0), reading(6, "12:40:00", 32.0), reading(7, "15:01:00", 64.0)],
        [reading(8, "20:00:00", 128.0)],
    ]
    for rows in batches:
        append(spark, rows, feed)
        windows.stream_windows(stream_of(spark, READINGS, feed), out, checkpoint, available_now=True).awaitTermination()
    closed = {(r.slot_start.strftime("%H:%M"), r.correction): (r.sum_value, r.n_values) for r in windows.read_windows(spark, out).collect()}
    assert closed == {
        ("12:00", False): (9.0, 2), ("12:15", False): (2.0, 1), ("15:00", False): (68.0, 2),
        ("12:00", True): (16.0, 1), ("12:30", True): (32.0, 1),
    }
    (left,) = windows.open_slots(spark, checkpoint).collect()
    assert (left.slot_start.strftime("%H:%M"), left.sum_value, left.correction) == ("20:00", 128.0, False)
    everything = spark.createDataFrame([r for rows in batches for r in rows], READINGS)
    assert same(stats.rollup_15m(everything), windows.slots_so_far(spark, out, checkpoint))


LAYOUT = "k bigint, v bigint"


def sums(df):
    return df.groupBy("k").agg(F.sum("v").alias("v"))


def epochs(path):
    import glob

    return glob.glob(f"{path}/run=*/epoch=*") + glob.glob(f"{path}/folded/*/*")


def test_folding_bounds_the_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for epoch in range(50):
        df = spark.createDataFrame([(epoch % 3, 1), (7, epoch)], LAYOUT).coalesce(1)
        for _ in range(1 + (epoch == 20)):  # a micro-batch that is written again
            sinks.write_epoch(df, path, "r", epoch)
            folding.fold(spark, path, LAYOUT, sums, "r", epoch, every=4)
        assert len(epochs(path)) <= 4 * 3 + 1
    got = dict(map(tuple, sums(folding.read(spark, path, LAYOUT)).collect()))
    assert got == {0: 17, 1: 17, 2: 16, 7: sum(range(50))}


def test_folding_survives_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    write, read = files.write_note, lambda path: dict(map(tuple, sums(folding.read(spark, path, LAYOUT)).collect()))

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    for step in ("write_note", "remove"):
        path = str(tmp_path / step)
        for epoch in range(5):
            sinks.write_epoch(spark.createDataFrame([(1, 10**epoch)], LAYOUT).coalesce(1), path, "r", epoch)
        with monkeypatch.context() as patch:
            patch.setattr(files, step, crash)
            with pytest.raises(Crash):
                folding.fold(spark, path, LAYOUT, sums, "r", 5, every=4)
        assert read(path) == {1: 11111}
        folding.fold(spark, path, LAYOUT, sums, "r", 6, every=4)
        assert read(path) == {1: 11111}
    assert files.write_note is write


def test_stream_outputs_stay_short(spark, tmp_path, monkeypatch):
    """Rollup, newest readings and last firings after many micro-batches are few folders and right."""
    monkeypatch.setattr(folding.fold, "__defaults__", (3,))
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    rows = driver_tables.readings(spark, SMALL).orderBy("id").collect()
    for n in range(10):
        append(spark, rows[n::10], feed)
    rules, users = driver_tables.rules(spark, SMALL), driver_tables.users(spark, SMALL)
    stream = lambda: stream_of(spark, READINGS, feed)
    jobs.stream_latest(stream(), out, str(tmp_path / "cp1"), True).awaitTermination()
    jobs.stream_rollup(stream(), out, str(tmp_path / "cp2"), True).awaitTermination()
    jobs.stream_alerts(stream(), lambda: rules, lambda: users, out, str(tmp_path / "cp3"), True).awaitTermination()
    for name in ("latest", "rollup", "last_fired"):
        assert len(epochs(f"{out}/{name}")) <= 3 * 3
    everything = driver_tables.readings(spark, SMALL)
    assert same(recent.merge_latest(everything), jobs.read_latest(spark, out))
    assert jobs.read_rollup(spark, out).agg(F.sum("n_values")).first() == stats.rollup_15m(everything).agg(F.sum("n_values")).first()
    plan = jobs.read_latest(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert feed not in plan


def test_latest_reads_needed_days_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = [(n, 1, float(n), None, "C", at("2024-01-29 12:00:00") - dt.timedelta(hours=n)) for n in range(30)]
    rows += [(100, 2, 1.0, None, "C", at("2022-05-05 00:00:00")), (101, 2, 2.0, None, "C", at("2023-01-01 00:00:00"))]
    sinks.write_readings(spark.createDataFrame(rows, READINGS), path)
    stored = read_readings(spark, path)
    newest = recent.latest_of_days(stored, recent.day_counts(stored))
    assert sorted(r.id for r in newest.collect()) == [*range(10), 100, 101]
    assert "2024-01-28" not in newest._jdf.queryExecution().optimizedPlan().toString()


def day_files(path):
    import glob

    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in glob.glob(f"{path}/recorded_date=*/*.parquet")}


def fact(spark, path):
    """Three days of four sensors, a file per sensor and day."""
    for sensor in range(4):
        rows = [
            (sensor * 100 + d * 10 + n, sensor, 1.0, None, "C", at(f"2024-01-0{d + 1} 0{n}:00:00"))
            for d in range(3) for n in range(3) if (sensor, d) != (3, 1)
        ]
        sinks.write_readings(spark.createDataFrame(rows, READINGS).coalesce(1), path)
    return read_readings(spark, path)


def ids(spark, path):
    spark.catalog.refreshByPath(path)
    return sorted(r.id for r in read_readings(spark, path).select("id").collect())


def test_a_delete_rewrites_the_sensors_own_files(spark, tmp_path):
    path = str(tmp_path / "fact")
    before = ids(spark, (fact(spark, path), path)[1])
    there = day_files(path)
    gone = spark.createDataFrame([(3,), (77,)], "id bigint")
    assert retention.delete_sensor_files(spark, path, gone) == 2
    assert ids(spark, path) == [i for i in before if i < 300]
    assert len(there - day_files(path)) == 2 and day_files(path) < there
    assert retention.delete_sensor_files(spark, path, gone) == 0
    assert files.children(spark, path) == ["_SUCCESS", *[f"recorded_date=2024-01-0{d}" for d in (1, 2, 3)]]


def test_a_purge_rewrites_files_of_one_day(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact(spark, path)
    # Cutoff 2024-01-02 01:00: sensors 0 to 2 have a reading before it on that day.
    assert retention.purge_files(spark, path, at("2024-01-16 01:00:00")) == 3
    left = read_readings(spark, path)
    assert left.agg(F.min("recorded_at")).first()[0].isoformat() == "2024-01-02T01:00:00" and left.count() == 3 * 2 + 4 * 3
    assert retention.purge_files(spark, path, at("2024-02-16 01:00:00")) == 0 and ids(spark, path) == []


@pytest.mark.parametrize("crash_at", range(8))
def test_an_exchange_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch, crash_at):
    path, steps = str(tmp_path / "fact"), []
    before = ids(spark, (fact(spark, path), path)[1])
    plain = files.remove

    def crash(*args):
        steps.append(args)
        if len(steps) == crash_at + 1:
            raise InterruptedError
        return plain(*args)

    gone = spark.createDataFrame([(3,), (2,)], "id bigint")
    with monkeypatch.context() as patch:
        patch.setattr(files, "remove", crash)
        try:
            retention.delete_sensor_files(spark, path, gone)
        except InterruptedError:
            pass
    files.recover(spark, path)
    assert ids(spark, path) == [i for i in before if i < 200]


def test_compaction_merges_with_stored_readings(spark, tmp_path):
    out, path = str(tmp_path / "out"), str(tmp_path / "out" / "fact")
    reading = lambda n, sensor=1: (n, sensor, float(n), None, "C", at(f"2024-01-01 0{n % 10}:00:00"))
    sinks.write_readings(spark.createDataFrame([reading(1), reading(2), reading(3)], READINGS), path)
    for epoch, rows in enumerate([[reading(4), reading(5), reading(3)], [reading(5), reading(6, 2)]]):
        dated = spark.createDataFrame(rows, READINGS).withColumn("recorded_date", F.to_date("recorded_at"))
        sinks.write_epoch(dated, f"{out}/readings", "r", epoch, "recorded_date")
    gone = spark.createDataFrame([(2,)], "id bigint")
    compact = lambda: jobs.compact_readings(spark, out, path, *FACT_DAYS, gone)
    compact()
    assert ids(spark, path) == [1, 2, 3, 4, 5] and not epochs(f"{out}/readings")
    compact()
    assert ids(spark, path) == [1, 2, 3, 4, 5]
    # Deleted readings stay deleted, and a day that is added to after all is merged again.
    retention.delete_sensor_files(spark, path, spark.createDataFrame([(1,)], "id bigint"))
    dated = spark.createDataFrame([reading(7, 3)], READINGS).withColumn("recorded_date", F.to_date("recorded_at"))
    sinks.write_epoch(dated, f"{out}/readings", "r", 2, "recorded_date")
    compact()
    assert ids(spark, path) == [7]


def test_compaction_leaves_other_days_of_a_micro_batch(spark, tmp_path):
    out, path = str(tmp_path / "out"), str(tmp_path / "fact")
    rows = [(n, 1, 1.0, None, "C", at(f"2024-01-0{n} 00:00:00")) for n in (1, 2, 3)]
    dated = spark.createDataFrame(rows, READINGS).withColumn("recorded_date", F.to_date("recorded_at"))
    sinks.write_epoch(dated, f"{out}/readings", "r", 0, "recorded_date")
    jobs.compact_readings(spark, out, path, dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert ids(spark, path) == [1, 2]
    jobs.compact_readings(spark, out, path, dt.date(2024, 1, 1), dt.date(2024, 1, 9))
    assert ids(spark, path) == [1, 2, 3] and not epochs(f"{out}/readings")
