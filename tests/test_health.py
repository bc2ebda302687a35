import random
from datetime import datetime, timedelta, timezone


from pyspark.sql import Observation
from pyspark.sql import functions as F

from gaugeworks.operators import health

T0 = datetime(2024, 1, 1)


def test_transitions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.choice("xyz"),
             T0 + timedelta(seconds=rng.randrange(100_000))) for i in range(600)]
    expected = []
    for e in {r[1] for r in rows}:
        line = sorted((t, i, s) for i, k, s, t in rows if k == e)
        expected += [(e, a[2], b[2], round((b[0] - a[0]).total_seconds() * 1e6))
                     for a, b in zip(line, line[1:])]
    df = spark.createDataFrame(rows, "id bigint, entity string, state string, ts timestamp")
    for slice_seconds in (60, 3600, 10_000_000):
        steps = health.state_transitions(df, "entity", "state", slice_seconds=slice_seconds)
        assert sorted(map(tuple, steps.collect())) == sorted(expected)
    counts = health.transition_counts(steps).collect()
    assert sum(r.transitions for r in counts) == sum(x[1] != x[2] for x in expected)


def test_trips_need_enough_requests(spark):
    rows = [("few", i, True) for i in range(19)]
    rows += [("half", i, i % 2 == 0) for i in range(20)]
    rows += [("fine", i, i < 9) for i in range(20)]
    rows += [("half", 60 + i, True) for i in range(5)]
    df = spark.createDataFrame(
        [(d, T0 + timedelta(seconds=s), f) for d, s, f in rows], "d string, ts timestamp, f boolean")
    got = {(r.d, r.window_start.minute): r.tripped for r in health.error_rate_trips(df, "d", "f").collect()}
    assert got == {("few", 0): False, ("half", 0): True, ("fine", 0): False, ("half", 1): False}


def test_latency_buckets(spark):
    df = spark.createDataFrame([(0.001,), (0.0011,), (10.0,), (10.1,)], "s double")
    got = {r.le: r["count"] for r in health.latency_histogram(df, "s").collect()}
    assert got["0.001"] == 1 and got["0.005"] == 2 and got["10"] == 3 and got["+Inf"] == 4
    assert len(got) == 13
    assert health.latency_histogram(df.filter("s > 99"), "s").count() == 0


def test_rule_versions(spark):
    versions = spark.createDataFrame(
        [("r", "m", 1, 1, 10.0), ("r", "m", 5, 2, 50.0), ("r", "m", 5, 3, 99.0), ("r", "m", 3, 4, 30.0),
         ("q", "m", 2, 1, 2.0)],
        "rule_id string, name string, generation bigint, seq bigint, t double")
    assert health.accepted_versions(versions).count() == 3
    points = spark.createDataFrame(
        [(i, "m", g) for i, g in enumerate([0, 1, 2, 4, 5, 9, None])] + [(99, "other", 1)],
        "id int, name string, config_generation bigint")
    rows = health.rules_as_of(points, versions, ["name"]).collect()
    got = {(r.id, r.rule_id): r.t for r in rows}
    assert got == {
        (0, "r"): 50.0, (0, "q"): 2.0, (1, "r"): 10.0, (2, "r"): 10.0, (2, "q"): 2.0,
        (3, "r"): 10.0, (3, "q"): 2.0, (4, "r"): 50.0, (4, "q"): 2.0, (5, "r"): 50.0,
        (5, "q"): 2.0, (6, "r"): 50.0, (6, "q"): 2.0, (99, None): None,
    }


def test_stage_counts(spark):
    df = spark.createDataFrame(
        [("gw", 1, None, False), ("gw", 2, "ERR_INVALID_INPUT", True), ("gw", 3, None, False),
         ("gw", 2, "ERR_FORWARDING_FAILED", True), ("dp", 2, "ERR_PROCESSING_FAILED", False)],
        "stage string, status int, error_code string, sent_to_dlq boolean")
    got = {r.stage: r.asDict() for r in health.stage_counts(df).collect()}
    assert got["gw"] == {"stage": "gw", "received": 4, "forwarded": 1, "processed": 3, "rejected": 2,
                         "dlq": 2, "processing_errors": 0, "validation_errors": 1}
    assert got["dp"]["processing_errors"] == 1


def test_observed_counts(spark):
    seen = Observation("stage")
    df = spark.range(10).withColumn("ok", F.col("id") > 2)
    assert health.observed(df, seen, passed=F.col("ok")).count() == 10
    assert seen.get == {"received": 10, "passed": 7}


def test_dense_slices_are_made_shorter(spark):
    rows = [(i, T0 + timedelta(microseconds=37 * i), "e" if i % 3 else "f", f"s{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, entity string, state string")
    shown = lambda out: sorted(map(tuple, out.collect()))
    whole = shown(health.state_transitions(df, "entity", "state"))
    assert len(whole) == 398
    assert shown(health.state_transitions(df, "entity", "state", slice_rows=20)) == whole
    assert shown(health.state_transitions(df, "entity", "state", slice_rows=1)) == whole


def test_one_dense_second_leaves_other_slices_alone(spark):
    # A thousand events in one second of one entity, among ten days of two.
    rows = [(i, T0 + timedelta(seconds=864 * i), "ef"[i % 2], f"s{i % 5}") for i in range(1000)]
    rows += [(2000 + i, T0 + timedelta(hours=30, microseconds=997 * i), "e", f"s{i % 3}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, entity string, state string")
    whole = sorted(map(tuple, health.state_transitions(df, "entity", "state").collect()))
    cut = sorted(map(tuple, health.state_transitions(df, "entity", "state", slice_rows=50).collect()))
    assert cut == whole and len(whole) == 1998
    width = 3_600_000_000
    us = F.unix_micros("ts")
    sliced = df.select("entity", "state", us.alias("us"), "id", F.floor(us / width).cast("bigint").alias("hour"))
    dense = health._dense_slices(sliced, width, 50).collect()
    assert [(r._entity, r._hour) for r in dense] == [("e", int(T0.replace(tzinfo=timezone.utc).timestamp()) // 3600 + 30)]
    # Of its width at most fifty events share a part, and sixteen times that would be too many.
    assert dense[0]._width <= 50 * 997 < 16 * dense[0]._width
