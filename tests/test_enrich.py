import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import HOST
from gaugeworks.operators import enrich

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def hosts(spark, rows):
    """rows: (hostname, ip, seconds, cpus, {pid: command})."""
    data = [
        (h, ip, "linux", "x86", c, 0,
         {p: (p, cmd, "u", T0, 0.0, 0) for p, cmd in procs.items()}, at(s))
        for h, ip, s, c, procs in rows
    ]
    return spark.createDataFrame(data, HOST)


def points(spark, rows):
    """rows: (id, seconds, hostname, ip, pid)."""
    return spark.createDataFrame(
        [(i, at(s), h, ip, p, {"n": str(i)}) for i, s, h, ip, p in rows],
        "id bigint, ts timestamp, hostname string, ip string, pid int, labels map<string,string>",
    )


SNAPSHOTS = [
    ("a", "1.1.1.1", 0, 1, {7: "first"}),
    ("a", "1.1.1.1", 100, 2, {8: "second"}),
    ("b", "2.2.2.2", 50, 3, {}),
]
ASKED = [
    (1, 0, "a", None, 7),  # at the snapshot's own time
    (2, 10, "a", None, 7),  # exactly one TTL old: hit
    (3, 11, "a", None, 7),  # older than the TTL: miss
    (4, 105, "a", None, 7),  # the later snapshot hides the pid of the first
    (5, 105, None, "1.1.1.1", 8),  # by address
    (6, 55, "nobody", "2.2.2.2", 1),  # unknown name, known address
    (7, 55, "a", "2.2.2.2", 1),  # name is too old, address answers
    (8, -1, "a", None, 7),  # before any snapshot
    (9, 105, None, None, 8),
]


@pytest.mark.parametrize("small", [0, 1000])
def test_host_edges(spark, small):
    out = enrich.enrich_host(
        points(spark, ASKED), hosts(spark, SNAPSHOTS), "10s", ip="ip", small=small
    ).collect()
    got = {r.id: r.host_info.cpu_count if r.host_hit else None for r in out}
    assert got == {1: 1, 2: 1, 3: None, 4: 2, 5: 2, 6: 3, 7: 3, 8: None, 9: None}
    assert len(out) == len(ASKED)


@pytest.mark.parametrize("small", [0, 1000])
def test_process_edges(spark, small):
    out = enrich.enrich_process(
        points(spark, ASKED), hosts(spark, SNAPSHOTS), "10s", small=small
    ).collect()
    got = {r.id: r.process.command_line if r.process_hit else None for r in out}
    assert got == {
        1: "first", 2: "first", 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, 9: None,
    }


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("ttl", [0, 3, 50, 5000])
def test_as_of_equals_brute_force(spark, small, ttl):
    rng = random.Random(ttl)
    snaps = [("hot" if rng.random() < 0.4 else rng.choice("abc"), "", rng.randrange(1000), i, {})
             for i in range(150)]
    asked = [(i, rng.randrange(-10, 1010), "hot" if rng.random() < 0.4 else rng.choice("abcd"),
              None, 0) for i in range(400)]
    expected = {}
    for i, s, h, _, _ in asked:
        # Equal times of one host: the larger fact stands, as for one overwritten entry.
        before = [(t, c) for k, _, t, c, _ in snaps if k == h and t <= s]
        best = max(before, default=None)
        expected[i] = best[1] if best and s - best[0] <= ttl else None
    out = enrich.enrich_host(
        points(spark, asked), hosts(spark, snaps), f"{ttl}s", values=["cpu_count"], small=small
    ).collect()
    assert {r.id: r.host_info.cpu_count if r.host_hit else None for r in out} == expected
    assert len(out) == len(asked)


def test_latest_and_expiry(spark):
    table = hosts(spark, SNAPSHOTS)
    latest = enrich.latest_snapshot(table).collect()
    assert {(r.hostname, r.cpu_count) for r in latest} == {("a", 2), ("b", 3)}
    now = F.lit(at(100))
    left = enrich.expire_snapshots(table, now, "50s").collect()
    assert {(r.hostname, r.cpu_count) for r in left} == {("a", 2), ("b", 3)}
    assert enrich.expire_snapshots(table, now, "49s").count() == 1


def test_pods_never_lose_or_copy_points(spark):
    df = spark.createDataFrame(
        [(1, {"namespace": "n", "pod": "p"}), (2, {"namespace": "n", "pod": "q"}),
         (3, {"pod": "p"}), (4, {})],
        "id bigint, labels map<string,string>",
    )
    pods = spark.createDataFrame(
        [("n", "p", "node1", "d1"), ("n", "p", "node1", "d1"), ("m", "q", "node2", "d2")],
        "namespace string, pod string, node string, deployment string",
    )
    got = {r.id: r for r in enrich.enrich_k8s(df, pods).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].labels["k8s.node"] == "node1" and got[1].pod_hit
    assert not got[2].pod_hit and got[2].labels == {"namespace": "n", "pod": "q"}
    assert got[4].labels == {}


def test_small_snapshots_leave_points_unshuffled(spark):
    out = enrich.as_of(
        points(spark, ASKED), hosts(spark, SNAPSHOTS), "hostname", "hostname", ["os"], "10s"
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("small, group_rows", [(0, 500_000), (0, 3), (10, 500_000)])
def test_all_ways_of_the_lookup_agree(spark, small, group_rows):
    """Null keys, null times and ties, on the broadcast way, the merge, and the merge in groups."""
    rng = random.Random(4)
    seconds = [None, *range(0, 60, 5)]
    facts = [(rng.choice(["a", "a", "b", None]), rng.choice(seconds), i) for i in range(40)]
    points = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(seconds)) for i in range(200)]
    at = lambda s: None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)
    hosts = spark.createDataFrame([(h, at(s), v) for h, s, v in facts], "h string, collected_at timestamp, v int")
    df = spark.createDataFrame([(i, k, at(s)) for i, k, s in points], "id int, k string, ts timestamp")
    out = enrich.as_of(df, hosts, "k", "h", ["v"], "12s", small=small, group_rows=group_rows)
    got = {r.id: r.snapshot and r.snapshot.v for r in out.collect()}
    want = {}
    for i, k, s in points:
        fit = [(t, v) for h, t, v in facts if k is not None and h == k and t is not None and s is not None and t <= s <= t + 12]
        want[i] = max(fit)[1] if fit else None
    assert got == want


def test_points_that_ask_for_nothing_are_not_gathered(spark):
    asked = [(i, i % 50, None if i % 2 else "a", None, 7) for i in range(4000)]
    df = points(spark, asked).withColumn("ts", F.when(F.col("id") % 8 != 6, F.col("ts")))
    out = enrich.enrich_host(df.repartition(8), hosts(spark, SNAPSHOTS), "10s", small=0, group_rows=100)
    # Half have no host and an eighth no time: they stay in the tasks they are in.
    misses = out.filter("hostname is null").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(misses) == 8 and max(r["count"] for r in misses) < 400
    assert out.count() == 4000 and out.filter("host_hit and hostname is null").count() == 0
    assert out.filter("host_hit").count() == sum(1 for i, s, h, _, _ in asked if h and i % 8 != 6 and s <= 10)
