import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import DedupConfig
from gaugeworks.operators import dedup

T0 = datetime(2024, 1, 1)


def rows_to_df(spark, rows):
    """rows: (id, seconds, name, labels)."""
    data = [(i, T0 + timedelta(microseconds=round(s * 1e6)), n, m) for i, s, n, m in rows]
    return spark.createDataFrame(
        data, "id bigint, ts timestamp, name string, labels map<string,string>"
    )


def brute(rows, key, ttl):
    last, kept = {}, set()
    for i, s, n, m in sorted(rows, key=lambda r: (r[1], r[0])):
        k = key(n, m)
        if k is None:
            kept.add(i)
        elif k not in last or s - last[k] >= ttl:
            last[k] = s
            kept.add(i)
    return kept


def by_user(n, m):
    return (n, m["user"]) if "user" in m else None


def ids(df):
    out = [r.id for r in df.select("id").collect()]
    assert len(out) == len(set(out))
    return set(out)


def random_rows(seed, n=1500, names="ab", span=5000, users=3, grain=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        labels = {} if rng.random() < 0.05 else {"user": rng.choice([None, "x", "y"][:users])}
        # A third of everything is one key.
        name = "hot" if rng.random() < 0.34 else rng.choice(names)
        out.append((i, rng.randrange(0, span, grain), name, labels))
    rng.shuffle(out)
    return out


def test_ttl_edges(spark):
    rows = [
        (1, 0, "a", {}), (2, 0, "a", {}),  # same time: lower id first
        (3, 9.999999, "a", {}),  # inside
        (4, 10, "a", {}),  # exactly one TTL later: new
        (5, 15, "a", {}),  # duplicate of 4, does not extend it
        (6, 20, "a", {}),  # one TTL after 4
        (7, 5, "b", {}),
    ]
    got = dedup.dedup_ttl(rows_to_df(spark, rows), ["name"], "10s")
    assert ids(got) == {1, 4, 6, 7}


@pytest.mark.parametrize("seed, ttl", [(1, 60), (2, 700), (3, 1), (4, 100000)])
def test_scan_equals_sequential(spark, seed, ttl):
    rows = random_rows(seed)
    got = dedup.dedup_ttl(rows_to_df(spark, rows), ["name", "labels.user"], f"{ttl}s")
    assert ids(got) == brute(rows, by_user, ttl)


@pytest.mark.parametrize(
    "seed, ttl, span, grain",
    [
        (5, 60, 5000, 1),
        (6, 7, 5000, 1),
        (7, 900, 5000, 1),  # few cells, each larger than the bound
        (8, 100000, 5000, 1),  # one cell
        (9, 30, 400000, 1000),  # mostly empty cells, many equal times
        (10, 333, 333 * 40, 333),  # every row on a cell border
    ],
)
def test_heavy_keys_equal_sequential(spark, seed, ttl, span, grain):
    rows = random_rows(seed, n=700, span=span, grain=grain)
    df = rows_to_df(spark, rows)
    got = dedup.dedup_ttl(df, ["name", "labels.user"], f"{ttl}s", heavy_rows=20)
    assert ids(got) == brute(rows, by_user, ttl)


def test_heavy_key_of_copies(spark):
    """All rows of a heavy key at few times: settled after the copies are combined."""
    rows = [(i, (i % 4) * 10, "a", {}) for i in range(400)]
    got = dedup.dedup_ttl(rows_to_df(spark, rows), ["name"], "15s", heavy_rows=50)
    assert ids(got) == brute(rows, lambda n, m: n, 15)


@pytest.mark.parametrize("heavy_rows", [None, 25])
def test_kept_rows_are_apart_and_dropped_rows_near_one(spark, heavy_rows):
    rows = random_rows(11, n=300)
    df = rows_to_df(spark, rows)
    kept_ids = ids(
        dedup.dedup_ttl(df, ["name", "labels.user"], "60s", heavy_rows=heavy_rows)
    )
    kept = {}
    for i, t, name, labels in rows:
        if i in kept_ids and "user" in labels:
            kept.setdefault((name, labels["user"]), []).append(t)
    for times in kept.values():
        times.sort()
        assert all(b - a >= 60 for a, b in zip(times, times[1:]))
    for i, t, name, labels in rows:
        if i not in kept_ids:
            assert any(0 <= t - k < 60 for k in kept[name, labels["user"]])


@pytest.mark.parametrize("heavy_rows", [None, 5])
def test_copies_of_a_row(spark, heavy_rows):
    """Rows sent again with the same id and time are duplicates; unkeyed ones are not."""
    rows = [(1, 0, "a", {"n": str(i % 3)}) for i in range(30)] + [(2, 9, "a", {})] * 30
    df = rows_to_df(spark, rows)
    got = dedup.dedup_ttl(df, ["name"], "5s", heavy_rows=heavy_rows).collect()
    assert sorted(r.id for r in got) == [1, 2]
    assert dedup.dedup_first(df, ["name"]).count() == 1
    assert dedup.dedup_ttl(df, ["labels.x"], "5s", heavy_rows=heavy_rows).count() == 60
    assert dedup.dedup_first(df, ["labels.x"]).count() == 60


def test_later_filter_does_not_reach_into_the_scan(spark):
    rows = random_rows(12, n=400)
    out = dedup.dedup_ttl(rows_to_df(spark, rows), ["name", "labels.user"], "60s")
    odd = out.filter("id % 2 = 1")
    assert ids(odd) == {i for i in brute(rows, by_user, 60) if i % 2}


def test_unkeyed_and_undated_rows_pass(spark):
    df = rows_to_df(spark, [(1, 0, "a", {}), (2, 0, "a", {}), (3, 0, "a", {"user": None}),
                            (4, 0, "a", {"user": None})])
    undated = df.withColumn("ts", F.when(F.col("id") != 4, F.col("ts")))
    # A present null is a key value; an absent label is not.
    assert ids(dedup.dedup_ttl(df, ["name", "labels.user"], "1h")) == {1, 2, 3}
    assert ids(dedup.dedup_first(df, ["labels.user", "name"])) == {1, 2, 3}
    assert ids(dedup.dedup_ttl(undated, ["name", "labels.user"], "1h")) == {1, 2, 3, 4}


def test_disabled_is_identity(spark):
    df = rows_to_df(spark, random_rows(13, n=50))
    assert dedup.dedup(df, DedupConfig([], enabled=False)) is df


@pytest.mark.parametrize("heavy_rows", [None, 20])
def test_runs_with_store_equal_one_run(spark, heavy_rows):
    rows = random_rows(14, n=600)
    df = rows_to_df(spark, rows)
    keys = ["name", "labels.user"]
    store = dedup.dedup_key(df.limit(0), keys).select(
        "dedup_key", F.col("ts").alias("last_kept")
    )
    got = set()
    for low, high in [(0, 1000), (1000, 1100), (1100, 5000)]:
        part = df.filter(
            (F.unix_seconds("ts") >= int(T0.timestamp()) + low)
            & (F.unix_seconds("ts") < int(T0.timestamp()) + high)
        )
        kept, store = dedup.dedup_against_store(part, store, keys, "70s", heavy_rows=heavy_rows)
        got |= ids(kept)
        store = spark.createDataFrame(
            store.collect(), store.schema
        )
    assert got == brute(rows, by_user, 70)


def test_replay_bypasses_the_store(spark):
    df = rows_to_df(spark, [(1, 0, "a", {}), (2, 1, "a", {})]).withColumn("replay", F.lit(True))
    seen = dedup.dedup_key(df, ["name"]).select("dedup_key", F.col("ts").alias("last_kept"))
    kept, store = dedup.dedup_against_store(df, seen, ["name"], "1h", replay="replay")
    assert ids(kept) == {1, 2}
    kept, _ = dedup.dedup_against_store(df, seen, ["name"], "1h")
    assert ids(kept) == set()
    assert store.count() == 1


def test_expiry_is_strict(spark):
    df = rows_to_df(spark, [(1, 0, "a", {}), (2, 1, "b", {})])
    seen = dedup.dedup_key(df, ["name"]).select("dedup_key", F.col("ts").alias("last_kept"))
    now = F.lit(T0 + timedelta(seconds=10))
    left = dedup.expire_seen(seen, now, "10s")
    assert {r.dedup_key.name for r in left.collect()} == {"a", "b"}
    assert dedup.expire_seen(seen, now, "9s").count() == 1


def test_counts(spark):
    rows = random_rows(15, n=300)
    got = dedup.dedup_counts(rows_to_df(spark, rows), ["name", "labels.user"], "60s").collect()
    keyed = [r for r in rows if "user" in r[3]]
    assert sum(r.seen for r in got) == len(keyed)
    assert all(r.seen == r.kept + r.dropped for r in got)
    kept = brute(rows, by_user, 60) & {r[0] for r in keyed}
    assert sum(r.kept for r in got) == len(kept)


def test_follow_against_a_loop():
    rng = random.Random(7)
    for _ in range(60):
        ttl, keys = rng.choice([1, 3, 10, 10**15]), []
        for _ in range(rng.randrange(1, 12)):
            scale = rng.choice([1, 10**6, 10**16])
            keys.append(sorted(rng.randrange(-20, 60) * scale for _ in range(rng.randrange(1, 30))))
        flat = [(t, i == 0) for k in keys for i, t in enumerate(k)]
        want, due = [], None
        for t, head in flat:
            kept = head or t >= due
            due = t + ttl if kept else due
            want.append(kept)
        got, left = [], None
        at = 0
        while at < len(flat):  # in batches of any size
            part = flat[at : at + rng.randrange(1, 40)]
            at += len(part)
            us = dedup.np.array([t for t, _ in part])
            marks, left = dedup.follow(us, us + ttl, dedup.np.array([h for _, h in part]), left)
            got += marks.tolist()
        assert got == want and left == due


@pytest.mark.parametrize("heavy_rows", [None, 20, 3])
def test_null_and_equal_ids_keep_the_same_rows_on_all_paths(spark, heavy_rows):
    rng = random.Random(3)
    rows = [
        (rng.choice([None, None, 1, 2]), rng.randrange(0, 40), rng.choice(["hot", "hot", "a"]), {"user": "x", "n": str(i)})
        for i in range(150)
    ]
    df = rows_to_df(spark, rows)

    def shown(out):
        return sorted((r.id is not None, r.id or 0, r.ts, r.name, r.labels["n"]) for r in out.collect())

    want = shown(dedup.dedup_ttl(df, ["name"], "5s", heavy_rows=None))
    assert shown(dedup.dedup_ttl(df.repartition(3), ["name"], "5s", heavy_rows=heavy_rows)) == want
    by_key: dict = {}
    for i, s, n, m in sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0)):
        last = by_key.setdefault(n, [])
        if not last or s >= last[-1][0] + 5:
            last.append((s, i))
    assert sorted((n, s) for n, k in by_key.items() for s, _ in k) == sorted(
        (n, (t - T0).total_seconds()) for _, _, t, n, _ in want
    )
    # The row kept of a time is one with the least id, null first.
    least = {(n, s): i for n, k in by_key.items() for s, i in k}
    assert all((i if there else None) == least[n, (t - T0).total_seconds()] for there, i, t, n, _ in want)
