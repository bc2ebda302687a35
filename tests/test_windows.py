"""Windows on streams and in store, and lookups on streams, against the batch operators."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, T0, fail_in_run, land, rows, stream

from gaugeworks.model import AggRule
from gaugeworks.operators import enrich
from gaugeworks.operators.aggregate import aggregate, aggregate_anchored
from gaugeworks.operators.windows import add_points, stored_windows
from gaugeworks.sources.ledger import Conflict, Ledger
from gaugeworks.streaming.aggregate import aggregate_anchored_stream, revised_windows, stored_windows_stream
from gaugeworks.streaming.enrich import as_of_stream
from gaugeworks.streaming.run import run_available

RULES = [
    AggRule("hot", "sum", ["u"]), AggRule("hot", "avg"), AggRule("a", "histogram", ["u"], [50, 100]),
    AggRule("b", "min"), AggRule("b", "max", ["u"]),
]


def shown(df, *drop):
    columns = sorted(set(df.columns) - set(drop))
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_revised_windows_equal_batch_open_ones_included(spark, tmp_path, parts):
    data = rows(seed=21)
    land(spark, str(tmp_path / "in"), data, parts)
    points = stream(spark, str(tmp_path / "in"))
    out = revised_windows(points, RULES, str(tmp_path / "out"), str(tmp_path / "state"), 600, "10 minutes", exact=True)
    assert shown(out, "row") == shown(aggregate(spark.createDataFrame(data, SCHEMA), RULES, 600, exact=True))


def test_revised_windows_after_a_failure(spark, tmp_path, monkeypatch):
    data, path = rows(seed=22), str(tmp_path / "in")
    land(spark, path, data, 3)

    def run():
        return revised_windows(stream(spark, path), RULES, str(tmp_path / "out"), str(tmp_path / "state"), 600, exact=True)

    with monkeypatch.context() as m:
        fail_in_run(m, "after", 2)
        with pytest.raises(Exception, match="stopped"):
            run()
    assert shown(run()) == shown(aggregate(spark.createDataFrame(data, SCHEMA), RULES, 600, exact=True))


def test_stored_windows_take_in_what_comes_later(spark, tmp_path):
    data = [(*r[:3], v, r[4]) for r, v in zip(rows(seed=23), [float("nan"), 0.1, 1e300, -0.25, 7.5] * 200)]
    data.append((9999, None, "hot", 3.0, {}))
    data.append((9998, T0 + timedelta(days=3), "hot", 3.0, {"u": "x"}))
    table = spark.createDataFrame(data, SCHEMA)
    late = F.col("id") % 5 == 0
    path = str(tmp_path / "in")
    land(spark, path, [r for r in data if r[0] % 5], 3)
    stored_windows_stream(stream(spark, path), RULES, str(tmp_path / "out"), str(tmp_path / "state"), 600, exact=True)
    ledger = Ledger(spark, str(tmp_path / "out"))
    before = ledger.snapshot()
    for _ in range(2):
        add_points(ledger, 0, table.filter(late & (F.col("ts") < T0 + timedelta(days=1))), RULES, 600, "replayed")
    after = ledger.snapshot()
    assert after.version == before.version + 1
    changed = {d for d in after.of("windows") if after.of("windows")[d] != before.of("windows").get(d)}
    assert changed == {"2024-01-01"} and set(before.of("windows")) == {"2024-01-01", "2024-01-04", "undated"}
    want = aggregate(table, RULES, 600, exact=True)
    assert shown(stored_windows(ledger, RULES, 600, exact=True)) == shown(want)


def test_two_runs_that_meet_on_a_day(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame(rows(seed=24), SCHEMA)
    ledger, write = Ledger(spark, str(tmp_path)), Ledger.write
    other = [True]

    def overtaken(self, *args):
        if other.pop() if other else False:
            add_points(Ledger(spark, str(tmp_path)), 0, table.filter("id % 2 = 1"), RULES, 600, "other")
        return write(self, *args)

    monkeypatch.setattr(Ledger, "write", overtaken)
    with pytest.raises(Conflict):
        add_points(ledger, 0, table.filter("id % 2 = 0"), RULES, 600)
    add_points(ledger, 0, table.filter("id % 2 = 0"), RULES, 600)
    assert shown(stored_windows(ledger, RULES, 600, exact=True)) == shown(aggregate(table, RULES, 600, exact=True))


@pytest.mark.parametrize("parts", [1, 4])
def test_anchored_windows_on_a_stream(spark, tmp_path, parts):
    # A gap of hours, after which windows keep to the grid; sums of whole numbers are exact.
    data = rows(seed=25)
    data = data[:200] + [(r[0], r[1] + timedelta(hours=5), *r[2:]) for r in data[200:]]
    land(spark, str(tmp_path / "in"), data, parts)
    points = stream(spark, str(tmp_path / "in"))
    out = run_available(
        aggregate_anchored_stream(points, RULES, 600, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state")
    )
    closed = max(r[1] for r in data) - timedelta(minutes=10)
    batch = aggregate_anchored(spark.createDataFrame(data, SCHEMA), RULES, 600)
    want = batch.filter(F.col("window_start") + F.expr("interval 600 seconds") <= F.lit(closed))
    assert shown(out) == shown(want) and want.count() > 50


@pytest.mark.parametrize("parts", [1, 5])
def test_lookups_on_streams(spark, tmp_path, parts):
    rng = random.Random(26)
    points = [(i, T0 + timedelta(seconds=rng.randrange(20_000)), rng.choice(["a", "b", "c", None]), {"n": str(i)}) for i in range(400)]
    points.append((999, None, "a", {}))
    facts = [(h, T0 + timedelta(seconds=s), s) for h, s in {(rng.choice("ab"), rng.randrange(20_000)) for _ in range(60)}]
    points.append((1000, T0 + timedelta(seconds=40_000), "a", {}))
    facts.append(("a", T0 + timedelta(seconds=40_000), 1))
    kinds = "id bigint, ts timestamp, host string, labels map<string,string>", "hostname string, collected_at timestamp, cpus int"
    read = []
    for name, data, kind in (("points", points, kinds[0]), ("facts", facts, kinds[1])):
        path = str(tmp_path / name)
        # In order by parts, in any order inside them.
        data = sorted(data, key=lambda r: (r[1] is None, r[1] or T0))
        size = -(-len(data) // parts)
        for p in range(parts):
            part = data[p * size : (p + 1) * size]
            rng.shuffle(part)
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{path}/{p}")
        read.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"))
    found = as_of_stream(*read, "host", "hostname", ["cpus"], "30m", delay="4 hours", lanes=3)
    out = run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
    want = enrich.as_of(spark.createDataFrame(points, kinds[0]), spark.createDataFrame(facts, kinds[1]), "host", "hostname", ["cpus"], "30m")
    # The last two have no later row to move the watermark past them.
    assert shown(out) == shown(want.filter("id is not null and id <> 1000"))
    assert out.filter("snapshot is not null").count() > 50


@pytest.mark.parametrize("buckets, chunk_rows", [(1, 30), (4, 20_000)])
def test_lookups_of_many_keys_are_made_by_the_bucket(spark, tmp_path, monkeypatch, buckets, chunk_rows):
    """A state and a timer for each key and minute is what a stream of many points spends its time on."""
    monkeypatch.setattr("gaugeworks.streaming.enrich.CHUNK_ROWS", chunk_rows)
    rng = random.Random(27)
    at = lambda: T0 + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(2))
    points = [(i, at(), rng.choice([None, "", *map(str, range(300))]), {"n": str(i)}) for i in range(3000)]
    facts = [(rng.choice([None, "", *map(str, range(320))]), at(), 1000 + i) for i in range(1500)]
    # Snapshots of one key and time: the greater holds, in text as in number; points at the very time of one.
    facts += [(h, t, c + 1) for h, t, c in facts[::9]]
    points += [(3000 + i, t, h, {}) for i, (h, t, _) in enumerate(facts[::5])] + [(9000 + i, None, "1", {}) for i in range(40)]
    end = T0 + timedelta(seconds=60_000)
    kinds = "id bigint, ts timestamp, host string, labels map<string,string>", "hostname string, collected_at timestamp, cpus int"
    for half in (0, 1):
        read = []
        for name, data, kind in (("points", [*points, (99_999, end, "1", {})], kinds[0]), ("facts", facts, kinds[1])):
            path = str(tmp_path / name)
            data = sorted(data, key=lambda r: (r[1] is not None, r[1] or T0))
            size = -(-len(data) // 6)
            for p in range(3 * half, 3 * half + 3):
                part = data[p * size : (p + 1) * size]
                rng.shuffle(part)
                spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{path}/{p}")
            read.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"))
        # The second half goes on from the state of the first.
        found = as_of_stream(*read, "host", "hostname", ["cpus"], "2h", delay="2 hours", lanes=2, buckets=buckets)
        out = run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
    want = enrich.as_of(spark.createDataFrame(points, kinds[0]), spark.createDataFrame(facts, kinds[1]), "host", "hostname", ["cpus"], "2h")
    assert shown(out) == shown(want)
    assert out.filter("snapshot is not null").count() > 500
    state = spark.read.format("statestore").option("stateVarName", "facts").load(str(tmp_path / "state"))
    assert 0 < state.count() <= 2 * buckets


@pytest.mark.parametrize("buckets, held_rows", [(1, 40), (5, 200_000)])
def test_anchored_windows_of_many_groups_are_kept_by_the_bucket(spark, tmp_path, monkeypatch, buckets, held_rows):
    """A state and a timer for each group and window is what a stream of many groups spends its time on."""
    monkeypatch.setattr("gaugeworks.streaming.aggregate.HELD_ROWS", held_rows)
    rng = random.Random(28)
    data = []
    for i in range(3000):
        labels = {} if rng.random() < 0.1 else {"u": rng.choice([None, "", *map(str, range(200))])}
        name = rng.choice(["hot", "a", "b"])
        # A sum that is NaN comes back from Python as null.
        value = rng.choice([None, float(rng.randrange(-50, 150)), 70.0, 100.0, *[float("nan")] * (name != "hot")])
        data.append((i, T0 + timedelta(seconds=rng.randrange(30_000), microseconds=rng.randrange(3)), name, value, labels))
    data = sorted(data, key=lambda r: r[1])
    for half in (0, 1):
        for p in (2 * half, 2 * half + 1):
            part = data[p * 750 : (p + 1) * 750]
            rng.shuffle(part)
            land(spark, str(tmp_path / "in"), part, 1, 10 * half + p)
        # The second half goes on from the state of the first.
        windows = aggregate_anchored_stream(stream(spark, str(tmp_path / "in")), RULES, 600, "10 minutes", buckets=buckets)
        out = run_available(windows, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = max(r[1] for r in data) - timedelta(minutes=10, milliseconds=1)
    end = F.col("window_start") + F.expr("interval 600 seconds") <= F.lit(closed)
    batch = aggregate_anchored(spark.createDataFrame(data, SCHEMA), RULES, 600)
    assert shown(out.filter(end)) == shown(batch.filter(end)) and batch.filter(end).count() > 1000
    state = spark.read.format("statestore").option("stateVarName", "anchors").load(str(tmp_path / "state"))
    assert 0 < state.count() <= buckets
