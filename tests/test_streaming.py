import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import AggRule, Endpoint
from gaugeworks.operators.aggregate import aggregate
from gaugeworks.operators.dedup import dedup_against_store, dedup_ttl, empty_store, expire_seen
from gaugeworks.operators.export import exported
from gaugeworks.streaming.aggregate import aggregate_stream
from gaugeworks.session import written
from gaugeworks.sources.ledger import Ledger
from gaugeworks.streaming.dedup import dedup_stream_with_store, dedup_ttl_stream, stream_store
from gaugeworks.streaming.export import export_stream
from gaugeworks.streaming.run import run_available

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, name string, value double, labels map<string,string>"


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        labels = {} if rng.random() < 0.1 else {"u": rng.choice("xy")}
        name = "hot" if rng.random() < 0.4 else rng.choice("ab")
        out.append((i, T0 + timedelta(seconds=rng.randrange(7200)), name, float(i), labels))
    # Some rows are sent twice.
    return sorted(out + out[::20], key=lambda r: (r[1], r[0]))


def land(spark, path, data, parts, first=0):
    """Files in time order, read one per trigger."""
    size = -(-len(data) // parts)
    for p in range(parts):
        part = spark.createDataFrame(data[p * size:(p + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{path}/{first + p:03d}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.mark.parametrize("parts", [1, 4])
def test_dedup_equals_batch(spark, tmp_path, parts):
    data = rows()
    land(spark, str(tmp_path / "in"), data, parts)
    out = run_available(
        dedup_ttl_stream(stream(spark, str(tmp_path / "in")), ["name", "labels.u"], "5m"),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))


def test_dedup_goes_on_after_a_restart(spark, tmp_path):
    data = rows(seed=2)
    path = str(tmp_path / "in")
    for first, half in ((0, data[:150]), (10, data[150:])):
        land(spark, path, half, 2, first)
        out = run_available(
            dedup_ttl_stream(stream(spark, path), ["name", "labels.u"], "5m"),
            str(tmp_path / "out"), str(tmp_path / "state"),
        )
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert {r.id for r in out.collect()} == {r.id for r in batch.collect()}


@pytest.mark.parametrize("heavy_rows", [None, 15])
def test_dedup_with_store_equals_batch(spark, tmp_path, heavy_rows):
    data = rows(seed=5)
    path = str(tmp_path / "in")
    for first, half in ((0, data[:150]), (10, data[150:])):
        land(spark, path, half, 2, first)
        out = dedup_stream_with_store(
            stream(spark, path), ["name", "labels.u"], "5m", str(tmp_path / "out"),
            str(tmp_path / "state"), delay="10m", heavy_rows=heavy_rows,
        )
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
    ledger = Ledger(spark, str(tmp_path / "out"))
    assert ledger.snapshot().notes["stream"] == 3 and len(ledger.snapshot().of("seen")) == 4


def test_the_store_is_put_together_and_expires(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gaugeworks.streaming.dedup.STORE_FANOUT", 2)
    data, path = rows(seed=6), str(tmp_path / "in")
    land(spark, path, data, 7)
    out = dedup_stream_with_store(
        stream(spark, path), ["name", "labels.u"], "5m", str(tmp_path / "out"), str(tmp_path / "state"), delay="10m"
    )
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
    ledger = Ledger(spark, str(tmp_path / "out"))
    # Seven runs: levels 2, 1 and 0, as the digits of seven in base two.
    assert sorted(s.split("-")[0] for s in ledger.snapshot().of("seen")) == ["0", "1", "2"]
    # Two versions hold; what they dropped is gone.
    held = {f for v in (-2, -1) for f in ledger.snapshot(ledger._versions()[v]).of("seen").values()}
    assert {f"seen/{p.name}" for p in (tmp_path / "out/seen").iterdir()} == held


@pytest.mark.parametrize("at", ["kept", "seen", "commit", "after"])
def test_a_run_that_fails_is_done_once(spark, tmp_path, monkeypatch, at):
    data, path = rows(seed=8), str(tmp_path / "in")
    land(spark, path, data, 3)

    def run():
        return dedup_stream_with_store(
            stream(spark, path), ["name", "labels.u"], "5m", str(tmp_path / "out"), str(tmp_path / "state"), delay="10m"
        )

    with monkeypatch.context() as m:
        fail_in_run(m, at, 2)
        with pytest.raises(Exception, match="stopped"):
            run()
    assert Ledger(spark, str(tmp_path / "out")).done(1 if at == "after" else 0)
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert sorted(map(str, run().collect())) == sorted(map(str, batch.collect()))


def fail_in_run(m, at, times):
    """Stop at the `times`-th write of a table, or before or after that commit."""
    write, commit, seen = Ledger.write, Ledger.commit, [0]

    def writing(self, df, table, *args):
        seen[0] += table == at
        if table == at and seen[0] == times:
            raise RuntimeError("stopped")
        return write(self, df, table, *args)

    def committing(self, *args):
        seen[0] += at in ("commit", "after")
        if at == "commit" and seen[0] == times:
            raise RuntimeError("stopped")
        out = commit(self, *args)
        if at == "after" and seen[0] == times:
            raise RuntimeError("stopped")
        return out

    m.setattr(Ledger, "write", writing)
    m.setattr(Ledger, "commit", committing)


@pytest.mark.parametrize("held_rows", [1, 10])
def test_a_key_beyond_what_is_held_is_followed_by_slices(spark, tmp_path, held_rows):
    data = rows(seed=9)
    random.Random(1).shuffle(data)
    land(spark, str(tmp_path / "in"), data, 1)
    points = stream(spark, str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = run_available(
            dedup_ttl_stream(points, ["name", "labels.u"], "5m", held_rows=held_rows), str(tmp_path / "out"), str(tmp_path / "state")
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = dedup_ttl(spark.createDataFrame(data, SCHEMA), ["name", "labels.u"], "5m")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))


def test_batch_run_then_stream_then_batch_equal_one_run(spark, tmp_path):
    data, keys = rows(seed=10), ["name", "labels.u"]
    table = spark.createDataFrame(data, SCHEMA)
    one, two = data[100][1], data[200][1]
    first, store = dedup_against_store(table.filter(F.col("ts") < one), empty_store(table, keys), keys, "5m")
    land(spark, str(tmp_path / "in"), [r for r in data if one <= r[1] < two], 3)
    out = run_available(
        dedup_ttl_stream(stream(spark, str(tmp_path / "in")), keys, "5m", seen=written(store, "store")),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    store = written(stream_store(spark.createDataFrame([], SCHEMA), str(tmp_path / "state"), keys), "store")
    last, _ = dedup_against_store(table.filter(F.col("ts") >= two), store, keys, "5m")
    got = [r for df in (first, out, last) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, dedup_ttl(table, keys, "5m").collect()))


def many_keys(n=3000, seed=12):
    """Rows of a thousand keys, some of them null, in order of time."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        labels = {} if rng.random() < 0.1 else {"u": rng.choice([None, *map(str, range(500))])}
        out.append((i, T0 + timedelta(seconds=rng.randrange(7200)), rng.choice("ab"), float(i), labels))
    return sorted(out + out[::7], key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("buckets, held_rows", [(1, 50), (3, 10), (16, 50_000)])
def test_keys_are_followed_by_the_bucket(spark, tmp_path, buckets, held_rows):
    """A group for each key is a call, a frame and a timer for each: what a stream of many keys spends its time on."""
    data, keys = many_keys(), ["name", "labels.u"]
    table = spark.createDataFrame(data, SCHEMA)
    one = data[len(data) // 4][1]
    first, store = dedup_against_store(table.filter(F.col("ts") < one), empty_store(table, keys), keys, "20m")
    rest, path, store = [r for r in data if r[1] >= one], str(tmp_path / "in"), written(store, "store")
    for at, half in ((0, rest[: len(rest) // 2]), (10, rest[len(rest) // 2 :])):
        # In order by parts, in any order inside them.
        for p, part in enumerate((half[: len(half) // 2], half[len(half) // 2 :])):
            random.Random(p).shuffle(part)
            land(spark, path, part, 1, at + p)
        out = run_available(
            dedup_ttl_stream(stream(spark, path), keys, "20m", seen=store, held_rows=held_rows, buckets=buckets),
            str(tmp_path / "out"), str(tmp_path / "state"),
        )
    got = [r for df in (first, out) for r in df.collect()]
    kept = dedup_ttl(table, keys, "20m")
    assert sorted(map(str, got)) == sorted(map(str, kept.collect()))
    state = spark.read.format("statestore").option("stateVarName", "last_kept").load(str(tmp_path / "state"))
    assert state.count() <= buckets


def test_state_expires_by_timer(spark, tmp_path):
    data, path, keys = rows(seed=11), str(tmp_path / "in"), ["name"]
    for first, part in ((0, data), (10, [(999, T0 + timedelta(hours=9), "late", 1.0, {})]), (20, [(1000, T0 + timedelta(hours=10), "end", 1.0, {})])):
        land(spark, path, part, 1, first)
        run_available(
            dedup_ttl_stream(stream(spark, path), keys, "5m"), str(tmp_path / "out"), str(tmp_path / "state")
        )
    store = stream_store(spark.createDataFrame([], SCHEMA), str(tmp_path / "state"), keys)
    # All other keys were past their use by the watermark of nine hours less one.
    assert {r.dedup_key.name for r in store.collect()} == {"late", "end"}
    live = expire_seen(store, F.lit(T0 + timedelta(hours=9, minutes=30)), "5m")
    assert {r.dedup_key.name for r in live.collect()} == {"end"}


def test_the_store_is_read_from_the_states_of_buckets(spark, tmp_path):
    """Every live entry of a thousand keys, null ones included, from a few states; expired ones have gone."""
    data, path, keys = many_keys(seed=13), str(tmp_path / "in"), ["name", "labels.u"]
    land(spark, path, [*data, (9999, T0 + timedelta(hours=3), "end", 1.0, {"u": "1"})], 3)
    run_available(
        dedup_ttl_stream(stream(spark, path), keys, "40m", buckets=4), str(tmp_path / "out"), str(tmp_path / "state")
    )
    store = stream_store(spark.createDataFrame([], SCHEMA), str(tmp_path / "state"), keys)
    assert store.filter("dedup_key.name <> 'end'").agg(F.min("last_kept")).first()[0] > T0 + timedelta(hours=2, minutes=-40)
    table = spark.createDataFrame(data, SCHEMA)
    _, want = dedup_against_store(table, empty_store(table, keys), keys, "40m")
    now = F.lit(T0 + timedelta(hours=2))
    shown = lambda df: sorted(map(str, expire_seen(df, now, "40m").collect()))
    assert shown(store.filter("dedup_key.name <> 'end'")) == shown(want) and len(shown(want)) > 400
    assert any(r.dedup_key.labels_u is None for r in store.collect())
    state = spark.read.format("statestore").option("stateVarName", "last_kept").load(str(tmp_path / "state"))
    assert state.count() <= 4


@pytest.mark.parametrize("parts", [1, 5])
def test_closed_windows_equal_batch(spark, tmp_path, parts):
    data = rows(seed=3)
    land(spark, str(tmp_path / "in"), data, parts)
    rules = [AggRule("hot", "sum", ["u"]), AggRule("a", "histogram", [], [50, 100])]
    out = run_available(
        aggregate_stream(stream(spark, str(tmp_path / "in")), rules, 600, "10 minutes", 4),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    closed = max(r[1] for r in data) - timedelta(minutes=10)
    batch = aggregate(spark.createDataFrame(data, SCHEMA), rules, 600, exact=True)
    expected = [r for r in batch.collect() if r.window_end <= closed]
    assert sorted(map(str, out.collect())) == sorted(map(str, expected)) and expected


def test_export_arrives_once(spark, tmp_path):
    data = rows(seed=4)
    path = str(tmp_path / "in")
    ends = [Endpoint("all"), Endpoint("hot", filter="name = 'hot'")]
    for first, half in ((0, data[:200]), (10, data[200:])):
        land(spark, path, half, 2, first)
        export_stream(stream(spark, path).drop("labels"), ends, str(tmp_path / "out"),
                      str(tmp_path / "state"))
    back = exported(spark, str(tmp_path / "out"), "parquet", "id bigint, name string")
    assert back.filter("endpoint = 'all'").count() == len(data)
    assert back.filter("endpoint = 'hot'").count() == sum(r[2] == "hot" for r in data)
    assert back.select("run").distinct().count() == 4
