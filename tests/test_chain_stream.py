"""The chain on a stream: each micro-batch once, wherever it was stopped."""

import json

import pytest
from pyspark.sql import functions as F
from test_streaming import fail_in_run

from gaugeworks.model import ENVELOPE, DedupConfig, PiiConfig
from gaugeworks.operators.deadletter import read_dlq
from gaugeworks.plans.chain import ChainConfig, run_chain
from gaugeworks.sources.envelopes import read_batches
from gaugeworks.sources.ledger import Ledger
from gaugeworks.streaming.chain import OUTCOME, chain_stream, stream_counts

CONFIG = ChainConfig(must_be_hashed=["email"], pii=PiiConfig("salt", ["user"]), dedup=DedupConfig(["name"], "2s"))
FILES = 3


def land(spark, path):
    rows = []
    for i in range(30):
        points = [{"id": 10 * i + k, "ts": (10 * i + k) * 300_000, "name": "ab"[k % 2], "value": k, "labels": {"user": "u"}} for k in range(10)]
        if i % 7 == 3:
            points[4]["labels"]["email"] = "raw@example.com"
        text = json.dumps(points) if i % 5 else json.dumps(points)[:-3]
        rows.append((f"b{i}", bytearray(text.encode()), "json", i % 11 == 1, 1 + i // 10, {}, {}))
    for f in range(FILES):
        part = spark.createDataFrame(rows[10 * f : 10 * f + 10], ENVELOPE)
        part.coalesce(1).write.parquet(f"{path}/{f}")


def run(spark, tmp_path, versions=None):
    batches = read_batches(spark, f"{tmp_path}/in/*", stream=True, max_files=1)
    return chain_stream(batches, CONFIG, f"{tmp_path}/out", f"{tmp_path}/state", versions=versions)


def told(ledger, spark, tmp_path):
    points = sorted(str(tuple(r)) for r in ledger.read("points", None).select("batch_id", "id", "ts", "name", "labels").collect())
    outcomes = sorted(str(tuple(r)) for r in ledger.read("outcomes", OUTCOME).collect())
    letters = sorted(r.batch_id for r in read_dlq(spark, f"{tmp_path}/out").collect())
    return points, outcomes, letters


def whole(spark, tmp_path):
    result = run_chain(read_batches(spark, f"{tmp_path}/in/*"), CONFIG)
    return (
        sorted(str(tuple(r)) for r in result.points.select("batch_id", "id", "ts", "name", "labels").collect()),
        sorted(str(tuple(r)) for r in result.outcomes.collect()),
        sorted(r.batch_id for r in result.dead_letters.collect()),
    ), result.health.first()


def test_stream_equals_batch(spark, tmp_path):
    land(spark, f"{tmp_path}/in")
    ledger = run(spark, tmp_path)
    want, counts = whole(spark, tmp_path)
    assert told(ledger, spark, tmp_path) == want and len(want[1]) == 30
    assert ledger.snapshot().notes["stream"] == FILES - 1
    assert stream_counts(spark, f"{tmp_path}/out").select(*counts.asDict()).collect() == [counts]


@pytest.mark.parametrize("at", ["dead_letters", "seen", "after"])
def test_stopped_between_two_sinks(spark, tmp_path, monkeypatch, at):
    land(spark, f"{tmp_path}/in")
    with monkeypatch.context() as m:
        fail_in_run(m, at, 2)
        with pytest.raises(Exception, match="stopped"):
            run(spark, tmp_path)
    done = Ledger(spark, f"{tmp_path}/out")
    held = told(done, spark, tmp_path)
    assert len(held[1]) == (20 if at == "after" else 10)
    ledger = run(spark, tmp_path)
    assert told(ledger, spark, tmp_path) == whole(spark, tmp_path)[0]
    # And with nothing new to read, nothing changes.
    assert told(run(spark, tmp_path), spark, tmp_path) == whole(spark, tmp_path)[0]


def test_a_repeated_micro_batch_keeps_its_rules(spark, tmp_path, monkeypatch):
    land(spark, f"{tmp_path}/in")
    current = [1]

    def versions():
        rows = [("r", "a", g, g, 10.0 * g) for g in range(1, current[0] + 1)]
        return spark.createDataFrame(rows, "rule_id string, name string, generation bigint, seq bigint, threshold double")

    with monkeypatch.context() as m:
        fail_in_run(m, "outcomes", 2)
        with pytest.raises(Exception, match="stopped"):
            run(spark, tmp_path, versions)
    # The rules change while the second micro-batch has not been done.
    current[0] = 3
    points = run(spark, tmp_path, versions).read("points", None)
    got = points.filter("name = 'a'").select((F.substring("batch_id", 2, 2).cast("int") / 10).cast("int").alias("run"), "threshold").distinct()
    assert {tuple(r) for r in got.collect()} == {(0, 10.0), (1, 10.0), (2, 30.0)}
