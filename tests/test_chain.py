import json
from datetime import datetime

from pyspark.sql import functions as F

from gaugeworks.model import ENVELOPE, AggRule, DedupConfig, PiiConfig
from gaugeworks.operators import deadletter as dl
from gaugeworks.plans.chain import ChainConfig, run_chain

NOW = datetime(2024, 1, 31)
MINUTE = 60_000_000


def point(id, minute, value=1.0, **labels):
    return {"id": id, "ts": minute * MINUTE, "name": "m", "value": value, "labels": labels}


def batch(name, body, replay=False):
    text = body if isinstance(body, str) else json.dumps(body)
    return (name, bytearray(text.encode()), "json", replay, 0, {}, {"hop": "1"})


BATCHES = [
    batch("good", [point(1, 0, 1, u="x"), point(2, 1, 2, u="x"), point(3, 70, 4, u="x", __i="1")]),
    batch("wrapped", {"metrics": [point(4, 0, 8, u="y")]}),
    batch("again", [point(1, 0, 1, u="x")], replay=True),
    batch("broken", '[{"id":'),
    batch("leak", [point(5, 0, 16, u="x"), point(6, 0, 32, email="a@b.cc")]),
]
CONFIG = ChainConfig(
    must_be_hashed=["email"],
    pii=PiiConfig("salt", ["u"]),
    dedup=DedupConfig(["name", "labels.u_hash"], "60m"),
    aggregation=[AggRule("m", "sum")],
    window_seconds=60,
)


def run(spark, rows, config=CONFIG, **how):
    return run_chain(spark.createDataFrame(rows, ENVELOPE), config, F.lit(NOW), **how)


def test_chain(spark):
    out = run(spark, BATCHES)
    # id 2 is a duplicate of 1 within the hour; the replayed copy of 1 is let through.
    assert sorted(r.id for r in out.points.collect()) == [1, 1, 3, 4]
    labels = {r.id: r.labels for r in out.points.collect()}
    assert set(labels[3]) == {"u_hash"} and len(labels[3]["u_hash"]) == 64
    sums = {r.window_start.minute + 60 * r.window_start.hour: r.value for r in out.output.collect()}
    assert sums == {0: 10.0, 70: 4.0}
    got = {r.batch_id: (r.status, r.error_code, r.sent_to_dlq) for r in out.outcomes.collect()}
    assert got == {
        "good": (1, None, False), "wrapped": (1, None, False), "again": (1, None, False),
        "broken": (2, "ERR_INVALID_INPUT", False), "leak": (2, "ERR_PII_LEAK", True),
    }
    dead = out.dead_letters.collect()
    assert [(r.batch_id, r.error_code) for r in dead] == [("leak", "ERR_PII_LEAK")]
    assert bytes(dead[0].data) == bytes(BATCHES[4][1]) and dead[0].internal_labels["hop"] == "1"
    health = out.health.first()
    assert (health.received, health.forwarded, health.rejected, health.dlq) == (5, 3, 2, 1)


def test_schema_stage(spark):
    config = ChainConfig(schema={"required": ["metrics"]})
    out = run(spark, [BATCHES[1], batch("other", {"resource_metrics": []})], config)
    got = {r.batch_id: r.error_message for r in out.outcomes.collect()}
    assert got == {
        "wrapped": None,
        "other": "schema validation failed at path 'metrics': missing required field: metrics",
    }
    assert out.output.count() == 1 and out.dead_letters.count() == 1


def test_failed_batches_come_back_by_replay(spark):
    down = F.when(F.col("batch_id") == "good", "failed").otherwise("ok")
    first = run(spark, BATCHES[:2], forward=down)
    assert [r.id for r in first.points.collect()] == [4]
    letters = first.dead_letters
    assert [(r.batch_id, r.error_code) for r in letters.collect()] == [
        ("good", "ERR_FORWARDING_FAILED")
    ]
    again = dl.replay_stamp(dl.replay_select(letters, F.lit(NOW), since="1h"), F.lit(NOW))
    both = dl.replay_into(spark.createDataFrame(BATCHES[1:2], ENVELOPE), again, [])
    out = run_chain(both, CONFIG, F.lit(NOW))
    # Replayed points are not measured against what was kept before they failed.
    assert sorted(r.id for r in out.points.collect()) == [1, 2, 3, 4]
