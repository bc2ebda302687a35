import random
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import ENVELOPE
from gaugeworks.plans.chain import ChainConfig, run_chain
from gaugeworks.sources import envelopes


def batches(spark, *texts):
    rows = [
        (f"b{i}", bytearray(t.encode()), "json", i % 2 == 0, i, {"m": str(i)}, {"l": "x"})
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, ENVELOPE)


GOOD = [
    '[{"id":1,"name":"a","value":1.5,"labels":{"x":"1","y":null}}]',
    '{"metrics":[{"id":2,"name":"b","value":2}]}',
    ' \n[{"id":3}, null]',
    "null",
    "[]",
    "{}",
    '{"resource_metrics":[{"resource":{"attributes":{"service":"s","x":"outer"}},'
    '"metrics":[{"id":4,"name":"c","value":4,"labels":{"x":"own"}}],'
    '"scope_metrics":[{"metrics":[{"id":5,"name":"d","value":5}]}]},{}]}',
]
BAD = [
    "",
    '[{"name":"a","value":',
    '[{"name":"a","value":"abc"}]',
    "[1,2]",
    '[],"a":[1]',
    '[]],"x":[[]',
    "[] x",
    "{} {}",
    "5",
    '"text"',
]


def test_shapes(spark):
    rows = envelopes.explode_points(batches(spark, *GOOD)).collect()
    got = {(r.batch_id, r.pos): r for r in rows}
    assert set(got) == {("b0", 0), ("b1", 0), ("b2", 0), ("b2", 1), ("b6", 0), ("b6", 1)}
    assert got["b0", 0].labels == {"x": "1", "y": None}
    # Missing name and value, and a null element, become zero values.
    assert (got["b2", 0].name, got["b2", 0].value) == ("", 0.0)
    assert (got["b2", 1].name, got["b2", 1].value, got["b2", 1].labels) == ("", 0.0, {})
    # Resource attributes come in below the point's own labels.
    assert got["b6", 0].labels == {"service": "s", "x": "own"}
    assert got["b6", 1].labels == {"service": "s", "x": "outer"}
    # Envelope fields are carried along.
    assert got["b1", 0].replay is False and got["b1", 0].metadata == {"m": "1"}


@pytest.mark.parametrize(
    "stage, code",
    [("aggregate", "ERR_INVALID_INPUT"), ("dedup", "ERR_PROCESSING_FAILED")],
)
def test_malformed(spark, stage, code):
    good, bad = envelopes.split_malformed(batches(spark, *GOOD, *BAD), stage)
    rows = bad.collect()
    assert {r.batch_id for r in rows} == {f"b{i + len(GOOD)}" for i in range(len(BAD))}
    assert {(r.error_code, r.sent_to_dlq) for r in rows} == {(code, False)}
    assert good.count() == 6


def test_payload_is_decoded_once(spark):
    plan = envelopes.explode_points(batches(spark, *GOOD))._jdf.queryExecution()
    # Attributes are parsed again, from their own text.
    assert plan.optimizedPlan().toString().count("columnNameOfCorruptRecord") == 1


def test_prometheus(spark):
    text = (
        '{"timeseries":[{"labels":{"__name__":"cpu","host":"a"},'
        '"samples":[{"timestamp":1000,"value":1.5},{"timestamp":2000,"value":2}]},'
        '{"labels":{"host":"b"},"samples":[{"timestamp":3000}]},{"labels":{}}]}'
    )
    rows = (
        envelopes.normalise_prometheus(batches(spark, text, '{"timeseries":[', "null"))
        .select(F.unix_millis("ts").alias("ms"), "name", "value", "labels")
        .collect()
    )
    assert sorted((r.ms, r.name, r.value, r.labels["host"]) for r in rows) == [
        (1000, "cpu", 1.5, "a"), (2000, "cpu", 2.0, "a"), (3000, "", 0.0, "b"),
    ]
    assert all("__name__" not in r.labels for r in rows)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_landed_files(spark, tmp_path, fmt):
    source = batches(spark, *GOOD)
    source.write.format(fmt).save(str(tmp_path / "in"))
    back = envelopes.read_batches(spark, str(tmp_path / "in"), fmt)
    assert sorted(map(str, back.collect())) == sorted(map(str, source.collect()))


def test_otlp_as_written(spark):
    point = '"timeUnixNano":"1700000000000000001","attributes":[{"key":"host","value":{"stringValue":"a"}},{"key":"n","value":{"intValue":"5"}},{"key":"host","value":{"stringValue":"b"}}]'
    text = (
        '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service","value":{"stringValue":"s"}}]},'
        '"scopeMetrics":[{"metrics":['
        f'{{"name":"cpu","gauge":{{"dataPoints":[{{{point},"asDouble":1.5}},{{"asInt":"7"}}]}}}},'
        f'{{"name":"req","sum":{{"dataPoints":[{{{point},"asInt":3}}]}}}},'
        f'{{"name":"lat","histogram":{{"dataPoints":[{{{point},"count":"4","sum":9.5,"bucketCounts":["1","2","1"],"explicitBounds":[0.5,2]}}]}}}}'
        "]}]}]}"
    )
    snake = '{"resource_metrics":[{"resource":{"attributes":{"service":"m"}},"metrics":[{"name":"x","value":1}]}]}'
    rows = envelopes.normalise(batches(spark, text, snake)).collect()
    got = {(r.name, r.labels.get("le"), r.value): r for r in rows}
    assert set(got) == {
        ("cpu", None, 1.5), ("cpu", None, 7.0), ("req", None, 3.0), ("x", None, 1.0),
        ("lat_count", None, 4.0), ("lat_sum", None, 9.5),
        ("lat_bucket", "0.5", 1.0), ("lat_bucket", "2", 3.0), ("lat_bucket", "+Inf", 4.0),
    }
    assert got["cpu", None, 1.5].labels == {"service": "s", "host": "b", "n": "5"}
    assert got["x", None, 1.0].labels == {"service": "m"}
    assert got["cpu", None, 1.5].ts.timestamp() == 1_700_000_000
    assert len({r.id for r in rows}) == len(rows) and all(r.ts and r.id for r in rows)


def test_unknown_objects_and_formats_are_errors(spark):
    texts = ['{"foo":1}', '{"timeseries":[{"labels":{"__name__":"c"},"samples":[{"timestamp":1,"value":2}]}]}', "[]", "{}"]
    df = batches(spark, *texts)
    _, bad = envelopes.split_malformed(df)
    assert [r.batch_id for r in bad.collect()] == ["b0"]
    _, bad = envelopes.split_malformed(df.withColumn("format", F.lit("prometheus")))
    assert sorted(r.batch_id for r in bad.collect()) == ["b0", "b2", "b3"]
    _, bad = envelopes.split_malformed(df.withColumn("format", F.lit("carbon")))
    assert bad.count() == 4
    assert envelopes.explode_points(df).first().name == "c"


def test_points_without_id_and_time_get_both(spark):
    df = batches(spark, '[{"name":"a"},{"name":"a"},{"id":5,"ts":7,"name":"b"}]')
    df = df.withColumn("received", F.timestamp_micros(F.lit(99)))
    rows = envelopes.explode_points(df).select("id", F.unix_micros("ts").alias("us"), "pos").collect()
    assert [(r.us, r.id == 5) for r in sorted(rows, key=lambda r: r.pos)] == [(99, False), (99, False), (7, True)]
    assert len({r.id for r in rows}) == 3 and "received" not in envelopes.explode_points(df).columns


def test_of_repeated_keys_the_last_holds(spark):
    raw, digest = "raw@example.com", "ab" * 32
    own = f'"labels":{{"email":"{digest}","email":"{raw}","x":"1"}}'
    other = f'"attributes":{{"email":"{digest}","email":"{raw}"}}'
    listed = f'"attributes":[{{"key":"email","value":{{"stringValue":"{digest}"}}}},{{"value":{{}}}},{{"key":"email","value":{{"stringValue":"{raw}"}}}}]'
    texts = [
        f'[{{"name":"a",{own}}}]',
        f'{{"metrics":[{{"name":"a",{own}}}]}}',
        f'{{"resource_metrics":[{{"resource":{{{other}}},"metrics":[{{"name":"a","value":1,"labels":{{"x":"2","x":"1"}}}}]}}]}}',
        f'{{"resourceMetrics":[{{"resource":{{{listed}}},"scopeMetrics":[{{"metrics":[{{"name":"a","gauge":{{"dataPoints":[{{"asInt":1,"attributes":{{"x":"2","x":"1"}}}}]}}}}]}}]}}]}}',
        f'{{"timeseries":[{{"labels":{{"__name__":"b","__name__":"a","email":"{digest}","email":"{raw}","x":"1"}},"samples":[{{"timestamp":1}}]}}]}}',
    ]
    rows = envelopes.explode_points(batches(spark, *texts)).collect()
    assert [(r.name, r.labels) for r in rows] == [("a", {"email": raw, "x": "1"})] * 5
    # So a raw value cannot hide behind a hashed one.
    result = run_chain(batches(spark, *texts, '[{"name":"good","labels":{"email":"' + digest + '"}}]'), ChainConfig(must_be_hashed=["email"]))
    assert sorted((r.batch_id, r.error_code) for r in result.outcomes.collect()) == [
        *[(f"b{i}", "ERR_PII_LEAK") for i in range(5)], ("b5", None)
    ]
    assert [r.labels for r in result.points.collect()] == [{"email": digest}]


def test_times_that_cannot_be(spark):
    texts = [
        '{"timeseries":[{"labels":{"__name__":"a"},"samples":[{"timestamp":1700000000000000000,"value":1},{"timestamp":null,"value":2},{"timestamp":1000,"value":3}]}]}',
        '[{"name":"b","ts":9223372036854775807},{"name":"b","ts":-9223372036854775808},{"name":"b","ts":5}]',
        '{"resource_metrics":[{"metrics":[{"name":"c","gauge":{"dataPoints":[{"timeUnixNano":"99999999999999999999999","asInt":1},{"timeUnixNano":"x","asInt":1}]}}]}]}',
    ]
    df = batches(spark, *texts).withColumn("received", F.timestamp_micros(F.lit(77)))
    got = envelopes.explode_points(df).select("name", F.unix_micros("ts").alias("us")).collect()
    assert [tuple(r) for r in got] == [("a", 77), ("a", 77), ("a", 1_000_000), ("b", 77), ("b", 77), ("b", 5), ("c", 77), ("c", 77)]


def test_summaries_and_exponential_histograms(spark):
    at = '"timeUnixNano":"1000","attributes":{"h":"a"}'
    summary = f'{{{at},"count":"4","sum":9.5,"quantileValues":[{{"quantile":0.5,"value":2}},{{"quantile":0.99,"value":3}}]}}'
    exponential = f'{{{at},"count":"10","sum":1.5,"scale":0,"zeroCount":"2","zero_threshold":0.001,"positive":{{"offset":-1,"bucketCounts":["1","0","4"]}},"negative":{{"offset":1,"bucketCounts":["2","1"]}}}}'
    text = (
        f'{{"resource_metrics":[{{"metrics":[{{"name":"s","summary":{{"dataPoints":[{summary}]}}}},'
        f'{{"name":"e","exponentialHistogram":{{"dataPoints":[{exponential}]}}}}]}}]}}'
    )
    rows = envelopes.explode_points(batches(spark, text)).collect()
    got = [(r.name, r.labels.get("le") or r.labels.get("quantile"), r.value) for r in rows]
    assert sorted(got, key=str) == sorted([
        ("s_count", None, 4.0), ("s_sum", None, 9.5), ("s", "0.5", 2.0), ("s", "0.99", 3.0),
        ("e_count", None, 10.0), ("e_sum", None, 1.5),
        # Negative: [-8, -4) holds 1, [-4, -2) holds 2. Positive: up to 1, 2 and 4.
        ("e_bucket", "-4", 1.0), ("e_bucket", "-2", 3.0), ("e_bucket", "0.001", 5.0),
        ("e_bucket", "1", 6.0), ("e_bucket", "2", 6.0), ("e_bucket", "4", 10.0), ("e_bucket", "+Inf", 10.0),
    ], key=str)
    assert all(r.labels["h"] == "a" for r in rows)
    unread = ['{"resource_metrics":[{"metrics":[{"name":"x","sketch":{"dataPoints":[{}]}}]}]}', '{"resource_metrics":[{"metrics":[{"name":"x","value":1}]}]}']
    _, bad = envelopes.split_malformed(batches(spark, *unread))
    assert [r.batch_id for r in bad.collect()] == ["b0"]


def test_no_payload_ends_the_job(spark):
    """Payloads with parts cut out, doubled or changed: each is a batch decoded or an error row."""
    rng = random.Random(4)
    whole = [
        *GOOD,
        '{"resourceMetrics":[{"resource":{"attributes":[{"key":"a","value":{"stringValue":"s"}}]},"scopeMetrics":[{"metrics":['
        '{"name":"h","histogram":{"dataPoints":[{"count":"4","sum":9.5,"bucketCounts":["1","2"],"explicitBounds":[0.5],"timeUnixNano":"17"}]}},'
        '{"name":"e","exponentialHistogram":{"dataPoints":[{"scale":3,"positive":{"offset":4,"bucketCounts":["1"]}}]}},'
        '{"name":"s","summary":{"dataPoints":[{"quantileValues":[{"quantile":0.5,"value":1}]}]}}]}]}]}',
        '{"timeseries":[{"labels":{"__name__":"c"},"samples":[{"timestamp":1,"value":2}]}]}',
    ]
    bits = ["null", "1e999", "-9223372036854775809", '"x"', "[", "}", '"a":1,', "{}", "[[]]", "NaN", '"\\ud800"', "\0", "9" * 1200, "[" * 1100]
    texts = list(whole)
    for _ in range(400):
        t = rng.choice(whole)
        a, b = sorted(rng.randrange(len(t) + 1) for _ in range(2))
        b = min(b, a + rng.choice([0, 1, 5, 30]))
        texts.append(t[:a] + rng.choice(["", *bits, t[a:b] * 2, rng.choice(bits) + ","]) + t[b:])
    df = batches(spark, *texts)
    df = df.union(df.limit(1).withColumns({"batch_id": F.lit("none"), "data": F.lit(None).cast("binary")}))
    result = run_chain(df, ChainConfig(must_be_hashed=["email"]))
    outcomes = {r.batch_id: r.error_code for r in result.outcomes.collect()}
    assert len(outcomes) == len(texts) + 1 and outcomes["none"] == "ERR_INVALID_INPUT"
    assert {outcomes[f"b{i}"] for i in range(len(whole))} == {None}
    points = result.points.select("batch_id", "ts", "labels").collect()
    assert {r.batch_id for r in points} <= {b for b, code in outcomes.items() if code is None}


def test_the_decoder_is_built_quickly(spark):
    df = batches(spark, *GOOD)
    envelopes.explode_points(df)
    start = time.time()
    envelopes.explode_points(df)
    assert time.time() - start < 1.0
