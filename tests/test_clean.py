import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.values import hash_pii
from gaugeworks.model import ClassRule, Connection, PiiConfig, SampleRule
from gaugeworks.operators import pii, select

SALT = "s"


def points(spark, rows):
    return spark.createDataFrame(
        rows, "batch_id string, id bigint, value double, labels map<string,string>"
    )


def test_hash_columns_and_labels(spark):
    df = spark.createDataFrame([("a@b.cc", "x", None)], "email string, other string, user_name string")
    row = pii.hash_pii_fields(df, PiiConfig(SALT)).first()
    assert set(row.asDict()) == {"other", "email_hash", "user_name_hash"}
    assert len(row.email_hash) == 64 and row.user_name_hash is None

    labels = points(spark, [("b", 1, 0.0, {"email": "a@b.cc", "email_hash": "old",
                                           "user_name_hash": "kept", "z": "1"})])
    out = labels.select(pii.hash_pii_labels(F.col("labels"), PiiConfig(SALT)).alias("l")).first().l
    assert out == {"email_hash": row.email_hash, "user_name_hash": "kept", "z": "1"}


def test_leaks_hold_back_the_whole_batch(spark):
    digest = spark.range(1).select(hash_pii(F.lit("v"), SALT)).first()[0]
    df = points(
        spark,
        [
            ("clean", 1, 0.0, {"email": digest}),
            ("clean", 2, 0.0, {"email": "am9obg=="}),
            ("clean", 3, 0.0, {"email": "raw@x.yy", "email_hash": "there"}),
            ("leak", 4, 0.0, {}),
            ("leak", 5, 0.0, {"email": "raw@x.yy", "command_line": "rm -rf"}),
            (None, 6, 0.0, {"email": "raw@x.yy"}),
            (None, 7, 0.0, {}),
        ],
    )
    clean, errors = pii.detect_leaks(df)
    assert {r.id for r in clean.collect()} == {1, 2, 3}
    got = {r.batch_id: r for r in errors.collect()}
    assert set(got) == {"leak", None}
    assert got["leak"].error_code == "ERR_PII_LEAK" and got["leak"].sent_to_dlq
    assert got["leak"].error_message == "PII leak detected: unhashed command_line,email"
    strict, _ = pii.detect_leaks(df, strict=True)
    assert strict.count() == 0


def test_audit(spark):
    df = points(spark, [("b", 1, 0.0, {"email": "raw@x.yy"}), ("b", 2, 0.0, {"email_hash": "h"}),
                        ("b", 3, 0.0, {})])
    got = {r.field: (r.seen, r.leaked) for r in pii.leak_audit(df).collect()}
    assert got["email"] == (2, 1) and got["command_line"] == (0, 0)


@pytest.mark.parametrize(
    "text, out, emails, ips",
    [
        ("write to a.b+c@x-y.example now", "write to <email> now", 1, 0),
        ("10.0.0.1, 10.0.0.2", "<ip>, <ip>", 0, 2),
        ("x@y.zz at 1.2.3.4", "<email> at <ip>", 1, 1),
        ("version 1.2.3 and a@b", "version 1.2.3 and a@b", 0, 0),
        (None, None, None, None),
    ],
)
def test_scrub(spark, text, out, emails, ips):
    df = spark.createDataFrame([(text,)], "text string")
    row = pii.scrub_text(df, "text").first()
    assert (row.text, row.emails_found, row.ips_found) == (out, emails, ips)


def test_first_rule_by_priority_classifies(spark):
    rules = [ClassRule("low", "value > 0", 2, {"t": "l"}), ClassRule("high", "value > 5", 1),
             ClassRule("null", "labels['none'] = 'x'", 0)]
    df = points(spark, [("b", 1, 9.0, {"t": "own"}), ("b", 2, 1.0, {}), ("b", 3, -1.0, {})])
    got = {r.id: (r.category, r.labels) for r in pii.classify(df, rules).collect()}
    assert got == {1: ("high", {"t": "own"}), 2: ("low", {"t": "l"}), 3: (None, {})}


def labelled(spark):
    return points(
        spark, [("b", i, float(i), {"env": "dev"} if i % 2 else {"env": "prod"}) for i in range(200)]
    )


def test_sampling_first_match_and_unmatched(spark):
    df = labelled(spark)
    none = select.sample_by_rule(df, [SampleRule("env=dev", 0.0), SampleRule("env=dev", 1.0)], "id")
    assert {r.id % 2 for r in none.collect()} == {0} and none.count() == 100
    some = [SampleRule("env=dev", 0.3)]
    one = {r.id for r in select.sample_by_rule(df, some, "id", 1).collect()}
    again = {r.id for r in select.sample_by_rule(df.repartition(7), some, "id", 1).collect()}
    assert one == again and 100 < len(one) < 160
    assert one != {r.id for r in select.sample_by_rule(df, some, "id", 2).collect()}


def test_trace_sampling_keeps_groups_whole(spark):
    df = labelled(spark).withColumn("trace", F.col("id") % 20)
    kept = select.sample_trace(df, "trace", 0.5).groupBy("trace").count().collect()
    assert kept and all(r["count"] == 10 for r in kept)


def test_filter_pattern(spark):
    assert select.filter_rules(labelled(spark), [SampleRule("env=dev")]).count() == 100
    assert select.filter_rules(labelled(spark), [SampleRule("absent=dev")]).count() == 0


def test_route_null_is_false_and_no_edge_leaves(spark):
    df = points(spark, [("b", 1, None, {}), ("b", 2, 9.0, {}), ("b", 3, 1.0, {"a": "x"})])
    edges = [Connection("big", "value > 5"), Connection("a", "labels['a'] = 'x'")]
    got = {(r.id, r.target) for r in select.route(df, edges).collect()}
    assert got == {(2, "big"), (3, "a")}
    assert select.route(df, [Connection("all")]).count() == 3


def test_label_policy(spark):
    df = points(spark, [("b", 1, 0.0, {"__x": "1", "_y": "2", "z": "3"})])
    assert select.strip_internal_labels(df).first().labels == {"_y": "2", "z": "3"}
    assert select.strip_internal_labels(df, "keep").first().labels == {"__x": "1", "_y": "2", "z": "3"}
