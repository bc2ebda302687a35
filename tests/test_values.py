import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import model
from gaugeworks.functions.clock import parse_duration
from gaugeworks.functions.values import (
    bound_text,
    bound_text_sql,
    hash_fraction,
    hash_pii,
    is_hashed_or_encoded,
    put_labels,
)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hash_is_salt_then_value(spark):
    got = one(
        spark,
        hash_pii(F.lit("test value"), "test salt"),
        hash_pii(F.lit("another test"), "test salt"),
    )
    assert got[0] == "950160c327f6c01d6aff27fc9b99a36bfa9ed243ccd252efc27c5a86e454ebc3"
    assert got[1] == "10a32b9bc2c8c9633fc3dd884e04ac98ecb57ddf58702cdbfe67a35e16cd6e52"


@pytest.mark.parametrize(
    "text, loose, strict",
    [
        ("0123456789abcdef" * 4, True, True),
        ("0123456789ABCDEF" * 4, True, False),
        ("john", True, False),
        ("joh", False, False),
        ("am9obg==", True, False),
        ("am9ob===", False, False),
        ("", False, False),
        ("john\n", False, False),
        ("a@b.example", False, False),
        (None, False, False),
    ],
)
def test_hashed_or_encoded(spark, text, loose, strict):
    c = F.lit(text).cast("string")
    got = one(
        spark,
        is_hashed_or_encoded(c).alias("a"),
        is_hashed_or_encoded(c, strict=True).alias("b"),
    )
    assert (got.a, got.b) == (loose, strict)


def test_fraction_follows_md5(spark):
    digest = int(hashlib.md5(b"42:x").hexdigest()[:8], 16)
    assert one(spark, hash_fraction(F.lit("x"), 42))[0] == digest / 2**32


@pytest.mark.parametrize(
    "bound, text",
    [
        (0.1, "0.1"), (10, "10"), (1e6, "1e+06"), (100000, "100000"), (0.00001, "1e-05"),
        (0.0001, "0.0001"), (1234567.5, "1.2345675e+06"), (-3, "-3"), (0, "0"),
        (2.5, "2.5"), (float("inf"), "+Inf"), (1e100, "1e+100"),
    ],
)
def test_bound_text(bound, text):
    assert bound_text(bound) == text


@pytest.mark.parametrize(
    "text, us",
    [("90s", 90_000_000), ("1h30m", 5_400_000_000), ("2d", 172_800_000_000),
     ("1.5s", 1_500_000), ("-1ms", -1000), ("0", 0), ("5us", 5)],
)
def test_duration(text, us):
    assert parse_duration(text) == us


@pytest.mark.parametrize("text", ["", "1", "1x", "h", "1h 2m", "1h2"])
def test_bad_duration(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_put_labels_overwrites_and_skips_nulls(spark):
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    got = one(
        spark,
        put_labels(base, {"b": F.lit("9"), "c": F.lit(None), "d": F.lit("4")}).alias("m"),
        put_labels(
            F.lit(None).cast("map<string,string>"), {"x": F.lit("1")}
        ).alias("n"),
    )
    assert got.m == {"a": "1", "b": "9", "d": "4"}
    assert got.n == {"x": "1"}


@pytest.mark.parametrize(
    "make",
    [
        lambda: model.AggRule("", "sum"),
        lambda: model.AggRule("m", "median"),
        lambda: model.AggRule("m", "histogram"),
        lambda: model.DedupConfig([], "1h"),
        lambda: model.DedupConfig(["a"], "0"),
        lambda: model.PiiConfig(salt=""),
        lambda: model.PiiConfig(salt="s", algorithm="md5"),
        lambda: model.Endpoint(""),
        lambda: model.SampleRule("no-equals"),
        lambda: model.SampleRule("a=b", 1.5),
    ],
)
def test_bad_configuration(make):
    with pytest.raises(model.ConfigError):
        make()


def test_sampling_of_rows_without_an_id(spark):
    from gaugeworks.model import SampleRule
    from gaugeworks.operators.select import sample, sample_by_rule, sample_trace

    df = spark.createDataFrame(
        [(i if i % 2 else None, f"v{i}", {"a": "x" if i % 3 else "y"}) for i in range(400)],
        "id bigint, v string, labels map<string,string>",
    )
    assert sample(df, "id", 1.0).count() == 400 and sample(df, "id", 0.0).count() == 0
    assert 50 < sample(df.filter("id is null"), "id", 0.5).count() < 150
    assert sample_by_rule(df, [SampleRule("a=x", 0.0)], "id").count() == 134
    assert sample_trace(df, "id", 1.0).count() == 400
    again = [sorted(r.v for r in sample(df.repartition(n), "id", 0.3).collect()) for n in (1, 5)]
    assert again[0] == again[1]


def test_bound_text_in_sql(spark):
    rng = random.Random(3)
    bounds = [0.0, -0.0, 1.0, 0.1, 0.5, 1e6, 999999.5, 123456.0, 1e-4, 0.00012, 9.9e-5, 1e7, 1.25e21, 2.5e-300, 100.0, -2.5, float("inf"), float("-inf")]
    bounds += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(300)] + [float(2**k) for k in range(-20, 40)]
    df = spark.createDataFrame([(b,) for b in bounds], "b double")
    got = df.select("b", F.expr(bound_text_sql("b")).alias("t")).collect()
    wrong = [(r.b, r.t) for r in got if r.t != bound_text(r.b) and not (r.b == 0 and r.t == "0")]
    assert not wrong
