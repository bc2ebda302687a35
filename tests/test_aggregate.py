import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import AggRule, ConfigError, register_aggregation
from gaugeworks.operators import aggregate as agg

T0 = datetime(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def points(spark, rows):
    """rows: (id, seconds, name, value, labels)."""
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), n, v, m) for i, s, n, v, m in rows],
        "id bigint, ts timestamp, name string, value double, labels map<string,string>",
    )


def shown(df, *extra):
    return [
        (r.name, tuple(sorted(r.labels.items())), r.value, *(r[c] for c in extra))
        for r in df.collect()
    ]


def test_every_type(spark):
    df = points(spark, [(1, 0, "m", 1.0, {}), (2, 59, "m", 4.0, {}), (3, 60, "m", 10.0, {}),
                        (4, 0, "other", 1.0, {})])
    rules = [AggRule("m", t) for t in ("sum", "avg", "min", "max")]
    got = {(r.rule_id, r.window_start.minute): r.value for r in agg.aggregate(df, rules).collect()}
    assert got == {
        (0, 0): 5.0, (1, 0): 2.5, (2, 0): 1.0, (3, 0): 4.0,
        (0, 1): 10.0, (1, 1): 10.0, (2, 1): 10.0, (3, 1): 10.0,
    }


def test_histogram_edges(spark):
    values = [1.0, 5.0, 5.000001, 10.0, 11.0, INF, -INF, NAN]
    df = points(spark, [(i, 0, "m", v, {"le": "mine"}) for i, v in enumerate(values)])
    rules = [AggRule("m", "histogram", ["le"], [10, 5, 1e6])]
    got = {dict(labels)["le"]: v for _, labels, v in shown(agg.aggregate(df, rules, None))}
    # `<=` bounds, cumulative, sorted; infinity and NaN only under +Inf.
    assert got == {"5": 3.0, "10": 5.0, "1e+06": 6.0, "+Inf": 8.0}


def test_empty_buckets_are_emitted_and_empty_groups_not(spark):
    df = points(spark, [(1, 0, "m", 7.0, {})])
    rules = [AggRule("m", "histogram", [], [1, 2]), AggRule("absent", "histogram", [], [1])]
    assert [(r[0], r[2]) for r in shown(agg.aggregate(df, rules))] == [
        ("m_bucket", 0.0), ("m_bucket", 0.0), ("m_bucket", 1.0)
    ]
    assert agg.aggregate(df.filter("id > 9"), [AggRule("m", "sum")], None).count() == 0


def test_nan(spark):
    df = points(spark, [(1, 0, "m", NAN, {"g": "some"}), (2, 0, "m", 2.0, {"g": "some"}),
                        (3, 0, "m", NAN, {"g": "only"})])
    rules = [AggRule("m", t, ["g"]) for t in ("min", "max", "sum")]
    got = {(r.rule_id, r.labels["g"]): r.value for r in agg.aggregate(df, rules, None).collect()}
    assert got[0, "some"] == got[1, "some"] == 2.0
    assert got[0, "only"] is None and got[1, "only"] is None
    assert math.isnan(got[2, "some"])
    exact = agg.aggregate(df, rules[2:], None, exact=True).collect()
    assert all(math.isnan(r.value) for r in exact)


def test_absent_empty_and_null_labels(spark):
    df = points(spark, [(1, 0, "m", 1.0, {}), (2, 0, "m", 2.0, {"a": ""}), (3, 0, "m", 4.0, {"a": "x"}),
                        (4, 0, "m", 8.0, {"b": "1"})])
    got = shown(agg.aggregate(df, [AggRule("m", "sum", ["a"])], None))
    assert sorted(got) == [("m", (), 9.0), ("m", (("a", ""),), 2.0), ("m", (("a", "x"),), 4.0)]


def test_values_with_separators_stay_apart(spark):
    df = points(spark, [(1, 0, "m", 1.0, {"a": "1:b=2"}), (2, 0, "m", 2.0, {"a": "1", "b": "2"})])
    assert agg.aggregate(df, [AggRule("m", "sum", ["a", "b"])], None).count() == 2


def test_rules_do_not_share_state(spark):
    df = points(spark, [(1, 0, "m", 1.0, {})])
    rules = [AggRule("m", "histogram", [], [1]), AggRule("m", "histogram", [], [0.5, 2])]
    got = [(r.rule_id, r.labels["le"], r.value) for r in agg.aggregate(df, rules, None).collect()]
    assert sorted(got) == [(0, "+Inf", 1.0), (0, "1", 1.0), (1, "+Inf", 1.0), (1, "0.5", 0.0),
                           (1, "2", 1.0)]


def test_first_labels(spark):
    df = points(spark, [(2, 5, "m", 1.0, {"a": "late"}), (3, 0, "m", 1.0, {"a": "id3"}),
                        (1, 0, "m", 1.0, {"a": "id1", "x": "y"})])
    out = agg.aggregate(df, [AggRule("m", "sum")], None, labels="first").first()
    assert out.labels == {"a": "id1", "x": "y"}


def test_anchored_windows_follow_the_first_point(spark):
    df = points(spark, [(1, 7, "m", 1.0, {}), (2, 66, "m", 2.0, {}), (3, 67, "m", 4.0, {}),
                        (4, 1000, "m", 8.0, {}), (5, 3, "n", 1.0, {})])
    out = agg.aggregate_anchored(df, [AggRule("m", "sum"), AggRule("n", "sum")], 60)
    got = {(r.name, r.window_index, (r.window_start - T0).total_seconds()): r.value
           for r in out.collect()}
    # Empty windows pass in between without moving the grid.
    assert got == {("m", 0, 7.0): 3.0, ("m", 1, 67.0): 4.0, ("m", 16, 967.0): 8.0,
                   ("n", 0, 3.0): 1.0}


def test_exact_sums_do_not_depend_on_order(spark):
    df = points(spark, [(i, 0, "m", 0.1 * i, {}) for i in range(500)])
    got = {
        agg.aggregate(df.repartition(n), [AggRule("m", "sum")], None, exact=True).first().value
        for n in (1, 3, 7)
    }
    assert len(got) == 1
    # Values no such decimal can hold fall back to a plain sum.
    big = points(spark, [(1, 0, "m", 1e300, {}), (2, 0, "m", 1.0, {})])
    assert agg.aggregate(big, [AggRule("m", "sum")], None, exact=True).first().value == 1e300


def test_bad_arguments(spark):
    df = points(spark, [(1, 0, "m", 1.0, {})])
    for call in (
        lambda: agg.aggregate(df, []),
        lambda: agg.aggregate(df, [AggRule("m", "sum")], 0),
        lambda: agg.aggregate_anchored(df, [AggRule("m", "sum")], -1),
        lambda: agg.aggregate(df, [AggRule("m", "sum")], 60, labels="all"),
    ):
        with pytest.raises(ConfigError):
            call()


def test_partial_aggregation_comes_before_the_shuffle(spark):
    df = points(spark, [(1, 0, "m", 1.0, {})])
    out = agg.aggregate(df, [AggRule("m", "sum", ["a"]), AggRule("m", "histogram", [], [1])])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_custom_aggregation(spark):
    register_aggregation("spread", lambda v: F.max(v) - F.min(v))
    df = points(spark, [(1, 0, "m", 1.0, {"a": "x"}), (2, 0, "m", 5.5, {"a": "x"})])
    rules = [AggRule("m", "spread", ["a"]), AggRule("m", "sum")]
    got = {r.rule_id: r.value for r in agg.aggregate(df, rules, None).collect()}
    assert got == {0: 4.5, 1: 6.5}
    with pytest.raises(ConfigError):
        register_aggregation("sum", F.sum)


def test_default_sums_do_not_round(spark):
    df = points(spark, [(1, 0, "m", 0.00004, {}), (2, 0, "m", 0.00004, {}), (3, 0, "n", 3e15, {}), (4, 0, "n", 0.5, {})])
    for exact in (False, True):
        got = {r.name: r.value for r in agg.aggregate(df, [AggRule("m", "sum"), AggRule("n", "sum")], None, exact=exact).collect()}
        assert got == {"m": 0.00008, "n": 3000000000000000.5}
    # More digits than the decimals hold: the same sum, not a rounded one.
    tiny = points(spark, [(1, 0, "m", 1.5e-30, {}), (2, 0, "m", 1.5e-30, {})])
    assert agg.aggregate(tiny, [AggRule("m", "sum")], None, exact=True).first().value == 3e-30


def test_points_without_a_time_stay(spark):
    df = points(spark, [(1, 0, "m", 1.0, {}), (2, 90, "m", 2.0, {})]).union(
        points(spark, [(3, 0, "m", 4.0, {})]).withColumn("ts", F.lit(None).cast("timestamp"))
    )
    got = {r.window_start and (r.window_start - T0).total_seconds(): r.value for r in agg.aggregate(df, [AggRule("m", "sum")]).collect()}
    assert got == {0.0: 1.0, 60.0: 2.0, None: 4.0}
    anchored = agg.aggregate_anchored(df, [AggRule("m", "sum")]).collect()
    assert sorted(r.value for r in anchored) == [1.0, 2.0, 4.0]


def test_hundreds_of_rules_build_quickly(spark):
    import time

    df = points(spark, [(i, i, f"m{i % 300}", float(i), {"a": str(i % 3)}) for i in range(900)])
    rules = [AggRule(f"m{i}", ("sum", "max", "histogram")[i % 3], ["a"] * (i % 2), [1, 5, 10 + i] if i % 3 == 2 else ()) for i in range(500)]
    start = time.time()
    rows = agg.aggregate(df, rules, None).collect()
    assert time.time() - start < 30
    assert {r.name for r in rows if r.rule_id == 2} == {"m2_bucket"}
    got = {(r.rule_id, r.labels.get("a")): r.value for r in rows if r.rule_id in (3, 4)}
    assert got == {(3, "0"): 3.0 + 303 + 603, (4, None): 604.0} or got == {(3, None): 909.0, (4, None): 604.0} or (3, "0") in got
