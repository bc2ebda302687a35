"""Rule-driven aggregation: sum, average, minimum, maximum, cumulative histogram.

Every rule is evaluated in one pass and one shuffle. A point is handed to each rule
naming its metric, combined on the map side, and only the partial states of a group
travel, so a group holding most of the data costs a group's state, not its rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.clock import instant, micros
from gaugeworks.functions.values import bound_text, label_entries
from gaugeworks.model import CUSTOM_AGGREGATIONS, AggRule, require
from gaugeworks.session import written

#: Holds sums of numbers below 10**20 with 18 digits behind the point.
EXACT = "decimal(38,18)"


def _table(rows: Sequence[Sequence[str]], kind: str) -> Column:
    """A constant array with an entry per rule, read by `rule_id`.

    Written as one JSON text, which the optimizer turns into a constant: the plan has the
    same size for one rule and for hundreds.
    """
    return F.from_json(F.lit(json.dumps(rows)), "array<array<string>>").cast(f"array<array<{kind}>>")


def of_rule(rows: Sequence[Sequence[str]], kind: str = "string") -> Column:
    return F.get(_table(rows, kind), F.col("rule_id"))


def apply_rules(points: DataFrame, rules: Sequence[AggRule]) -> DataFrame:
    """One row per (point, matching rule): `rule_id` and `group_labels`.

    `group_labels` holds the rule's label values in rule order, null where absent, so
    an absent label and an empty one are different groups. Points no rule names end
    here.
    """
    require(len(rules) > 0, "at least one aggregation rule must be defined")
    named = json.dumps([{"name": rule.metric, "rule_id": i} for i, rule in enumerate(rules)])
    targets = points.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(named), "array<struct<name:string,rule_id:int>>"))
    )
    labels = F.col("labels")
    # The table has a row per rule, and rules are written by hand.
    return (
        points.join(F.broadcast(targets), "name")
        .select(*points.columns, "rule_id")
        .withColumn(
            "group_labels",
            F.transform(of_rule([r.labels for r in rules]), lambda name: labels[name]),
        )
    )


def _total(value: Column, exact: bool) -> Column:
    if not exact:
        return F.sum(value)
    # Decimal addition is associative: the same digits in any task order. A number that is
    # not the same number as a decimal (NaN, an infinity, more digits than fit) is not
    # rounded to one: its group is added as doubles.
    digits = value.try_cast(EXACT)
    lossy = F.count_if(digits.isNull() | (digits.cast("double") != value))
    return F.when(lossy > 0, F.sum(value)).otherwise(
        F.coalesce(F.try_sum(digits).cast("double"), F.sum(value))
    )


def _states(rules: Sequence[AggRule], exact: bool, labels: str) -> list[Column]:
    """The partial states the rules' types need, and no others."""
    types = {r.type for r in rules}
    value = F.coalesce(F.col("value"), F.lit(0.0))
    number = F.when(~F.isnan(value), value)
    out = [F.count(F.lit(1)).alias("_n")]
    if types & {"sum", "avg"}:
        out.append(_total(value, exact).alias("_sum"))
    if "min" in types:
        out.append(F.min(number).alias("_min"))
    if "max" in types:
        out.append(F.max(number).alias("_max"))
    bounds = [bounds_of(r) for r in rules]
    bound_of = of_rule([[str(b) for b in bs] for bs in bounds], "double")
    for j in range(max(map(len, bounds))):
        # Spark orders NaN above every number; a NaN only counts under +Inf.
        out.append(F.count_if(number <= F.get(bound_of, F.lit(j))).alias(f"_b{j}"))
    for name in sorted(types & set(CUSTOM_AGGREGATIONS)):
        out.append(CUSTOM_AGGREGATIONS[name](value).alias(f"_custom_{name}"))
    if labels == "first":
        out.append(F.min_by("labels", F.struct("ts", "id")).alias("_first"))
    return out


def bounds_of(rule: AggRule) -> list[float]:
    return rule.bounds if rule.type == "histogram" else []


def emit(grouped: DataFrame, rules: Sequence[AggRule], labels: str) -> DataFrame:
    """States to output points: one row per group, or one per bucket of a histogram."""
    facts = of_rule([[r.metric, r.type] for r in rules])
    metric, type = F.get(facts, F.lit(0)), F.get(facts, F.lit(1))
    states = {
        "sum": lambda: F.col("_sum"),
        "avg": lambda: F.col("_sum") / F.col("_n"),
        "min": lambda: F.col("_min"),
        "max": lambda: F.col("_max"),
    }
    one = F.lit(None).cast("double")
    for name in sorted({r.type for r in rules} - {"histogram"}):
        state = states.get(name, lambda name=name: F.col(f"_custom_{name}"))()
        one = F.when(type == name, state.cast("double")).otherwise(one)
    width = max(len(bounds_of(r)) for r in rules)
    counts = F.array(*[F.col(f"_b{j}").cast("double") for j in range(width)], F.col("_n").cast("double"))
    texts = of_rule([[*map(bound_text, bounds_of(r)), "+Inf"] for r in rules])
    buckets = F.transform(
        texts,
        lambda le, j: F.struct(
            F.concat(metric, F.lit("_bucket")).alias("name"),
            # A rule's last bucket, wherever it is in the list, counts all.
            F.get(counts, F.when(j == F.size(texts) - 1, width).otherwise(j)).alias("value"),
            le.alias("le"),
        ),
    )
    single = F.array(
        F.struct(metric.alias("name"), one.alias("value"), F.lit(None).cast("string").alias("le"))
    )
    out = grouped.withColumn(
        "_row", F.explode(F.when(type == "histogram", buckets).otherwise(single))
    )
    if labels == "first":
        base = F.col("_first")
    else:
        base = F.map_filter(
            F.map_from_arrays(of_rule([r.labels for r in rules]), F.col("group_labels")),
            lambda _, v: v.isNotNull(),
        )
    le = F.col("_row.le")
    full = F.when(le.isNull(), base).otherwise(
        F.map_concat(
            F.map_filter(base, lambda k, _: k != "le"), F.create_map(F.lit("le"), le)
        )
    )
    kept = [c for c in grouped.columns if not c.startswith("_") and c != "group_labels"]
    return out.select(
        *kept,
        F.col("_row.name").alias("name"),
        F.col("_row.value").alias("value"),
        full.alias("labels"),
    )


def _with_first_labels(matched: DataFrame, grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_first`, the labels of each group's first row by (ts, id, hash of the labels).

    Each task passes on one row of a group; the states are joined to it, so that they stay in a hash
    aggregate: a minimum of whole maps would sort all rows twice.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "id", F.xxhash64(label_entries(F.col("labels"))))
    first = (
        matched.select(*keys, "ts", "id", "labels")
        .withColumn("_place", F.row_number().over(order))
        .filter("_place = 1")
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("labels").alias("_first"))
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return grouped.join(first, same).drop(*[f"_of_{k}" for k in keys])


def aggregate(
    points: DataFrame,
    rules: Sequence[AggRule],
    window_seconds: int | None = 60,
    labels: str = "group",
    exact: bool = False,
) -> DataFrame:
    """All rules over tumbling windows (or over everything when there is no window).

    Points without `ts` form groups of their own, with null windows. `labels="first"` puts
    out all labels of a group's first point by (ts, id). `exact` adds values as decimals,
    which makes sums repeatable to the last digit, and rounds none. On a stream, set a
    watermark on `ts` first; there points without `ts` have no window and end here.
    """
    require(window_seconds is None or window_seconds > 0, "windowSeconds must be positive")
    require(labels in ("group", "first"), f"unknown label mode: {labels}")
    matched = apply_rules(points, rules)
    keys = [F.col("rule_id"), F.col("group_labels")]
    if not points.isStreaming:
        names = ["rule_id", "group_labels"]
        if window_seconds is not None:
            # F.window would drop points without a time.
            step = window_seconds * 1_000_000
            matched = matched.withColumn("_start", micros("ts") - F.pmod(micros("ts"), F.lit(step)))
            names.append("_start")
        grouped = matched.groupBy(*names).agg(*_states(rules, exact, "group"))
        if labels == "first":
            grouped = _with_first_labels(matched, grouped, names)
        if window_seconds is not None:
            grouped = grouped.withColumns(
                {"window_start": instant(F.col("_start")), "window_end": instant(F.col("_start") + step)}
            )
    elif window_seconds is None:
        grouped = matched.groupBy(*keys).agg(*_states(rules, exact, labels))
    else:
        keys.append(F.window("ts", f"{window_seconds} seconds").alias("window"))
        grouped = matched.groupBy(*keys).agg(*_states(rules, exact, labels))
        grouped = grouped.withColumns(
            {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
        ).drop("window")
    return emit(grouped, rules, labels)


def aggregate_anchored(
    points: DataFrame,
    rules: Sequence[AggRule],
    window_seconds: int = 60,
    labels: str = "group",
    exact: bool = False,
) -> DataFrame:
    """Windows that start at each group's own first point and follow without gaps.

    The anchors are a map-side combined minimum, written (one row per group) and joined
    back, not a window function: a group of any size stays spread over tasks, and
    anchors of known small size are broadcast, so only partial states are shuffled.
    Points without `ts` form groups with a null window.
    """
    require(window_seconds > 0, "windowSeconds must be positive")
    matched = apply_rules(points, rules)
    anchors = written(
        matched.groupBy("rule_id", "group_labels").agg(F.min(micros("ts")).alias("_anchor")),
        "anchors",
    )
    step = window_seconds * 1_000_000
    grouped = (
        matched.join(anchors, ["rule_id", "group_labels"])
        .withColumn(
            "window_index", F.expr(f"(unix_micros(ts) - _anchor) div {step}")
        )
        .groupBy("rule_id", "group_labels", "_anchor", "window_index")
        .agg(*_states(rules, exact, labels))
        .withColumn(
            "window_start", instant(F.col("_anchor") + F.col("window_index") * step)
        )
    )
    return emit(grouped, rules, labels)


def histogram(
    df: DataFrame, value: str, buckets: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative bucket counts of one column: `le`, `count` per group."""
    bounds = sorted(float(b) for b in buckets)
    number = F.when(~F.isnan(value), F.col(value))
    counted = df.groupBy(*by).agg(
        *[F.count_if(number <= b).alias(f"_b{j}") for j, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("_n"),
    )
    if not by:
        counted = counted.filter("_n > 0")
    names = [bound_text(b) for b in bounds] + ["+Inf"]
    cells = [f"_b{j}" for j in range(len(bounds))] + ["_n"]
    rows = F.array(
        *[F.struct(F.lit(n).alias("le"), F.col(c).alias("count")) for n, c in zip(names, cells)]
    )
    return counted.select(*by, F.inline(rows))
