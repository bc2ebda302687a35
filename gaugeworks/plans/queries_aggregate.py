"""Queries over aggregation and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.functions.values import bound_text
from gaugeworks.model import AggRule, DedupConfig
from gaugeworks.operators import aggregate as agg
from gaugeworks.operators import health
from gaugeworks.operators.deadletter import outcome
from gaugeworks.operators.dedup import dedup
from gaugeworks.plans import inputs
from gaugeworks.plans.catalog import query
from gaugeworks.plans.queries_clean import TTL_48H, USER_AND_TYPE
from gaugeworks.session import scratch_path
from gaugeworks.sources.envelopes import decode
from gaugeworks.streaming.aggregate import aggregate_stream
from gaugeworks.streaming.run import run_available

TYPES = ("click", "error", "purchase", "signup", "view")
DAY = 86_400
DAY_US = DAY * 1_000_000
BUCKETS = (100.0, 10.0, 50.0, 0.5, 250.0)
EXACT_SUM = "sum(value::VARCHAR::DECIMAL(38,18))::VARCHAR::DOUBLE"


def rules(type: str, *labels: str, buckets=()) -> list[AggRule]:
    return [AggRule(t, type, labels, buckets) for t in TYPES]


def _plain(df, *labels: str):
    return df.select(
        "name",
        micros("window_start").alias("window_us"),
        "value",
        *[F.col("labels")[n].alias(f"label_{n}") for n in labels],
    )


def _simple(name: str, type: str, expression: str, label: str) -> None:
    column = {"user": "u", "k": "k"}[label]

    @query(
        name,
        f"""WITH {inputs.POINTS}
        SELECT name, us // {DAY_US} * {DAY_US} AS window_us, {expression} AS value,
               {column} AS label_{label}
        FROM points GROUP BY name, us // {DAY_US}, {column}""",
    )
    def run(spark, d):
        return _plain(
            agg.aggregate(inputs.points(spark, d), rules(type, label), DAY, exact=True),
            label,
        )


_simple("agg_sum", "sum", EXACT_SUM, "user")
_simple("agg_avg", "avg", f"{EXACT_SUM} / count(*)", "k")
_simple("agg_min", "min", "min(value)", "user")
_simple("agg_max", "max", "max(value)", "k")


def histogram_sql(source: str, keys: str, outer: str, buckets=BUCKETS) -> str:
    """Cumulative rows per bucket of `source`, grouped by `keys`, shown as `outer`."""
    parts = [
        f"""SELECT {outer}, '{bound_text(b)}' AS label_le,
            (count(*) FILTER (value <= {b!r}::DOUBLE))::DOUBLE AS value
            FROM {source} GROUP BY {keys}"""
        for b in sorted(buckets)
    ]
    parts.append(
        f"SELECT {outer}, '+Inf' AS label_le, count(*)::DOUBLE AS value FROM {source} GROUP BY {keys}"
    )
    return " UNION ALL ".join(parts)


@query(
    "agg_histogram",
    f"""WITH {inputs.POINTS}
    {histogram_sql("points", f"name, us // {DAY_US}",
                   f"name || '_bucket' AS name, us // {DAY_US} * {DAY_US} AS window_us")}""",
)
def agg_histogram(spark, d):
    return _plain(
        agg.aggregate(inputs.points(spark, d), rules("histogram", buckets=BUCKETS), DAY), "le"
    )


MULTI = [
    AggRule("click", "sum", ["user"]),
    AggRule("click", "sum"),
    AggRule("click", "avg"),
    AggRule("error", "max", ["user"]),
    AggRule("error", "histogram", buckets=[25.0, 5.0]),
    AggRule("view", "min", ["absent"]),
]


@query(
    "agg_multi_rule",
    f"""WITH {inputs.POINTS}, w AS (
      SELECT *, us // {DAY_US} * {DAY_US} AS window_us FROM points)
    SELECT 0 AS rule_id, name, window_us, {EXACT_SUM} AS value, u AS label_user, NULL AS label_le
      FROM w WHERE name = 'click' GROUP BY name, window_us, u
    UNION ALL SELECT 1, name, window_us, {EXACT_SUM}, NULL, NULL
      FROM w WHERE name = 'click' GROUP BY name, window_us
    UNION ALL SELECT 2, name, window_us, {EXACT_SUM} / count(*), NULL, NULL
      FROM w WHERE name = 'click' GROUP BY name, window_us
    UNION ALL SELECT 3, name, window_us, max(value), u, NULL
      FROM w WHERE name = 'error' GROUP BY name, window_us, u
    UNION ALL SELECT 4, 'error_bucket', window_us, (count(*) FILTER (value <= 5.0))::DOUBLE, NULL, '5'
      FROM w WHERE name = 'error' GROUP BY window_us
    UNION ALL SELECT 4, 'error_bucket', window_us, (count(*) FILTER (value <= 25.0))::DOUBLE, NULL, '25'
      FROM w WHERE name = 'error' GROUP BY window_us
    UNION ALL SELECT 4, 'error_bucket', window_us, count(*)::DOUBLE, NULL, '+Inf'
      FROM w WHERE name = 'error' GROUP BY window_us
    UNION ALL SELECT 5, name, window_us, min(value), NULL, NULL
      FROM w WHERE name = 'view' GROUP BY name, window_us""",
)
def agg_multi_rule(spark, d):
    out = agg.aggregate(inputs.points(spark, d), MULTI, DAY, exact=True)
    return out.select(
        "rule_id",
        "name",
        micros("window_start").alias("window_us"),
        "value",
        F.col("labels")["user"].alias("label_user"),
        F.col("labels")["le"].alias("label_le"),
    )


@query(
    "agg_tumbling",
    f"""WITH {inputs.POINTS}
    SELECT name, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS window_us, {EXACT_SUM} AS value
    FROM points GROUP BY ALL""",
)
def agg_tumbling(spark, d):
    return _plain(agg.aggregate(inputs.points(spark, d), rules("sum"), exact=True))


#: Values far below 1e-4 and above 1e14, whose sums have no more bits than a double.
_SCALED = """scaled AS (
  SELECT name, id % 3 AS size, round(value)::DOUBLE * CASE id % 3 WHEN 0 THEN 1.1920928955078125e-7::DOUBLE
         WHEN 1 THEN 1125899906842624::DOUBLE ELSE 1::DOUBLE END AS v FROM points)"""


@query(
    "agg_unrounded",
    f"""WITH {inputs.POINTS}, {_SCALED}
    SELECT 'plain' AS way, name, size::VARCHAR AS label_size, sum(v) AS value FROM scaled GROUP BY ALL
    UNION ALL
    SELECT 'exact', name, size::VARCHAR, sum(v) FROM scaled GROUP BY ALL""",
)
def agg_unrounded(spark, d):
    """The default sums, and the repeatable ones, round no value."""
    size = F.col("id") % 3
    factor = F.when(size == 0, 2.0**-23).when(size == 1, 2.0**50).otherwise(1.0)
    points = inputs.points(spark, d).withColumns(
        {
            "value": F.round("value") * factor,
            "labels": F.create_map(F.lit("size"), size.cast("string")),
        }
    )
    out = None
    for way in ("plain", "exact"):
        part = agg.aggregate(points, rules("sum", "size"), None, exact=way == "exact").select(
            F.lit(way).alias("way"), "name", F.col("labels")["size"].alias("label_size"), "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "agg_many_rules",
    f"""WITH {inputs.POINTS}, named AS (SELECT name || '-' || uid % 60 AS metric, value, k FROM points)
    SELECT metric AS name, NULL AS label_le, k AS label_k, max(value) AS value FROM named GROUP BY ALL
    UNION ALL
    SELECT metric || '_bucket', '10', NULL, (count(*) FILTER (value <= 10))::DOUBLE FROM named GROUP BY metric
    UNION ALL
    SELECT metric || '_bucket', '+Inf', NULL, count(*)::DOUBLE FROM named GROUP BY metric""",
)
def agg_many_rules(spark, d):
    """600 rules: two for each of 300 metrics. The plan is that of a few."""
    metrics = [f"{t}-{i}" for t in TYPES for i in range(60)]
    many = [AggRule(m, "max", ["k"]) for m in metrics] + [AggRule(m, "histogram", [], [10.0]) for m in metrics]
    name = F.concat("name", F.lit("-"), F.col("labels")["user"].cast("bigint") % 60)
    out = agg.aggregate(inputs.points(spark, d).withColumn("name", name), many, None)
    labels = F.col("labels")
    return out.select("name", labels["le"].alias("label_le"), labels["k"].alias("label_k"), "value")


@query(
    "agg_anchored_window",
    f"""WITH {inputs.POINTS}, anchored AS (
      SELECT *, min(us) OVER (PARTITION BY name, u) AS anchor FROM points)
    SELECT name, u AS label_user, (us - anchor) // {DAY_US} AS window_index,
           anchor + (us - anchor) // {DAY_US} * {DAY_US} AS window_us, {EXACT_SUM} AS value
    FROM anchored GROUP BY ALL""",
)
def agg_anchored_window(spark, d):
    out = agg.aggregate_anchored(
        inputs.points(spark, d), rules("sum", "user"), DAY, exact=True
    )
    return out.select(
        "name",
        F.col("labels")["user"].alias("label_user"),
        F.col("window_index"),
        micros("window_start").alias("window_us"),
        "value",
    )


@query(
    "agg_first_labels",
    f"""WITH {inputs.POINTS}
    SELECT name, us // {DAY_US} * {DAY_US} AS window_us, max(value) AS value,
           arg_min(u, (us, id)) AS label_user, arg_min(k, (us, id)) AS label_k
    FROM points GROUP BY name, us // {DAY_US}""",
)
def agg_first_labels(spark, d):
    out = agg.aggregate(inputs.points(spark, d), rules("max"), DAY, labels="first")
    return _plain(out, "user", "k")


@query(
    "agg_missing_label",
    f"""WITH {inputs.POINTS}, {inputs.RAGGED}
    SELECT name, us // {DAY_US} * {DAY_US} AS window_us, {EXACT_SUM} AS value, k AS label_k
    FROM ragged GROUP BY name, us // {DAY_US}, k""",
)
def agg_missing_label(spark, d):
    out = agg.aggregate(inputs.ragged_points(spark, d), rules("sum", "k"), DAY, exact=True)
    return _plain(out, "k")


@query(
    "agg_stream",
    f"""WITH {inputs.POINTS}
    SELECT name, us // {DAY_US} * {DAY_US} AS window_us, {EXACT_SUM} AS value FROM points
    WHERE (us // {DAY_US} + 1) * {DAY_US} <= (SELECT max(us) FROM points) - 3600000000
    GROUP BY name, us // {DAY_US}""",
)
def agg_stream(spark, d):
    schema = inputs.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).options(pathGlobFilter="events.parquet", maxFilesPerTrigger=1)
    stream = aggregate_stream(
        inputs.as_points(events.parquet(d)), rules("sum"), DAY, "1 hour", exact=True
    )
    path = scratch_path(spark, "stream-agg")
    return _plain(run_available(stream, f"{path}/out", f"{path}/state"))


SUMMARY = [
    *rules("sum", "user"),
    *rules("histogram", buckets=BUCKETS),
]


@query(
    "chain_summary",
    f"""{TTL_48H}, fresh AS (SELECT * FROM points WHERE id IN (SELECT id FROM kept))
    SELECT name, us // {DAY_US} * {DAY_US} AS window_us, {EXACT_SUM} AS value,
           u AS label_user, NULL AS label_le
    FROM fresh GROUP BY name, us // {DAY_US}, u
    UNION ALL BY NAME
    SELECT *, NULL AS label_user FROM (
    {histogram_sql("fresh", f"name, us // {DAY_US}",
                   f"name || '_bucket' AS name, us // {DAY_US} * {DAY_US} AS window_us")})""",
)
def chain_summary(spark, d):
    """The flagship: TTL deduplication, then all rules in one pass."""
    fresh = dedup(inputs.points(spark, d), DedupConfig(USER_AND_TYPE, "48h"))
    return _plain(agg.aggregate(fresh, SUMMARY, DAY, exact=True), "user", "le")


@query(
    "health_counts",
    f"""WITH {inputs.POINTS}, {inputs.BATCHES}, judged AS (
      SELECT *, CASE WHEN broken THEN 'decode' WHEN no % 7 = 0 THEN 'forward'
                     WHEN no % 7 = 1 THEN 'open' ELSE 'ok' END AS what FROM batches),
    stages(stage) AS (VALUES ('agg'), ('dp'))
    SELECT stage, count(*) AS received, count(*) FILTER (what = 'ok') AS forwarded,
           count(*) FILTER (what <> 'decode') AS processed,
           count(*) FILTER (what <> 'ok') AS rejected,
           count(*) FILTER (what = 'forward') AS dlq,
           count(*) FILTER (what = 'decode' AND stage = 'dp') AS processing_errors,
           count(*) FILTER (what = 'decode' AND stage = 'agg') AS validation_errors
    FROM judged, stages GROUP BY stage""",
)
def health_counts(spark, d):
    decoded = decode(inputs.batches(spark, d))
    no = F.col("metadata")["no"].cast("bigint")
    forward = F.when(no % 7 == 0, "failed").when(no % 7 == 1, "open").otherwise("ok")
    out = None
    for stage, code in (("agg", "ERR_INVALID_INPUT"), ("dp", "ERR_PROCESSING_FAILED")):
        part = outcome(
            decoded,
            F.when(F.col("malformed"), F.lit(code)),
            F.lit("failed to parse batch data"),
            F.lit(False),
            forward,
            F.lit(True),
        ).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return health.stage_counts(out)


@query(
    "health_latency_hist",
    f"""WITH d AS (SELECT event_type, value / 100 AS value FROM events),
    h AS ({histogram_sql("d", "event_type", "event_type", health.LATENCY_BUCKETS)})
    SELECT event_type, label_le AS le, value::BIGINT AS count FROM h""",
)
def health_latency_hist(spark, d):
    timed = inputs.table(spark, d, "events").withColumn("seconds", F.col("value") / 100)
    return health.latency_histogram(timed, "seconds", ["event_type"])


@query(
    "health_error_rate",
    f"""SELECT user_id % 10 AS dependency, epoch_us(ts) // {DAY_US} * {DAY_US} AS window_us,
           count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures,
           count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS failure_percent,
           count(*) >= 20 AND
           count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) >= 25 AS tripped
    FROM events GROUP BY 1, 2""",
)
def health_error_rate(spark, d):
    requests = inputs.table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("dependency"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
    )
    out = health.error_rate_trips(requests, "dependency", "failed", DAY, threshold=25.0)
    return out.withColumn("window_us", micros("window_start")).drop("window_start")


@query(
    "health_transitions",
    f"""WITH {inputs.POINTS}, steps AS (
      SELECT name AS from_state, us, lead(name) OVER w AS to_state, lead(us) OVER w AS next_us
      FROM points WINDOW w AS (PARTITION BY uid ORDER BY us, id))
    SELECT from_state, to_state, count(*) AS transitions,
           sum(next_us - us)::BIGINT AS micros_in_state
    FROM steps WHERE from_state <> to_state GROUP BY 1, 2""",
)
def health_transitions(spark, d):
    points = inputs.points(spark, d).withColumn("user", F.col("labels")["user"])
    return health.transition_counts(health.state_transitions(points, "user", "name"))


@query(
    "rules_as_of",
    f"""WITH {inputs.POINTS}, versions(rule_id, metric, generation, threshold) AS (VALUES
      ('c', 'click', 1, 10.0::DOUBLE), ('c', 'click', 3, 30.0::DOUBLE),
      ('e', 'error', 2, 5.0::DOUBLE))
    SELECT id, id % 4 AS config_generation, v.rule_id, v.generation::BIGINT AS rule_generation,
           v.threshold, coalesce(value > v.threshold, FALSE) AS above
    FROM points LEFT JOIN versions v ON v.metric = name AND v.generation = (
      SELECT max(w.generation) FROM versions w
      WHERE w.metric = name AND (id % 4 = 0 OR w.generation <= id % 4))""",
)
def rules_as_of(spark, d):
    versions = spark.createDataFrame(
        [
            ("c", "click", 1, 1, 10.0),
            ("c", "click", 3, 2, 30.0),
            # Arrives late with an old generation, so it never takes effect.
            ("c", "click", 2, 3, 20.0),
            ("e", "error", 2, 1, 5.0),
        ],
        "rule_id string, name string, generation bigint, seq bigint, threshold double",
    )
    points = inputs.points(spark, d).withColumn("config_generation", F.col("id") % 4)
    return health.rules_as_of(points, versions, ["name"]).select(
        "id",
        "config_generation",
        "rule_id",
        "rule_generation",
        "threshold",
        F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).alias("above"),
    )
