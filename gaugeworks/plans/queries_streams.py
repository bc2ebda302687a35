"""Queries over streams that arrive in several micro-batches, and over payloads meant to break a decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.model import AggRule, DedupConfig
from gaugeworks.operators import dedup
from gaugeworks.operators.deadletter import read_dlq
from gaugeworks.operators.windows import add_points, stored_windows
from gaugeworks.plans import inputs
from gaugeworks.plans.catalog import query
from gaugeworks.plans.chain import ChainConfig, run_chain
from gaugeworks.plans.queries_aggregate import BUCKETS, DAY, DAY_US, EXACT_SUM, histogram_sql, rules
from gaugeworks.plans.queries_clean import HOUR_US, TTL_48H, USER_AND_TYPE
from gaugeworks.plans.queries_ingest import ASOF
from gaugeworks.session import scratch_path, written
from gaugeworks.sources import envelopes
from gaugeworks.sources.ledger import Ledger
from gaugeworks.streaming.aggregate import aggregate_anchored_stream, revised_windows, stored_windows_stream
from gaugeworks.streaming.chain import OUTCOME, chain_stream, stream_counts
from gaugeworks.streaming.dedup import dedup_ttl_stream, stream_store
from gaugeworks.streaming.enrich import enrich_host_stream
from gaugeworks.streaming.run import run_available

PARTS = 3


def landed(spark, df, ts: str = "ts", parts: int = PARTS, path: str | None = None) -> str:
    """Folders of files in order of time, landed one after the other."""
    path = path or scratch_path(spark, "landed")
    df = written(df, "to-land")
    first, last = df.agg(F.min(micros(ts)), F.max(micros(ts))).first()
    width = (last - first) // parts + 1
    part = F.floor((micros(ts) - first) / width)
    for p in range(parts):
        df.filter(part == p).coalesce(1).write.parquet(f"{path}/{p}")
    return path


def stream_of(spark, path: str, schema, files: int = 1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


# --- payloads --------------------------------------------------------------------


def hostile_batches(spark, d):
    """Each batch of points in one of seven ways: bare; with the label `user` twice; as series whose times
    overflow; as summaries; as exponential histograms; with a hashed e-mail before a raw one; cut off."""
    points = inputs.points(spark, d).withColumns(
        {"no": F.expr("id div 100"), "user": F.col("labels")["user"], "k": F.col("labels")["k"]}
    )
    _, digest = inputs.email_label(F.col("user"))
    raw = F.concat(F.lit("u"), "user", F.lit("@example.com"))
    way = F.col("no") % 7

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = F.col
    plain = ('{"id":', c("id"), ',"ts":', micros("ts"), ',"name":"', c("name"), '","value":', c("value"), ',"labels":{')
    user = ('"user":"', c("user"), '"')
    attributes = ('"attributes":{"user":"x","user":"', c("user"), '"}')
    point = (
        F.when(way == 1, text(*plain, '"user":"x",', *user, "}}"))
        .when(way == 2, text('{"labels":{"__name__":"', c("name"), '",', *user, '},"samples":[{"timestamp":', micros("ts"), '000,"value":', c("value"), "}]}"))
        .when(way == 3, text('{"name":"', c("name"), '","summary":{"dataPoints":[{"timeUnixNano":"', micros("ts"), '000","count":"3","sum":', c("value"), ',"quantileValues":[{"quantile":0.5,"value":', c("value"), "}],", *attributes, "}]}}"))
        .when(way == 4, text('{"name":"', c("name"), '","exponentialHistogram":{"dataPoints":[{"timeUnixNano":"', micros("ts"), '000","count":"5","sum":', c("value"), ',"zeroCount":"1","scale":1,"positive":{"offset":1,"bucketCounts":["3","1"]},', *attributes, "}]}}"))
        .when(way == 5, text(*plain, *user, ',"email":"', digest, '","email":"', raw, '"}}'))
        .otherwise(text(*plain, *user, "}}"))
    )
    grouped = points.withColumn("p", point).groupBy("no").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("ps"))
    body = (
        F.when(way == 2, text('{"timeseries":[', c("ps"), "]}"))
        .when(way.isin(3, 4), text('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[', c("ps"), "]}]}]}"))
        .when(way == 6, text("[", c("ps")))
        .otherwise(text("[", c("ps"), "]"))
    )
    return grouped.select(
        F.concat(F.lit("b"), "no").alias("batch_id"),
        F.encode(body, "UTF-8").alias("data"),
        F.lit("otlp").alias("format"),
        F.lit(False).alias("replay"),
        F.lit(1).cast("bigint").alias("config_generation"),
        F.create_map(F.lit("no"), F.col("no").cast("string")).alias("metadata"),
        F.create_map(F.lit("origin"), F.lit("landing")).alias("internal_labels"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000)).alias("received"),
    )


@query(
    "decode_hostile",
    f"""WITH {inputs.POINTS}, b AS (SELECT *, batch_no % 7 AS way FROM points)
    SELECT batch_no, way, CASE way WHEN 2 THEN 1700000000000000 ELSE us END AS us, name, value, u, NULL AS le, NULL AS quantile
      FROM b WHERE way IN (0, 1, 2)
    UNION ALL SELECT batch_no, way, us, name || '_count', CASE way WHEN 3 THEN 3 ELSE 5 END, u, NULL, NULL FROM b WHERE way IN (3, 4)
    UNION ALL SELECT batch_no, way, us, name || '_sum', value, u, NULL, NULL FROM b WHERE way IN (3, 4)
    UNION ALL SELECT batch_no, way, us, name, value, u, NULL, '0.5' FROM b WHERE way = 3
    UNION ALL SELECT batch_no, way, us, name || '_bucket', x.n, u, x.le, NULL FROM b, (VALUES
      ('0', 1.0), ('2', 4.0), ('2.82842712474619', 5.0), ('+Inf', 5.0)) AS x(le, n) WHERE way = 4""",
)
def decode_hostile(spark, d):
    """Good, doubled, overflowing, summarised and broken payloads side by side, personal values held back."""
    result = run_chain(hostile_batches(spark, d), ChainConfig(must_be_hashed=["email"]))
    no = F.col("metadata")["no"].cast("bigint")
    labels = F.col("labels")
    return result.points.select(
        no.alias("batch_no"),
        (no % 7).alias("way"),
        micros("ts").alias("us"),
        "name",
        "value",
        labels["user"].alias("u"),
        # 2 ** 1.5, whose last digit is the platform's.
        F.when(labels["le"].startswith("2.828427"), "2.82842712474619").otherwise(labels["le"]).alias("le"),
        labels["quantile"].alias("quantile"),
    )


@query(
    "hostile_outcomes",
    f"""WITH {inputs.POINTS}, b AS (SELECT DISTINCT batch_no, batch_no % 7 AS way FROM points)
    SELECT 'b' || batch_no AS batch_id, CASE WHEN way IN (5, 6) THEN 2 ELSE 1 END AS status,
           CASE way WHEN 5 THEN 'ERR_PII_LEAK' WHEN 6 THEN 'ERR_INVALID_INPUT' END AS error_code,
           way = 5 AS sent_to_dlq, FALSE AS raw_in_points
    FROM b""",
)
def hostile_outcomes(spark, d):
    """Every batch is accounted for, and no raw address is among the points."""
    result = run_chain(hostile_batches(spark, d), ChainConfig(must_be_hashed=["email"]))
    raw = result.points.filter(F.exists(F.map_values("labels"), lambda v: v.contains("@"))).select("batch_id").distinct()
    return (
        result.outcomes.drop("error_message")
        .join(raw.withColumn("raw", F.lit(True)), "batch_id", "left")
        .withColumn("raw_in_points", F.coalesce("raw", F.lit(False)))
        .drop("raw")
    )


# --- the chain -------------------------------------------------------------------


def _landed_batches(spark, d):
    """The batches as landed files, a few to a micro-batch, cut off every 17th and leaking every 13th."""
    no = F.col("metadata")["no"].cast("bigint")
    leak = F.encode(F.concat(F.lit('[{"name":"x","labels":{"email":"u'), no, F.lit('@example.com"}}]')), "UTF-8")
    batches = inputs.batches(spark, d).withColumns(
        {"data": F.when(no % 13 == 6, leak).otherwise(F.col("data")), "replay": F.lit(False)}
    )
    path = scratch_path(spark, "landed-batches")
    batches = written(batches, "batches")
    for p in range(PARTS):
        batches.filter(F.floor(no / 100) % PARTS == p).coalesce(1).write.parquet(f"{path}/{p}")
    return envelopes.read_batches(spark, f"{path}/*", stream=True, max_files=1)


_LANDED = f"""{inputs.POINTS}, landed AS (
  SELECT batch_no AS no, count(*) AS n, CASE WHEN batch_no % 13 = 6 THEN 'ERR_PII_LEAK'
    WHEN batch_no % 17 = 0 THEN 'ERR_INVALID_INPUT' END AS code FROM points GROUP BY batch_no)"""


@query(
    "chain_stream",
    f"""WITH {_LANDED}
    SELECT 'b' || no AS batch_id, code AS error_code, coalesce(code = 'ERR_PII_LEAK', FALSE) AS sent_to_dlq,
           CASE WHEN code IS NULL THEN n ELSE 0 END AS points,
           CASE WHEN code = 'ERR_PII_LEAK' THEN 1 ELSE 0 END AS letters,
           (SELECT count(*) FROM landed) AS received, (SELECT count(*) FROM landed WHERE code IS NULL) AS forwarded,
           (SELECT count(*) FROM landed WHERE code = 'ERR_PII_LEAK') AS dlq
    FROM landed""",
)
def chain_stream_query(spark, d):
    """Points, dead letters, outcomes and counts of a stream, each micro-batch a unit."""
    path = scratch_path(spark, "chain-stream")
    config = ChainConfig(must_be_hashed=["email"])
    ledger = chain_stream(_landed_batches(spark, d), config, f"{path}/out", f"{path}/state")
    points = ledger.read("points", None).groupBy("batch_id").agg(F.count(F.lit(1)).alias("points"))
    letters = read_dlq(spark, f"{path}/out").groupBy("batch_id").agg(F.count(F.lit(1)).alias("letters"))
    counts = stream_counts(spark, f"{path}/out").select("received", "forwarded", "dlq", F.lit(1).alias("one"))
    return (
        ledger.read("outcomes", OUTCOME)
        .select("batch_id", "error_code", "sent_to_dlq", F.lit(1).alias("one"))
        .join(points, "batch_id", "left")
        .join(letters, "batch_id", "left")
        .join(counts, "one")
        .drop("one")
        .withColumns(
            {c: F.coalesce(c, F.lit(0)).cast(t) for c, t in (("points", "bigint"), ("letters", "int"))}
        )
    )


@query(
    "chain_stream_dedup",
    f"""WITH RECURSIVE {inputs.POINTS}, whole AS (SELECT * FROM points WHERE batch_no % 17 <> 0 AND batch_no % 13 <> 6),
    keyed AS (SELECT u AS k1, name AS k2, us, id FROM whole), {inputs.ttl_chain("keyed", 48 * HOUR_US)}
    SELECT id, us, name, value, u FROM whole WHERE id IN (SELECT id FROM kept)""",
)
def chain_stream_dedup(spark, d):
    """The chain's own deduplication across micro-batches, its keys committed with the points.

    One micro-batch after another holds a part of the time, so that none is late for the next.
    """
    batches = inputs.batches(spark, d).withColumn("replay", F.lit(False))
    no = F.col("metadata")["no"].cast("bigint")
    batches = written(batches.filter(no % 13 != 6), "batches")
    path = scratch_path(spark, "landed-batches")
    last = batches.agg(F.max(no)).first()[0]
    for p in range(PARTS):
        batches.filter(F.floor(no * PARTS / (last + 1)) == p).coalesce(1).write.parquet(f"{path}/{p}")
    stream = envelopes.read_batches(spark, f"{path}/*", stream=True, max_files=1)
    config = ChainConfig(dedup=DedupConfig(USER_AND_TYPE, "48h"))
    ledger = chain_stream(stream, config, f"{path}-out", f"{path}-state", delay="720h")
    return ledger.read("points", None).select(
        "id", micros("ts").alias("us"), "name", "value", F.col("labels")["user"].alias("u")
    )


# --- deduplication ---------------------------------------------------------------


def _flat(spark, d):
    return inputs.points(spark, d).select("id", "ts", "name", "value", F.col("labels")["user"].alias("user"))


@query(
    "dedup_handover",
    f"""{TTL_48H}
    SELECT id, us, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 1 WHEN ts < TIMESTAMP '2024-01-20' THEN 2 ELSE 3 END AS run
    FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_handover(spark, d):
    """A batch run, a stream that starts from its store, and a batch run from the stream's state: one run."""
    points, keys = _flat(spark, d), ["user", "name"]
    one, two = (F.lit(f"2024-01-{day} 00:00:00").cast("timestamp") for day in (10, 20))
    first, store = dedup.dedup_against_store(
        points.filter(F.col("ts") < one), dedup.empty_store(points, keys), keys, "48h"
    )
    path = scratch_path(spark, "handover")
    middle = landed(spark, points.filter((F.col("ts") >= one) & (F.col("ts") < two)))
    stream = dedup_ttl_stream(
        stream_of(spark, middle, points.schema), keys, "48h", seen=written(store, "seen")
    )
    second = run_available(stream, f"{path}/out", f"{path}/state")
    store = written(stream_store(points, f"{path}/state", keys), "seen")
    third, _ = dedup.dedup_against_store(points.filter(F.col("ts") >= two), store, keys, "48h")
    out = None
    for run, part in enumerate((first, second, third), 1):
        part = part.select("id", micros("ts").alias("us"), F.lit(run).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "dedup_stream_gc",
    f"""{TTL_48H}, store AS (SELECT k1 AS u, k2 AS name, max(us) AS us FROM kept GROUP BY k1, k2)
    SELECT * FROM store
    WHERE NOT (us + {48 * HOUR_US} < epoch_us(TIMESTAMP '2024-01-31 00:00:00'))""",
)
def dedup_stream_gc(spark, d):
    """The live entries of a stream's own state, read from its checkpoint."""
    points, keys = _flat(spark, d), ["user", "name"]
    path = scratch_path(spark, "stream-state")
    stream = dedup_ttl_stream(stream_of(spark, landed(spark, points), points.schema), keys, "48h")
    run_available(stream, f"{path}/out", f"{path}/state")
    store = stream_store(points, f"{path}/state", keys)
    live = dedup.expire_seen(store, F.lit("2024-01-31 00:00:00").cast("timestamp"), "48h")
    return live.select(
        F.col("dedup_key.user").alias("u"), F.col("dedup_key.name").alias("name"), micros("last_kept").alias("us")
    )


# --- windows ---------------------------------------------------------------------

ALL_TYPES = [
    *rules("sum", "user"),
    AggRule("click", "avg", ["k"]),
    AggRule("error", "max"),
    AggRule("view", "min"),
    *rules("histogram", buckets=BUCKETS),
]

ALL_SQL = f"""SELECT name, window_us, {EXACT_SUM} AS value, u AS label_user, NULL AS label_k, NULL AS label_le
      FROM w GROUP BY name, window_us, u
    UNION ALL SELECT name, window_us, {EXACT_SUM} / count(*), NULL, k, NULL FROM w WHERE name = 'click' GROUP BY name, window_us, k
    UNION ALL SELECT name, window_us, max(value), NULL, NULL, NULL FROM w WHERE name = 'error' GROUP BY name, window_us
    UNION ALL SELECT name, window_us, min(value), NULL, NULL, NULL FROM w WHERE name = 'view' GROUP BY name, window_us
    UNION ALL BY NAME SELECT *, NULL AS label_user, NULL AS label_k FROM (
    {histogram_sql("w", "name, window_us", "name || '_bucket' AS name, window_us")})"""
WINDOWS = f"{inputs.POINTS}, w AS (SELECT *, us // {DAY_US} * {DAY_US} AS window_us FROM points)"


def _shown(df):
    labels = F.col("labels")
    return df.select(
        "name", micros("window_start").alias("window_us"), "value",
        *[labels[n].alias(f"label_{n}") for n in ("user", "k", "le")],
    )


@query("agg_stream_revised", f"WITH {WINDOWS} {ALL_SQL}")
def agg_stream_revised(spark, d):
    """All windows of a stream in update mode, the open ones included."""
    points = inputs.points(spark, d)
    path = scratch_path(spark, "revised")
    stream = stream_of(spark, landed(spark, points), points.schema)
    return _shown(revised_windows(stream, ALL_TYPES, f"{path}/out", f"{path}/state", DAY, exact=True))


@query("agg_stored_windows", f"WITH {WINDOWS} {ALL_SQL}")
def agg_stored_windows(spark, d):
    """Windows merged from a stream and from replayed points, which come last and touch their days only."""
    points = inputs.points(spark, d)
    path = scratch_path(spark, "stored")
    late = F.col("id") % 100 == 7
    stream = stream_of(spark, landed(spark, points.filter(~late)), points.schema)
    stored_windows_stream(stream, ALL_TYPES, f"{path}/out", f"{path}/state", DAY, exact=True)
    ledger = Ledger(spark, f"{path}/out")
    for _ in range(2):
        # The second attempt of a run changes nothing.
        add_points(ledger, 0, points.filter(late), ALL_TYPES, DAY, stream="replayed")
    return _shown(stored_windows(ledger, ALL_TYPES, DAY, exact=True))


@query(
    "agg_anchored_stream",
    f"""WITH {inputs.POINTS}, anchored AS (
      SELECT *, min(us) OVER (PARTITION BY name, u) AS anchor FROM points WHERE name IN ('click', 'error')),
    g AS (SELECT *, (us - anchor) // {DAY_US} AS window_index FROM anchored)
    SELECT name, u AS label_user, window_index, anchor + window_index * {DAY_US} AS window_us,
           CASE name WHEN 'click' THEN max(value) ELSE min(value) END AS value
    FROM g GROUP BY name, u, window_index, anchor
    HAVING anchor + (window_index + 1) * {DAY_US} <= (SELECT max(us) FROM points WHERE name IN ('click', 'error')) - 3600000000 - 1000""",
)
def agg_anchored_stream(spark, d):
    """Windows that begin at a group's first point, closed by timers."""
    points = inputs.points(spark, d).filter("name in ('click', 'error')")
    path = scratch_path(spark, "anchored")
    some = [AggRule("click", "max", ["user"]), AggRule("error", "min", ["user"])]
    stream = aggregate_anchored_stream(stream_of(spark, landed(spark, points), points.schema), some, DAY)
    return run_available(stream, f"{path}/out", f"{path}/state").select(
        "name", F.col("labels")["user"].alias("label_user"), "window_index",
        micros("window_start").alias("window_us"), "value",
    ).filter(
        # A window may end within the millisecond of the watermark.
        F.col("window_us") + DAY_US <= F.lit(points.agg(F.max(micros("ts"))).first()[0] - 3_600_000_000 - 1000)
    )


# --- enrichment ------------------------------------------------------------------


@query(
    "enrich_host_stream",
    f"""WITH {ASOF}
    SELECT id, name, hit, CASE WHEN hit THEN cpu_count END AS cpu_count,
           CASE WHEN hit THEN total_memory END AS total_memory
    FROM matched WHERE us // 60000000 * 60000000 + 60000000 <= (SELECT max(us) FROM host_points) - 2 * 3600000000""",
)
def enrich_host_on_streams(spark, d):
    """Points and snapshots on streams, looked up as of each point's time."""
    points = inputs.host_points(spark, d).select("id", "ts", "name", "value", "host")
    hosts = inputs.hosts(spark, d).select("hostname", "cpu_count", "total_memory", "collected_at")
    path = scratch_path(spark, "enrich-stream")
    both = landed(spark, points), landed(spark, hosts, "collected_at")
    stream = enrich_host_stream(
        stream_of(spark, both[0], points.schema), stream_of(spark, both[1], hosts.schema),
        "3d", "host", ["cpu_count", "total_memory"],
    )
    last = points.agg(F.max(micros("ts"))).first()[0]
    found = run_available(stream, f"{path}/out", f"{path}/state").filter(
        micros("ts") - F.pmod(micros("ts"), F.lit(60_000_000)) + 60_000_000 <= last - 7_200_000_000
    )
    return found.select(
        "id", "name", F.col("host_hit").alias("hit"), "host_info.cpu_count", "host_info.total_memory"
    )
