"""Queries over classification, deduplication and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.functions.values import (
    EMAIL_IN_TEXT,
    IPV4_IN_TEXT,
    hash_pii,
    is_hashed_or_encoded,
    label_entries,
)
from gaugeworks.model import ClassRule, Connection, PiiConfig, SampleRule
from gaugeworks.operators import dedup, pii, select
from gaugeworks.plans import inputs
from gaugeworks.plans.catalog import query
from gaugeworks.session import scratch_path, written
from gaugeworks.streaming.dedup import dedup_stream_with_store, dedup_ttl_stream
from gaugeworks.streaming.run import run_available

SALT = inputs.SALT
HOUR_US = 3_600_000_000
RAW_EMAIL = "'u' || u || '@example.com'"
HASHED_EMAIL = f"sha256('{SALT}' || {RAW_EMAIL})"


@query("pii_hash", f"SELECT id, {HASHED_EMAIL} AS email_hash FROM (SELECT event_id AS id, user_id AS u FROM events)")
def pii_hash(spark, d):
    raw = F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com"))
    return inputs.table(spark, d, "events").select(
        F.col("event_id").alias("id"), hash_pii(raw, SALT).alias("email_hash")
    )


@query(
    "pii_hash_fields",
    f"""WITH {inputs.POINTS}
    SELECT id, value, {HASHED_EMAIL} AS email_hash, sha256('{SALT}' || name) AS user_name_hash,
           sha256('{SALT}' || u) AS label_user_hash, k AS label_k, 2 AS label_count
    FROM points""",
)
def pii_hash_fields(spark, d):
    raw, _ = inputs.email_label(F.col("labels")["user"])
    wide = inputs.points(spark, d).select(
        "id",
        "value",
        raw.alias("email"),
        F.col("name").alias("user_name"),
        pii.hash_pii_labels(
            F.col("labels"), PiiConfig(salt=SALT, fields=["user", "command_line"])
        ).alias("labels"),
    )
    return pii.hash_pii_fields(wide, PiiConfig(salt=SALT)).select(
        "id",
        "value",
        "email_hash",
        "user_name_hash",
        F.col("labels")["user_hash"].alias("label_user_hash"),
        F.col("labels")["k"].alias("label_k"),
        F.size("labels").alias("label_count"),
    )


@query(
    "pii_leak_split",
    f"""WITH {inputs.POINTS}, leaking AS (
      SELECT DISTINCT batch_no FROM points WHERE value > 200)
    SELECT 'b' || batch_no AS batch_id,
           CASE WHEN batch_no IN (FROM leaking) THEN 0 ELSE count(*) END AS clean_points,
           CASE WHEN batch_no IN (FROM leaking) THEN 'ERR_PII_LEAK' END AS error_code,
           CASE WHEN batch_no IN (FROM leaking)
                THEN 'PII leak detected: unhashed email' END AS error_message
    FROM points GROUP BY batch_no""",
)
def pii_leak_split(spark, d):
    clean, errors = pii.detect_leaks(inputs.points_with_email(spark, d))
    return (
        clean.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("clean_points"))
        .select(
            "batch_id",
            "clean_points",
            F.lit(None).cast("string").alias("error_code"),
            F.lit(None).cast("string").alias("error_message"),
        )
        .unionByName(
            errors.select(
                "batch_id",
                F.lit(0).cast("bigint").alias("clean_points"),
                "error_code",
                "error_message",
            )
        )
    )


@query(
    "pii_is_hashed",
    f"""WITH {inputs.POINTS}, texts AS (
      SELECT id, CASE id % 3 WHEN 0 THEN {HASHED_EMAIL} WHEN 1 THEN name || u
                 ELSE {RAW_EMAIL} END AS t FROM points)
    SELECT id, regexp_matches(t, '^[0-9a-f]{{64}}$') OR
               (regexp_matches(t, '^[A-Za-z0-9+/]+={{0,2}}$') AND length(t) % 4 = 0) AS loose,
           regexp_matches(t, '^[0-9a-f]{{64}}$') AS strict
    FROM texts""",
)
def pii_is_hashed(spark, d):
    raw, digest = inputs.email_label(F.col("labels")["user"])
    text = (
        F.when(F.col("id") % 3 == 0, digest)
        .when(F.col("id") % 3 == 1, F.concat("name", F.col("labels")["user"]))
        .otherwise(raw)
    )
    return (
        inputs.points(spark, d)
        .withColumn("t", text)
        .select(
            "id",
            is_hashed_or_encoded("t").alias("loose"),
            is_hashed_or_encoded("t", strict=True).alias("strict"),
        )
    )


@query(
    "pii_audit",
    f"""WITH {inputs.POINTS}, audited(name, field, seen, leaked) AS (
      SELECT name, 'email', count(*), count(*) FILTER (value > 200) FROM points GROUP BY name
      UNION ALL
      SELECT name, 'user', count(*), count(*) FILTER (length(u) % 4 <> 0) FROM points GROUP BY name
      UNION ALL
      SELECT name, 'ip_address', 0, 0 FROM points GROUP BY name)
    SELECT * FROM audited""",
)
def pii_audit(spark, d):
    return pii.leak_audit(
        inputs.points_with_email(spark, d), ["email", "user", "ip_address"], by=["name"]
    )


@query(
    "pii_scrub_documents",
    rf"""SELECT doc_id,
      regexp_replace(regexp_replace(text, '{EMAIL_IN_TEXT}', '<email>', 'g'),
                     '{IPV4_IN_TEXT}', '\1<ip>', 'g') AS text,
      length(regexp_extract_all(text, '{EMAIL_IN_TEXT}'))::INTEGER AS emails_found,
      length(regexp_extract_all(text, '{IPV4_IN_TEXT}'))::INTEGER AS ips_found
    FROM documents""",
)
def pii_scrub_documents(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "text")
    return pii.scrub_text(inputs.dealt(docs), "text")


@query(
    "classify_labels",
    f"""WITH {inputs.POINTS}
    SELECT id, CASE WHEN name = 'error' THEN 'fault' WHEN value > 100 THEN 'large'
                    WHEN k = '7' THEN 'seven' END AS category,
           CASE WHEN name = 'error' THEN 'page' WHEN value > 100 THEN 'review' END AS team,
           u, k
    FROM points""",
)
def classify_labels(spark, d):
    rules = [
        ClassRule("seven", "labels['k'] = '7'", priority=3),
        ClassRule("large", "value > 100", priority=2, labels={"team": "review"}),
        ClassRule("fault", "name = 'error'", priority=1, labels={"team": "page"}),
    ]
    labels = F.col("labels")
    return pii.classify(inputs.points(spark, d), rules).select(
        "id",
        "category",
        labels["team"].alias("team"),
        labels["user"].alias("u"),
        labels["k"].alias("k"),
    )


@query(
    "dedup_key",
    f"""WITH {inputs.POINTS}, {inputs.RAGGED}
    SELECT id, k IS NOT NULL AS has_all_keys, k AS key_k, name AS key_name FROM ragged""",
)
def dedup_key(spark, d):
    keyed = dedup.dedup_key(inputs.ragged_points(spark, d), ["name", "labels.k"])
    return keyed.select(
        "id",
        "has_all_keys",
        F.col("dedup_key.labels_k").alias("key_k"),
        F.col("dedup_key.name").alias("key_name"),
    )


@query(
    "dedup_first",
    f"""WITH {inputs.POINTS}, {inputs.RAGGED}
    SELECT id, us, name, value FROM ragged WHERE k IS NULL
    UNION ALL
    (SELECT id, us, name, value FROM ragged WHERE k IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY name, k ORDER BY us, id) = 1)""",
)
def dedup_first(spark, d):
    return dedup.dedup_first(inputs.ragged_points(spark, d), ["name", "labels.k"]).select(
        "id", micros("ts").alias("us"), "name", "value"
    )


TTL_48H = f"""WITH RECURSIVE {inputs.POINTS},
keyed AS (SELECT u AS k1, name AS k2, us, id FROM points),
{inputs.ttl_chain("keyed", 48 * HOUR_US)}"""
USER_AND_TYPE = ["labels.user", "name"]


@query(
    "dedup_ttl",
    f"""{TTL_48H} SELECT id, us, name, value, u FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_ttl(spark, d):
    return dedup.dedup_ttl(inputs.points(spark, d), USER_AND_TYPE, "48h").select(
        "id", micros("ts").alias("us"), "name", "value", F.col("labels")["user"].alias("u")
    )


@query(
    "dedup_ttl_heavy_keys",
    f"""WITH RECURSIVE {inputs.POINTS},
    keyed AS (SELECT name AS k1, us, id FROM points),
    {inputs.ttl_chain("keyed", 2 * HOUR_US, "k1")}
    SELECT id, us, name FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_ttl_heavy_keys(spark, d):
    # Five keys hold all rows; the bound sends them down the path for heavy keys.
    return dedup.dedup_ttl(inputs.points(spark, d), ["name"], "2h", heavy_rows=500).select(
        "id", micros("ts").alias("us"), "name"
    )


@query(
    "dedup_ttl_stream",
    f"""{TTL_48H} SELECT id, us, name, value, u FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_ttl_stream_query(spark, d):
    path = scratch_path(spark, "stream-dedup")
    stream = dedup_ttl_stream(_flat_stream(spark, d), ["user", "name"], "48h")
    return _shown_stream(run_available(stream, f"{path}/out", f"{path}/state"))


def _flat_stream(spark, d):
    schema = inputs.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).options(pathGlobFilter="events.parquet", maxFilesPerTrigger=1)
    return inputs.as_points(events.parquet(d)).select(
        "id", "ts", "name", "value", F.col("labels")["user"].alias("user")
    )


def _shown_stream(df):
    return df.select(
        "id", micros("ts").alias("us"), "name", "value", F.col("user").alias("u")
    )


@query(
    "dedup_ttl_stream_store",
    f"""{TTL_48H} SELECT id, us, name, value, u FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_ttl_stream_store(spark, d):
    path = scratch_path(spark, "stream-dedup")
    return _shown_stream(
        dedup_stream_with_store(
            _flat_stream(spark, d), ["user", "name"], "48h", f"{path}/out", f"{path}/state"
        )
    )


def _two_runs(spark, d):
    points = inputs.points(spark, d)
    split = F.lit("2024-01-15 00:00:00").cast("timestamp")
    nothing = dedup.empty_store(points, USER_AND_TYPE)
    first, store = dedup.dedup_against_store(
        points.filter(F.col("ts") < split), nothing, USER_AND_TYPE, "48h"
    )
    store = written(store, "seen")
    second, store = dedup.dedup_against_store(
        points.filter(F.col("ts") >= split), store, USER_AND_TYPE, "48h"
    )
    return first, second, store


@query(
    "dedup_incremental",
    f"""{TTL_48H}
    SELECT id, us, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS run
    FROM points WHERE id IN (SELECT id FROM kept)""",
)
def dedup_incremental(spark, d):
    first, second, _ = _two_runs(spark, d)
    return (
        first.withColumn("run", F.lit(1))
        .unionByName(second.withColumn("run", F.lit(2)))
        .select("id", micros("ts").alias("us"), "run")
    )


@query(
    "dedup_gc",
    f"""{TTL_48H}, store AS (SELECT k1 AS u, k2 AS name, max(us) AS us FROM kept GROUP BY k1, k2)
    SELECT * FROM store
    WHERE NOT (us + {48 * HOUR_US} < epoch_us(TIMESTAMP '2024-01-30 12:00:00'))""",
)
def dedup_gc(spark, d):
    _, _, store = _two_runs(spark, d)
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return dedup.expire_seen(store, now, "48h").select(
        F.col("dedup_key.labels_user").alias("u"),
        F.col("dedup_key.name").alias("name"),
        micros("last_kept").alias("us"),
    )


@query(
    "dedup_counts",
    f"""{TTL_48H}
    SELECT p.u AS labels_user, p.name, count(*) AS seen,
           count(*) FILTER (p.id IN (SELECT id FROM kept)) AS kept,
           count(*) FILTER (p.id NOT IN (SELECT id FROM kept)) AS dropped
    FROM points p GROUP BY p.u, p.name""",
)
def dedup_counts(spark, d):
    return dedup.dedup_counts(inputs.points(spark, d), USER_AND_TYPE, "48h")


RULES = [
    SampleRule("k=7", 1.0),
    SampleRule("k=8", 0.25),
    SampleRule("user=3", 0.5),
    SampleRule("k=9", 0.0),
]


def fraction(id: str, seed: int | str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {id}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "filter_pattern",
    f"""WITH {inputs.POINTS} SELECT id, name, value, u, k FROM points
    WHERE k IN ('7', '8', '9') OR u = '3'""",
)
def filter_pattern(spark, d):
    labels = F.col("labels")
    return select.filter_rules(inputs.points(spark, d), RULES).select(
        "id", "name", "value", labels["user"].alias("u"), labels["k"].alias("k")
    )


@query(
    "sample_by_rule",
    f"""WITH {inputs.POINTS} SELECT id, k, u FROM points
    WHERE {fraction("id", 11)} <
      CASE WHEN k = '7' THEN 1.0 WHEN k = '8' THEN 0.25 WHEN u = '3' THEN 0.5
           WHEN k = '9' THEN 0.0 ELSE 1.0 END""",
)
def sample_by_rule(spark, d):
    labels = F.col("labels")
    return select.sample_by_rule(inputs.points(spark, d), RULES, "id", 11).select(
        "id", labels["k"].alias("k"), labels["user"].alias("u")
    )


@query(
    "sample_deterministic",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE {fraction("l_orderkey || '/' || l_linenumber", 42)} < 0.1""",
)
def sample_deterministic(spark, d):
    lines = inputs.table(spark, d, "lineitem").withColumn(
        "line", F.concat("l_orderkey", F.lit("/"), "l_linenumber")
    )
    return select.sample(lines, "line", 0.1, 42).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@query(
    "sample_by_group",
    f"""SELECT conv_id, turn, role, text FROM conversations
    WHERE {fraction("conv_id", 42)} < 0.3""",
)
def sample_by_group(spark, d):
    turns = inputs.table(spark, d, "conversations")
    return select.sample_trace(turns, "conv_id", 0.3, 42).select(
        "conv_id", "turn", "role", "text"
    )


@query(
    "route_by_filter",
    f"""WITH {inputs.POINTS}
    SELECT id, 'archive' AS target, value FROM points WHERE value > 50
    UNION ALL SELECT id, 'alerts', value FROM points WHERE name = 'error'
    UNION ALL SELECT id, 'seven', value FROM points WHERE k = '7'""",
)
def route_by_filter(spark, d):
    edges = [
        Connection("archive", "value > 50"),
        Connection("alerts", "name = 'error'"),
        Connection("seven", "labels['k'] = '7'"),
        Connection("nowhere", "labels['absent'] = 'x'"),
    ]
    return select.route(inputs.points(spark, d), edges).select("id", "target", "value")


@query(
    "strip_labels",
    f"""WITH {inputs.POINTS} SELECT id, 'k=' || k || ';user=' || u AS labels FROM points""",
)
def strip_labels(spark, d):
    internal = F.create_map(F.lit("__internal"), F.lit("1"), F.lit("__hop"), F.col("name"))
    marked = inputs.points(spark, d).withColumn("labels", F.map_concat("labels", internal))
    text = F.array_join(
        F.transform(
            label_entries(F.col("labels")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        ";",
    )
    return select.strip_internal_labels(marked).select("id", text.alias("labels"))
