"""Queries over validation, dead letters, export and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.model import (
    ERR_FORWARDING_FAILED,
    ERR_INVALID_INPUT,
    ERR_PII_LEAK,
    ERR_PROCESSING_FAILED,
    POINT_JSON,
    AggRule,
    ClassRule,
    Connection,
    DedupConfig,
    Endpoint,
    SampleRule,
)
from gaugeworks.operators import deadletter as dl
from gaugeworks.operators import validate as val
from gaugeworks.operators.dedup import dedup_ttl
from gaugeworks.operators.export import export, exported, pack_batches
from gaugeworks.plans import inputs
from gaugeworks.plans.catalog import query
from gaugeworks.plans.chain import ChainConfig, PackConfig, run_chain
from gaugeworks.plans.queries_aggregate import DAY, DAY_US, EXACT_SUM, TYPES
from gaugeworks.plans.queries_clean import HASHED_EMAIL, HOUR_US, RAW_EMAIL, fraction
from gaugeworks.session import scratch_path
from gaugeworks.sources.envelopes import decode, explode_points
from gaugeworks.streaming.export import export_stream

# --- documents to validate -------------------------------------------------------


def documents(spark, d, broken: bool = False):
    """One JSON document per event, with faults by turns of the id."""
    i, labels = F.col("id"), F.col("labels")
    user, k = labels["user"], labels["k"]
    raw, digest = inputs.email_label(user)

    def pick(n, cases, otherwise):
        out = None
        for rest, text in cases.items():
            text = F.lit(text) if isinstance(text, str) else text
            out = F.when(i % n == rest, text) if out is None else out.when(i % n == rest, text)
        return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)

    value = F.col("value").cast("string")
    host = pick(
        6,
        {
            0: '{"cpu":4}',
            1: F.concat(F.lit('{"name":"h'), user, F.lit('","cpu":"x"}')),
            2: '"flat"',
        },
        F.concat(F.lit('{"name":"h'), user, F.lit('","cpu":4}')),
    )
    text = F.concat(
        F.lit('{"id":'),
        i.cast("string"),
        pick(11, {0: ""}, F.concat(F.lit(',"name":"'), "name", F.lit('"'))),
        F.lit(',"value":'),
        pick(13, {0: F.concat(F.lit('"'), value, F.lit('"'))}, value),
        F.lit(',"count":'),
        pick(9, {0: "2.5", 1: "3.0"}, k),
        F.lit(',"time":"'),
        pick(
            5,
            {0: F.date_format("ts", "yyyy-MM-dd HH:mm")},
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ),
        F.lit('","host":'),
        host,
        F.lit(',"tags":["a","b"'),
        pick(8, {0: ",5"}, ""),
        F.lit('],"samples":[{"v":1.5}'),
        pick(14, {0: ',{"v":"bad"}', 1: ",{}"}, ""),
        F.lit('],"email":"'),
        pick(3, {0: digest, 1: F.concat("name", user)}, raw),
        F.lit('"'),
        pick(4, {0: ',"user.phone":"555 0100"'}, ""),
        F.lit(',"active":'),
        pick(15, {0: "null"}, "true"),
        F.lit(',"site":"'),
        pick(7, {0: ""}, "https://"),
        F.lit('example.com","zone":'),
        pick(19, {0: "7"}, '"utc"'),
        F.lit("}"),
    )
    if broken:
        text = pick(17, {0: F.substring(text, F.lit(1), F.length(text) - 1)}, text)
    return inputs.dealt(inputs.points(spark, d)).select("id", F.encode(text, "UTF-8").alias("data"))


_TEXT = f"""'{{"id":' || id ||
  CASE WHEN id % 11 = 0 THEN '' ELSE ',"name":"' || name || '"' END ||
  ',"value":' || CASE WHEN id % 13 = 0 THEN '"' || value || '"' ELSE value::VARCHAR END ||
  ',"count":' || CASE id % 9 WHEN 0 THEN '2.5' WHEN 1 THEN '3.0' ELSE k END ||
  ',"time":"' || CASE WHEN id % 5 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END ||
  '","host":' || CASE id % 6 WHEN 0 THEN '{{"cpu":4}}' WHEN 1 THEN '{{"name":"h' || u || '","cpu":"x"}}'
                    WHEN 2 THEN '"flat"' ELSE '{{"name":"h' || u || '","cpu":4}}' END ||
  ',"tags":["a","b"' || CASE WHEN id % 8 = 0 THEN ',5' ELSE '' END ||
  '],"samples":[{{"v":1.5}}' || CASE id % 14 WHEN 0 THEN ',{{"v":"bad"}}' WHEN 1 THEN ',{{}}' ELSE '' END ||
  '],"email":"' || CASE id % 3 WHEN 0 THEN {HASHED_EMAIL} WHEN 1 THEN name || u ELSE {RAW_EMAIL} END ||
  '"' || CASE WHEN id % 4 = 0 THEN ',"user.phone":"555 0100"' ELSE '' END ||
  ',"active":' || CASE WHEN id % 15 = 0 THEN 'null' ELSE 'true' END ||
  ',"site":"' || CASE WHEN id % 7 = 0 THEN '' ELSE 'https://' END ||
  'example.com","zone":' || CASE WHEN id % 19 = 0 THEN '7' ELSE '"utc"' END || '}}'"""
DOCS = f"""{inputs.POINTS}, docs AS (SELECT id, ({_TEXT})::JSON AS j FROM points)"""
BROKEN_DOCS = f"""{inputs.POINTS}, texts AS (SELECT id, {_TEXT} AS t FROM points),
docs AS (SELECT id, TRY_CAST(CASE WHEN id % 17 = 0 THEN left(t, length(t) - 1) ELSE t END AS JSON) AS j
         FROM texts)"""

DATE_TIME_SQL = (
    r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$'"
)


def missing(name: str, at: str = "", parent: str = "$"):
    return (
        f"json_type(j, '{parent}.{name}') IS NULL",
        f"missing required field: {name}",
        f"{at}{name}",
    )


def wrong_type(path: str, expected: str):
    kind = f"json_type(j, '$.{path}')"
    number = f"json_extract_string(j, '$.{path}')"
    ok = {
        "string": f"{kind} = 'VARCHAR'",
        "number": f"{kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
        "integer": f"({kind} IN ('UBIGINT', 'BIGINT') OR "
        f"({kind} = 'DOUBLE' AND TRY_CAST({number} AS DOUBLE) % 1 = 0))",
        "boolean": f"{kind} = 'BOOLEAN'",
        "object": f"{kind} = 'OBJECT'",
        "array": f"{kind} = 'ARRAY'",
    }[expected]
    return (
        f"{kind} IS NOT NULL AND NOT ({ok})",
        f"invalid field type: expected {expected}",
        path,
    )


def wrong_format(path: str, pattern: str | None, title: str = ""):
    kind, text = f"json_type(j, '$.{path}')", f"json_extract_string(j, '$.{path}')"
    rows = [
        (
            f"{kind} <> 'VARCHAR'",
            "invalid field type: format validation requires string",
            path,
        )
    ]
    if pattern:
        rows.append(
            (
                f"NOT regexp_matches({text}, {pattern})",
                f"invalid field value: invalid {title} format",
                path,
            )
        )
    return rows


def leaked(key: str, label: str):
    text = f"json_extract_string(j, '$.\"{key}\"')"
    return (
        f"json_type(j, '$.\"{key}\"') IS NOT NULL AND NOT (json_type(j, '$.\"{key}\"') = 'VARCHAR' AND "
        f"(regexp_matches({text}, '^[0-9a-f]{{64}}$') OR "
        f"(regexp_matches({text}, '^[A-Za-z0-9+/]+={{0,2}}$') AND length({text}) % 4 = 0)))",
        f"PII field detected without hashing: {label}",
        label,
    )


_BAD_TAG = (
    "json_type(j, '$.tags[2]') = 'UBIGINT'",
    "invalid field type: expected string",
    "tags[2]",
)
_BAD_V = (
    "json_type(j, '$.samples[1].v') = 'VARCHAR'",
    "invalid field type: expected number",
    "samples[1].v",
)
_NO_V = (
    "json_type(j, '$.samples[1]') = 'OBJECT' AND json_type(j, '$.samples[1].v') IS NULL",
    "missing required field: v",
    "samples[1].v",
)
HOST_SQL = [
    wrong_type("host", "object"),
    missing("name", "host.", "$.host"),
    missing("cpu", "host.", "$.host"),
    wrong_type("host.cpu", "integer"),
    wrong_type("host.name", "string"),
]
HOST = {
    "type": "object",
    "required": ["name", "cpu"],
    "properties": {"name": {"type": "string"}, "cpu": {"type": "integer"}},
}
TAGS = {"type": "array", "items": {"type": "string"}}
SAMPLES = {
    "type": "array",
    "items": {
        "type": "object",
        "required": ["v"],
        "properties": {"v": {"type": "number"}},
    },
}


def verdict(checks, column: int, start: str = "") -> str:
    when = " ".join(f"WHEN {c[0]} THEN '{c[column]}'" for c in checks)
    return f"CASE {start} {when} END"


def checks_sql(checks) -> str:
    return f"""WITH {DOCS}
    SELECT id, {verdict(checks, 1)} AS error, {verdict(checks, 2)} AS path FROM docs"""


def _checked(name: str, checks, schema=None, pii=(), required=None) -> None:
    @query(name, checks_sql(checks))
    def run(spark, d):
        out = val.with_violation(documents(spark, d), schema, "data", pii, required)
        return out.select("id", "violation.error", "violation.path")


_checked(
    "validate_required",
    [missing("id"), missing("name"), missing("value"), wrong_type("host", "object"),
     missing("name", "host.", "$.host"), missing("cpu", "host.", "$.host")],
    {
        "required": ["id", "name", "value"],
        "properties": {"host": {"type": "object", "required": ["name", "cpu"], "properties": {}}},
    },
)
TYPED = {
    "active": "boolean", "count": "integer", "host": "object",
    "name": "string", "tags": "array", "value": "number",
}
_checked(
    "validate_type",
    [wrong_type(n, t) for n, t in sorted(TYPED.items())],
    {"properties": {n: {"type": t} for n, t in TYPED.items()}},
)
FORMATS_SQL = [
    *wrong_format("email", r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'", "email"),
    *wrong_format("site", r"'^[a-zA-Z][a-zA-Z0-9+.-]*:\/\/'", "URI"),
    *wrong_format("time", DATE_TIME_SQL, "date-time"),
    *wrong_format("zone", None),
]
_checked(
    "validate_format",
    FORMATS_SQL,
    {
        "properties": {
            "email": {"format": "email"},
            "site": {"format": "uri"},
            "time": {"type": "string", "format": "date-time"},
            "zone": {"format": "time-zone"},
        }
    },
)
_checked("validate_nested", HOST_SQL, {"properties": {"host": HOST}})
_checked(
    "validate_array",
    [_BAD_V, _NO_V, _BAD_TAG],
    {"properties": {"samples": SAMPLES, "tags": TAGS}},
)
PII_SQL = [leaked("email", "email"), leaked("user.phone", "user.phone")]
_checked("validate_pii", PII_SQL, {}, pii=["user.email", "user.phone"])
_checked(
    "validate_simple",
    [
        missing("id"),
        ("json_type(j, '$.host') <> 'OBJECT'",
         "invalid field type: host is not an object", "host.name"),
        ("json_type(j, '$.host.name') IS NULL",
         "missing required field: host.name", "host.name"),
        leaked("email", "email"),
    ],
    required=["id", "host.name"],
    pii=["email"],
)

FULL = {
    "type": "object",
    "required": ["id", "name", "value"],
    "properties": {
        "active": {"type": "boolean"},
        "count": {"type": "integer"},
        "host": HOST,
        "samples": SAMPLES,
        "site": {"type": "string", "format": "uri"},
        "tags": TAGS,
        "time": {"type": "string", "format": "date-time"},
        "value": {"type": "number"},
        "zone": {"format": "time-zone"},
    },
}
FULL_SQL = [
    missing("id"), missing("name"), missing("value"),
    wrong_type("active", "boolean"), wrong_type("count", "integer"),
    *HOST_SQL, _BAD_V, _NO_V,
    *FORMATS_SQL[2:4], _BAD_TAG, *FORMATS_SQL[4:6],
    wrong_type("value", "number"), *FORMATS_SQL[6:],
    *PII_SQL,
]
JUDGED = f"""{BROKEN_DOCS}, judged AS (
  SELECT id, {verdict(FULL_SQL, 1, "WHEN j IS NULL THEN 'failed to parse batch data'")} AS error,
         {verdict(FULL_SQL, 2, "WHEN j IS NULL THEN NULL")} AS path FROM docs)"""
PII_FIELDS = ["user.email", "user.phone"]


@query(
    "validate_split",
    f"""WITH {JUDGED}
    SELECT id, error IS NULL AS accepted,
           CASE WHEN error IS NOT NULL THEN 'ERR_INVALID_INPUT' END AS error_code,
           CASE WHEN path IS NULL THEN error
                ELSE 'schema validation failed at path ''' || path || ''': ' || error
           END AS error_message FROM judged""",
)
def validate_split(spark, d):
    # Valid and rejected rows side by side, so the payloads are checked once.
    out = val.with_violation(documents(spark, d, True), FULL, "data", PII_FIELDS)
    bad = F.col("violation").isNotNull()
    return out.select(
        "id",
        (~bad).alias("accepted"),
        F.when(bad, F.lit(ERR_INVALID_INPUT)).alias("error_code"),
        F.when(bad, val.error_message(F.col("violation"))).alias("error_message"),
    )


@query(
    "validate_counts",
    f"""WITH {JUDGED}
    SELECT id % 3 AS sender, coalesce(error, '') AS reason, count(*) AS rows
    FROM judged GROUP BY 1, 2""",
)
def validate_counts(spark, d):
    checked = val.with_violation(documents(spark, d, True), FULL, pii_fields=PII_FIELDS)
    return val.validation_counts(checked.withColumn("sender", F.col("id") % 3), ["sender"])


# --- dead letters ----------------------------------------------------------------

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(
    "dlq_annotate",
    f"""WITH {inputs.POINTS}, {inputs.BATCHES}
    SELECT batch_id, 'json' AS format, epoch_us(TIMESTAMP '{NOW}') AS us,
           'ERR_FORWARDING_FAILED' AS error_code, 'next stage is away' AS error_message,
           'gw' AS fb_sender, 'landing' AS label_origin, 'next stage is away' AS label_error,
           'ERR_FORWARDING_FAILED' AS label_error_code, 'gw' AS label_fb_sender,
           (epoch_us(TIMESTAMP '{NOW}') // 1000000)::VARCHAR AS label_dlq_timestamp,
           no::VARCHAR AS meta_no
    FROM batches""",
)
def dlq_annotate(spark, d):
    out = dl.to_dlq(
        inputs.batches(spark, d), "gw", ERR_FORWARDING_FAILED, "next stage is away", _now()
    )
    labels = F.col("internal_labels")
    return out.select(
        "batch_id", "format", micros("timestamp").alias("us"), "error_code",
        "error_message", "fb_sender",
        *[
            labels[n].alias(f"label_{n}")
            for n in ("origin", "error", "error_code", "fb_sender", "dlq_timestamp")
        ],
        F.col("metadata")["no"].alias("meta_no"),
    )


@query(
    "batch_outcome",
    f"""WITH {inputs.POINTS}, b AS (
      SELECT batch_no AS no, batch_no % 17 = 0 AS broken, max(value) > 200 AS leak,
             batch_no % 3 <> 0 AS dlq_ok FROM points GROUP BY batch_no),
    c AS (SELECT *, CASE WHEN broken THEN 'ERR_PROCESSING_FAILED' WHEN leak THEN 'ERR_PII_LEAK'
                         WHEN no % 7 = 0 THEN 'ERR_FORWARDING_FAILED'
                         WHEN no % 7 = 1 THEN 'ERR_CIRCUIT_BREAKER_OPEN'
                         WHEN no % 7 = 2 THEN 'throttled' END AS what FROM b),
    r AS (SELECT *, coalesce(what IN ('ERR_PII_LEAK', 'ERR_FORWARDING_FAILED'), FALSE) AS dead FROM c)
    SELECT 'b' || no AS batch_id,
           CASE WHEN what IS NULL THEN 1 WHEN what = 'throttled' THEN 3 ELSE 2 END AS status,
           CASE WHEN dead AND NOT dlq_ok THEN 'ERR_DLQ_SEND_FAILED'
                WHEN what <> 'throttled' THEN what END AS error_code,
           CASE WHEN dead AND NOT dlq_ok THEN 'failed to send to DLQ'
                WHEN what = 'ERR_PROCESSING_FAILED' THEN 'failed to parse batch data'
                WHEN what = 'ERR_PII_LEAK' THEN 'PII leak detected'
                WHEN what = 'ERR_CIRCUIT_BREAKER_OPEN' THEN 'circuit breaker is open'
                WHEN what = 'ERR_FORWARDING_FAILED' THEN 'forwarding failed' END AS error_message,
           dead AND dlq_ok AS sent_to_dlq
    FROM r""",
)
def batch_outcome(spark, d):
    decoded = decode(inputs.batches(spark, d))
    no = F.col("metadata")["no"].cast("bigint")
    leak = F.coalesce(F.exists("points", lambda p: p["value"] > 200), F.lit(False))
    malformed = F.col("malformed")
    return dl.outcome(
        decoded,
        F.when(malformed, F.lit(ERR_PROCESSING_FAILED)).when(leak, F.lit(ERR_PII_LEAK)),
        F.when(malformed, F.lit("failed to parse batch data")).otherwise(
            F.lit("PII leak detected")
        ),
        ~malformed,
        F.when(no % 7 == 0, "failed")
        .when(no % 7 == 1, "open")
        .when(no % 7 == 2, "throttled")
        .otherwise("ok"),
        no % 3 != 0,
    )


SELECTED = f"""ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND ts <= TIMESTAMP '{NOW}' - INTERVAL 2 DAY
  AND error_code = 'ERR_FORWARDING_FAILED'"""
FILTER = {"since": "20d", "until": "48h", "error_code": ERR_FORWARDING_FAILED}


def _landed_dlq(spark, d):
    path = scratch_path(spark, "dlq")
    dl.write_dlq(inputs.dead_letters(spark, d), path)
    return dl.read_dlq(spark, path)


@query(
    "dlq_replay_filter",
    f"""WITH {inputs.DEAD} SELECT batch_id, us, fb_sender FROM dead
    WHERE {SELECTED} AND fb_sender = 'gw'""",
)
def dlq_replay_filter(spark, d):
    out = dl.replay_select(_landed_dlq(spark, d), _now(), sender="gw", **FILTER)
    return out.select("batch_id", micros("timestamp").alias("us"), "fb_sender")


@query(
    "dlq_replay_stamp",
    f"""WITH {inputs.DEAD}
    SELECT batch_id, 'json' AS format, TRUE AS replay, 0::BIGINT AS config_generation,
           event_type AS label_origin, 'true' AS label_replay,
           '2024-01-31T00:00:00Z' AS label_replay_timestamp, user_id::VARCHAR AS meta_user
    FROM dead WHERE {SELECTED}""",
)
def dlq_replay_stamp(spark, d):
    picked = dl.replay_select(inputs.dead_letters(spark, d), _now(), **FILTER)
    labels = F.col("internal_labels")
    return dl.replay_stamp(picked, _now()).select(
        "batch_id", "format", "replay", "config_generation",
        *[labels[n].alias(f"label_{n}") for n in ("origin", "replay", "replay_timestamp")],
        F.col("metadata")["user"].alias("meta_user"),
    )


ATTEMPT = f"""CASE WHEN event_type = 'signup' THEN 'unmarshal-error'
  WHEN NOT ({SELECTED}) THEN 'filtered' WHEN user_id % 10 = 0 THEN 'grpc-error'
  WHEN user_id % 10 = 1 THEN 'ERR_THROTTLED' ELSE 'replayed' END"""


def _attempts(letters, unreadable):
    user = F.col("metadata")["user"].cast("bigint")
    return dl.replay_attempts(
        letters,
        dl.matches(_now(), **FILTER),
        unreadable,
        F.when(user % 10 == 0, F.lit("grpc-error")).when(
            user % 10 == 1, F.lit("ERR_THROTTLED")
        ),
    )


@query(
    "dlq_replay_stats",
    f"""WITH {inputs.DEAD}, a AS (SELECT {ATTEMPT} AS attempt FROM dead)
    SELECT 'total' AS stat, count(*) AS count FROM a
    UNION ALL SELECT 'filtered', count(*) FROM a WHERE attempt = 'filtered'
    UNION ALL SELECT 'replayed', count(*) FROM a WHERE attempt = 'replayed'
    UNION ALL SELECT 'errors', count(*) FROM a WHERE attempt NOT IN ('filtered', 'replayed')
    UNION ALL SELECT 'error:' || attempt, count(*) FROM a
      WHERE attempt NOT IN ('filtered', 'replayed') GROUP BY attempt""",
)
def dlq_replay_stats(spark, d):
    """Letters landed as JSON lines, of which every one of a signup is broken off."""
    letters = inputs.dead_letters(spark, d)
    line = F.to_json(F.struct(*letters.columns))
    cut = F.substring(line, F.lit(1), F.length(line) - 9)
    path = scratch_path(spark, "dlq-lines")
    letters.select(
        F.when(F.col("internal_labels")["origin"] == "signup", cut).otherwise(line).alias("value")
    ).write.text(path)
    return dl.replay_stats(_attempts(dl.read_dlq_json(spark, path), F.col("unreadable")))


@query(
    "dlq_delete_replayed",
    f"""WITH {inputs.DEAD} SELECT batch_id, us FROM dead WHERE ({ATTEMPT}) <> 'replayed'""",
)
def dlq_delete_replayed(spark, d):
    path = scratch_path(spark, "dlq")
    dl.write_dlq(inputs.dead_letters(spark, d), path)
    tried = _attempts(inputs.dead_letters(spark, d), F.col("internal_labels")["origin"] == "signup")
    dl.delete_replayed_at(spark, path, tried.filter("attempt = 'replayed'"))
    return dl.read_dlq(spark, path).select("batch_id", micros("timestamp").alias("us"))


@query(
    "dlq_retention",
    f"""WITH {inputs.DEAD} SELECT batch_id, us FROM dead
    WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 100 HOUR""",
)
def dlq_retention(spark, d):
    path = scratch_path(spark, "dlq")
    dl.write_dlq(inputs.dead_letters(spark, d), path)
    dl.retain_at(spark, path, 100, _now())
    return dl.read_dlq(spark, path).select("batch_id", micros("timestamp").alias("us"))


# --- the chain -------------------------------------------------------------------


def _config() -> ChainConfig:
    return ChainConfig(
        dedup=DedupConfig(["labels.user", "name"], "48h"),
        sampling=[SampleRule("k=8", 0.25)],
        seed=5,
        aggregation=[AggRule(t, "sum", ["user"]) for t in TYPES],
        window_seconds=DAY,
        exact=True,
    )


def chain_sql(replayed: str) -> str:
    return f"""WITH RECURSIVE {inputs.POINTS}, whole AS (
      SELECT *, {replayed} AS replay FROM points WHERE batch_no % 17 <> 0),
    keyed AS (SELECT u AS k1, name AS k2, us, id FROM whole WHERE NOT replay),
    {inputs.ttl_chain("keyed", 48 * HOUR_US)},
    passed AS (SELECT * FROM whole WHERE (replay OR id IN (SELECT id FROM kept))
               AND {fraction("id", 5)} < CASE WHEN k = '8' THEN 0.25 ELSE 1.0 END)
    SELECT name, us // {DAY_US} * {DAY_US} AS window_us, {EXACT_SUM} AS value, u AS label_user
    FROM passed GROUP BY name, us // {DAY_US}, u"""


def _shown(result):
    return result.output.select(
        "name",
        micros("window_start").alias("window_us"),
        "value",
        F.col("labels")["user"].alias("label_user"),
    )


@query("chain_end_to_end", chain_sql("batch_no % 5 = 0"))
def chain_end_to_end(spark, d):
    return _shown(run_chain(inputs.batches(spark, d, "mixed"), _config(), _now()))


@query("dlq_replay_e2e", chain_sql("batch_no % 7 = 0"))
def dlq_replay_e2e(spark, d):
    arrived = inputs.batches(spark, d, "mixed").withColumn("replay", F.lit(False))
    failed = F.col("metadata")["no"].cast("bigint") % 7 == 0
    path = scratch_path(spark, "dlq")
    dl.write_dlq(
        dl.to_dlq(
            arrived.filter(failed), "gw", ERR_FORWARDING_FAILED, "next stage is away", _now()
        ),
        path,
    )
    picked = dl.replay_select(
        dl.read_dlq(spark, path), _now(), since="1h", error_code=ERR_FORWARDING_FAILED
    )
    again = dl.replay_stamp(picked, _now())
    both = dl.replay_into(arrived.filter(~failed), again, [])
    return _shown(run_chain(both, _config(), _now()))


CONFIGURED = ChainConfig(
    must_be_hashed=["email"],
    classification=[
        ClassRule("big", "value > 100", 1, {"tier": "big"}),
        ClassRule("odd", "id % 2 = 1", 2, {"tier": "odd"}),
    ],
    filters=[SampleRule("tier=big"), SampleRule("tier=odd")],
    sampling=[SampleRule("tier=odd", 0.0), SampleRule("k=8", 1.0)],
    connections=[Connection("all"), Connection("errors", "name = 'error'")],
    pack=PackConfig("target", 50),
    output_schema={
        "type": "object",
        "required": ["name"],
        "properties": {"value": {"type": "number"}},
    },
    endpoints=[Endpoint("packed"), Endpoint("errors", "json", "batch_id like 'errors-%'")],
)


def _mixed_formats(spark, d):
    """Batches of all shapes, some broken, unknown, leaking or of another format."""
    no = F.col("metadata")["no"].cast("bigint")
    text = F.col("data").cast("string")
    return inputs.batches(spark, d, "mixed").withColumns(
        {
            "data": F.encode(
                F.when(no % 13 == 5, F.lit('{"foo":[]}'))
                .when(no % 13 == 6, F.lit('{"timeseries":[{"labels":{"__name__":"p","email":"x"},'
                                          '"samples":[{"timestamp":1,"value":2}]}]}'))
                .when(no % 13 == 7, F.lit('{"timeseries":[{"labels":{"__name__":"error"},'
                                          '"samples":[{"timestamp":1,"value":200}]}]}'))
                .otherwise(text),
                "UTF-8",
            ),
            "format": F.when(no % 13 == 8, F.lit("carbon")).when(
                no % 13 == 7, F.lit("prometheus")
            ).when(no % 13 == 9, F.lit("prometheus")).otherwise(F.col("format")),
            "replay": F.when(no % 4 != 1, F.col("replay")),
        }
    )


_JUDGED = f"""{inputs.POINTS}, {inputs.BATCHES}, judged AS (
  SELECT *, CASE WHEN no % 13 IN (5, 8, 9) OR (broken AND no % 13 NOT IN (6, 7)) THEN 'ERR_INVALID_INPUT'
                 WHEN no % 13 = 6 THEN 'ERR_PII_LEAK' END AS code FROM batches)"""


@query(
    "chain_outcomes",
    f"""WITH {_JUDGED}
    SELECT batch_id, CASE WHEN code IS NULL THEN 1 ELSE 2 END AS status, code AS error_code,
           coalesce(code = 'ERR_PII_LEAK', FALSE) AS sent_to_dlq,
           CASE WHEN code = 'ERR_PII_LEAK' THEN 'chain' END AS fb_sender,
           (SELECT count(*) FROM judged) AS received,
           (SELECT count(*) FROM judged WHERE code IS NULL) AS forwarded,
           (SELECT count(*) FROM judged WHERE code IS NOT NULL) AS rejected
    FROM judged""",
)
def chain_outcomes(spark, d):
    """Every batch of mixed formats is accounted for, with its dead letter and the counts."""
    result = run_chain(_mixed_formats(spark, d), CONFIGURED, _now())
    dead = result.dead_letters.select("batch_id", "fb_sender")
    counts = result.health.select("stage", "received", "forwarded", "rejected")
    outcomes = result.outcomes.drop("error_message").withColumn("stage", F.lit("chain"))
    return outcomes.join(dead, "batch_id", "left").join(counts, "stage").drop("stage")


@query(
    "chain_configured",
    f"""WITH {_JUDGED}, through AS (
      SELECT p.id, p.name, p.value FROM points p JOIN judged j ON p.batch_no = j.no
      WHERE j.code IS NULL AND j.no % 13 <> 7
      UNION ALL SELECT NULL, 'error', 200 FROM judged WHERE no % 13 = 7 AND code IS NULL),
    kept AS (SELECT * FROM through WHERE value > 100),
    routed AS (SELECT 'all' AS target, * FROM kept
               UNION ALL SELECT 'errors', * FROM kept WHERE name = 'error'),
    sent AS (SELECT 'packed' AS endpoint, * FROM routed
             UNION ALL SELECT 'errors', * FROM routed WHERE target = 'errors')
    SELECT endpoint, target, count(*) AS points, max(value) AS largest,
           sum(value::VARCHAR::DECIMAL(38,6))::VARCHAR::DOUBLE AS total
    FROM sent GROUP BY endpoint, target""",
)
def chain_configured(spark, d):
    """Classified, filtered, sampled, routed, packed, validated and exported by configuration."""
    result = run_chain(_mixed_formats(spark, d), CONFIGURED, _now())
    path = scratch_path(spark, "chain-export")
    result.export(path, 0)
    schema = "batch_id string, data binary, metadata map<string,string>"
    sent = exported(spark, path, "parquet", schema).unionByName(exported(spark, path, "json", schema))
    point = F.explode(F.from_json(F.col("data").cast("string"), "array<struct<target:string,value:double>>"))
    return (
        sent.select("endpoint", point.alias("p"))
        .groupBy("endpoint", F.col("p.target").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.max("p.value").alias("largest"),
            F.sum(F.col("p.value").cast("decimal(28,6)")).cast("double").alias("total"),
        )
    )


def _sparse(spark, d):
    """Batches whose points lack ids (every third) or times (every fifth), with null replay."""
    points = F.from_json(F.col("data").cast("string"), f"array<{POINT_JSON}>")
    thin = F.transform(
        points,
        lambda p: F.struct(
            F.when(p["id"] % 3 != 0, p["id"]).alias("id"),
            F.when(p["id"] % 5 != 0, p["ts"]).alias("ts"),
            p["name"].alias("name"), p["value"].alias("value"), p["labels"].alias("labels"),
        ),
    )
    no = F.col("metadata")["no"].cast("bigint")
    return inputs.batches(spark, d, broken=False).withColumns(
        {
            "data": F.encode(F.to_json(thin), "UTF-8"),
            "replay": F.when(no % 2 == 0, F.lit(False)),
            "received": F.timestamp_micros(F.lit(1_700_000_000_000_000) + no * 1_000_000),
        }
    )


_SPARSE = f"""{inputs.POINTS}, thin AS (
  SELECT u AS k1, name AS k2, k, value, id,
         CASE WHEN id % 5 = 0 THEN 1700000000000000 + batch_no * 1000000 ELSE us END AS us
  FROM points)"""


@query(
    "sparse_dedup",
    f"""WITH RECURSIVE {_SPARSE}, {inputs.ttl_chain("thin", 48 * HOUR_US)},
    paths(path) AS (VALUES ('scan'), ('joins'))
    SELECT path, k1 AS u, k2 AS name, us FROM kept, paths""",
)
def sparse_dedup(spark, d):
    """Points without id or time keep the same times on both paths of the deduplication."""
    points = explode_points(_sparse(spark, d))
    out = None
    for path, heavy in (("scan", None), ("joins", 20)):
        kept = dedup_ttl(points, ["labels.user", "name"], "48h", heavy_rows=heavy).select(
            F.lit(path).alias("path"), F.col("labels")["user"].alias("u"), "name", micros("ts").alias("us")
        )
        out = kept if out is None else out.unionByName(kept)
    return out


@query(
    "sparse_chain",
    f"""WITH RECURSIVE {_SPARSE}, {inputs.ttl_chain("thin", 48 * HOUR_US)}
    SELECT k2 AS name, us // {DAY_US} * {DAY_US} AS window_us, count(*) AS points
    FROM kept GROUP BY 1, 2""",
)
def sparse_chain(spark, d):
    """Points without id, time or a replay mark go through the chain and into batches."""
    config = ChainConfig(
        dedup=DedupConfig(["labels.user", "name"], "48h"),
        sampling=[SampleRule("k=8", 1.0)],
        pack=PackConfig("name", 10),
    )
    data = run_chain(_sparse(spark, d), config, _now()).output.select(
        F.explode(F.from_json(F.col("data").cast("string"), "array<struct<name:string,ts:timestamp>>")).alias("p")
    )
    day = F.expr(f"unix_micros(p.ts) div {DAY_US} * {DAY_US}")
    return data.groupBy(F.col("p.name").alias("name"), day.alias("window_us")).agg(
        F.count(F.lit(1)).alias("points")
    )


# --- export ----------------------------------------------------------------------

ENDPOINTS = [
    Endpoint("archive"),
    Endpoint("large", filter="value > 50"),
    Endpoint("alerts", "json", "name = 'error'"),
]
EXPORTED_SQL = f"""WITH {inputs.POINTS}, routed AS (
  SELECT 'archive' AS endpoint, id, value FROM points
  UNION ALL SELECT 'large', id, value FROM points WHERE value > 50
  UNION ALL SELECT 'alerts', id, value FROM points WHERE name = 'error')
SELECT endpoint, count(*) AS rows, sum(id)::BIGINT AS id_sum, max(value) AS largest
FROM routed GROUP BY endpoint"""
_SCHEMA = "id bigint, name string, value double"


def _read_back(spark, path):
    out = exported(spark, path, "parquet", _SCHEMA).unionByName(
        exported(spark, path, "json", _SCHEMA)
    )
    return out.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("id").alias("id_sum"),
        F.max("value").alias("largest"),
    )


@query("export_fanout", EXPORTED_SQL)
def export_fanout(spark, d):
    path = scratch_path(spark, "export")
    export(inputs.points(spark, d).select("id", "name", "value"), ENDPOINTS, path, 0)
    return _read_back(spark, path)


@query("export_stream", EXPORTED_SQL)
def export_stream_query(spark, d):
    schema = inputs.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).options(pathGlobFilter="events.parquet", maxFilesPerTrigger=1)
    rows = inputs.as_points(events.parquet(d)).select("id", "name", "value")
    path = scratch_path(spark, "export")
    export_stream(rows, ENDPOINTS, f"{path}/out", f"{path}/state")
    return _read_back(spark, f"{path}/out")


@query(
    "pack_batches",
    f"""WITH {inputs.POINTS}, sized AS (
      SELECT *, ceil(count(*) OVER (PARTITION BY name) / 500.0::DOUBLE) AS buckets FROM points),
    spread AS (SELECT *, floor({fraction("id", "pack")} * buckets)::INTEGER AS bucket FROM sized),
    cut AS (SELECT *, (row_number() OVER (PARTITION BY name, bucket ORDER BY id) - 1) // 100 AS chunk
            FROM spread)
    SELECT concat_ws('-', name, bucket, chunk) AS batch_id, name AS destination,
           count(*)::VARCHAR AS points, count(*)::INTEGER AS payload_points,
           min(id) AS first_id, max(id) AS last_id
    FROM cut GROUP BY name, bucket, chunk""",
)
def pack_batches_query(spark, d):
    packed = pack_batches(
        inputs.points(spark, d), "name", "id", ["id", "name", "value", "labels"],
        max_batch_size=100, bucket_rows=500,
    )
    points = F.from_json(F.col("data").cast("string"), "array<struct<id:bigint>>")
    return packed.withColumn("p", points).select(
        "batch_id",
        F.col("metadata")["destination"].alias("destination"),
        F.col("metadata")["points"].alias("points"),
        F.size("p").alias("payload_points"),
        F.get("p", 0)["id"].alias("first_id"),
        F.element_at("p", -1)["id"].alias("last_id"),
    )
