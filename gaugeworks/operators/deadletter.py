"""The dead-letter table: write into it, select from it, replay it, clean it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros, parse_duration
from gaugeworks.functions.values import put_labels
from gaugeworks.model import (
    DEAD_LETTER,
    ERR_CIRCUIT_BREAKER_OPEN,
    ERR_DLQ_SEND_FAILED,
    ERR_FORWARDING_FAILED,
    STATUS_ERROR,
    STATUS_SUCCESS,
    STATUS_THROTTLED,
    ERR_THROTTLED,
)
from gaugeworks.session import written
from gaugeworks.sources.ledger import Conflict, Ledger, Snapshot

_NO_LABELS = "map<string,string>"

#: The ledger's table of dead letters, and how often a rewrite that others disturb is begun.
TABLE = "dead_letters"
ATTEMPTS = 5

#: Versions whose letters can still be read.
KEEP_VERSIONS = 8


def to_dlq(
    batches: DataFrame,
    sender: str | Column,
    code: str | Column,
    error: str | Column,
    now: Column | None = None,
) -> DataFrame:
    """Dead-letter rows: labels copied and annotated, the same facts as columns."""

    def value(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    now = F.current_timestamp() if now is None else now
    seconds = F.floor(micros(now) / 1_000_000).cast("bigint").cast("string")
    return batches.select(
        "batch_id",
        "data",
        "format",
        now.alias("timestamp"),
        value(code).alias("error_code"),
        value(error).alias("error_message"),
        value(sender).alias("fb_sender"),
        put_labels(
            F.col("internal_labels"),
            {
                "error": value(error),
                "error_code": value(code),
                "fb_sender": value(sender),
                "dlq_timestamp": seconds,
            },
        ).alias("internal_labels"),
        F.coalesce("metadata", F.create_map().cast(_NO_LABELS)).alias("metadata"),
    )


def put_letters(ledger: Ledger, dlq: DataFrame) -> dict[str, str]:
    """Write letters; slots `day/write` and their folders, one per day, that no version names yet."""
    dated = dlq.withColumn("day", F.to_date("timestamp"))
    folder = ledger.write(dated, TABLE, ["day"])
    # As many as there are folders.
    found = ledger.spark.read.schema(f"{DEAD_LETTER}, day date").parquet(f"{ledger.path}/{folder}")
    days = found.select(F.col("day").cast("string")).distinct()
    write = folder.rsplit("=", 1)[-1]
    return {f"{d}/{write}": f"{folder}/day={d or '__HIVE_DEFAULT_PARTITION__'}" for (d,) in days.collect()}


def write_dlq(dlq: DataFrame, path: str) -> None:
    """Append to the table at `path`, one folder per day, so replay and retention read only their days."""
    ledger = Ledger(dlq.sparkSession, path)
    put = put_letters(ledger, dlq)
    if put:
        ledger.commit(ledger.snapshot(), {TABLE: put})


def read_dlq(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> DataFrame:
    """The letters at `path`, as of now or of a snapshot of its ledger."""
    ledger = Ledger(spark, path)
    return _letters(ledger, (snapshot or ledger.snapshot()).of(TABLE).values())


def _letters(ledger: Ledger, folders: Iterable[str]) -> DataFrame:
    schema = f"{DEAD_LETTER}, day date"
    paths = [f"{ledger.path}/{f}" for f in folders]
    if not paths:
        return ledger.spark.createDataFrame([], schema)
    reader = ledger.spark.read.schema(schema).option("basePath", f"{ledger.path}/{TABLE}")
    columns = [c.split()[0] for c in schema.split(", ")]
    return reader.parquet(*paths).select(*columns)


def read_dlq_json(spark: SparkSession, path: str) -> DataFrame:
    """Dead letters as JSON lines (`data` in base64); `unreadable` marks lines that are
    not one, which are counted as errors and never replayed.
    """
    letter = F.from_json(
        "value", f"{DEAD_LETTER}, undecoded string", {"columnNameOfCorruptRecord": "undecoded"}
    )
    return (
        spark.read.text(path)
        .select(letter.alias("letter"))
        .select("letter.*")
        .withColumn("unreadable", F.col("undecoded").isNotNull())
        .drop("undecoded")
    )


def outcome(
    batches: DataFrame,
    processing_code: Column,
    processing_error: Column,
    dlq_on_error: Column,
    forward: Column,
    dlq_ok: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One result row per batch, with the batch columns named in `carry`.

    `processing_code` is the stage's own error (null when it did its work),
    `dlq_on_error` says whether that error goes to the dead letters, `forward` is "ok",
    "open", "throttled" or "failed", `dlq_ok` whether the dead-letter write worked.
    """
    failed = processing_code.isNotNull()
    open_circuit = ~failed & (forward == "open")
    throttled = ~failed & (forward == "throttled")
    not_forwarded = ~failed & (forward == "failed")
    to_dead_letters = (failed & dlq_on_error) | not_forwarded
    code = (
        F.when(to_dead_letters & ~dlq_ok, F.lit(ERR_DLQ_SEND_FAILED))
        .when(failed, processing_code)
        .when(open_circuit, F.lit(ERR_CIRCUIT_BREAKER_OPEN))
        .when(throttled, F.lit(ERR_THROTTLED))
        .when(not_forwarded, F.lit(ERR_FORWARDING_FAILED))
    )
    message = (
        F.when(to_dead_letters & ~dlq_ok, F.lit("failed to send to DLQ"))
        .when(failed, processing_error)
        .when(open_circuit, F.lit("circuit breaker is open"))
        .when(not_forwarded, F.lit("forwarding failed"))
    )
    status = (
        F.when(throttled, F.lit(STATUS_THROTTLED))
        .when(code.isNotNull(), F.lit(STATUS_ERROR))
        .otherwise(F.lit(STATUS_SUCCESS))
    )
    return batches.select(
        "batch_id",
        status.alias("status"),
        F.when(~throttled, code).alias("error_code"),
        message.alias("error_message"),
        (to_dead_letters & dlq_ok).alias("sent_to_dlq"),
        *carry,
    )


def _ago(now: Column, duration: str | None) -> Column | None:
    if duration is None or duration == "":
        return None
    return F.timestamp_micros(micros(now) - F.lit(parse_duration(duration)))


def matches(
    now: Column,
    since: str | None = None,
    until: str | None = None,
    error_code: str | None = None,
    sender: str | None = None,
) -> Column:
    """Bounds are durations before `now`, both inclusive; an empty filter takes all."""
    keep = F.lit(True)
    first, last = _ago(now, since), _ago(now, until)
    if first is not None:
        keep = keep & (F.col("timestamp") >= first)
    if last is not None:
        keep = keep & (F.col("timestamp") <= last)
    if error_code:
        keep = keep & F.coalesce(F.col("error_code") == error_code, F.lit(False))
    if sender:
        keep = keep & F.coalesce(F.col("fb_sender") == sender, F.lit(False))
    return keep


def replay_select(
    dlq: DataFrame,
    now: Column,
    since: str | None = None,
    until: str | None = None,
    error_code: str | None = None,
    sender: str | None = None,
) -> DataFrame:
    """Rows to replay; a `day` partition column is pruned along with the bounds."""
    out = dlq.filter(matches(now, since, until, error_code, sender))
    if "day" in dlq.columns:
        first, last = _ago(now, since), _ago(now, until)
        if first is not None:
            out = out.filter(F.col("day") >= F.to_date(first))
        if last is not None:
            out = out.filter(F.col("day") <= F.to_date(last))
    return out


def replay_stamp(selected: DataFrame, now: Column) -> DataFrame:
    """Dead-letter rows as batches again: marked as replay, under the current rules."""
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return selected.select(
        "batch_id",
        "data",
        "format",
        F.lit(True).alias("replay"),
        F.lit(0).cast("bigint").alias("config_generation"),
        "metadata",
        put_labels(
            F.col("internal_labels"), {"replay": F.lit("true"), "replay_timestamp": stamp}
        ).alias("internal_labels"),
    )


def replay_attempts(
    dlq: DataFrame,
    selected: Column,
    unreadable: Column,
    result_code: Column,
) -> DataFrame:
    """Adds `attempt`: "unmarshal-error", "filtered", "replayed", or the error's code.

    `result_code` is null when the batch was taken in (always, on a dry run) and
    "grpc-error" when it could not be handed over.
    """
    return dlq.withColumn(
        "attempt",
        F.when(unreadable, F.lit("unmarshal-error"))
        .when(~selected, F.lit("filtered"))
        .when(result_code.isNull(), F.lit("replayed"))
        .otherwise(result_code),
    )


def replay_stats(attempts: DataFrame) -> DataFrame:
    """Counts: total, filtered, replayed, errors, and one row per error reason."""
    per = attempts.groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    done = F.col("attempt").isin("filtered", "replayed")
    # One row per reason code at most, so the sums below are of a handful of rows.
    totals = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("attempt") == "filtered", F.col("n"))), F.lit(0)).alias("filtered"),
        F.coalesce(F.sum(F.when(F.col("attempt") == "replayed", F.col("n"))), F.lit(0)).alias("replayed"),
        F.coalesce(F.sum(F.when(~done, F.col("n"))), F.lit(0)).alias("errors"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(s).cast("bigint").alias("count"))
                    for s in ("total", "filtered", "replayed", "errors")
                ]
            )
        )
    )
    reasons = per.filter(~done).select(
        F.concat(F.lit("error:"), "attempt").alias("stat"), F.col("n").alias("count")
    )
    return totals.unionByName(reasons)


#: What tells one letter from another.
LETTER_KEY = ("batch_id", "timestamp", "fb_sender", "error_code")


def delete_replayed(
    dlq: DataFrame, replayed: DataFrame, key: Sequence[str] = LETTER_KEY
) -> DataFrame:
    """The table without rows that were replayed with success; null equals null in a key."""
    gone = replayed.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dlq.join(gone, same, "left_anti")


def _rewrite(
    spark: SparkSession, path: str, concerns: Callable[[str], bool], left: Callable[[DataFrame], DataFrame]
) -> None:
    """Replace the folders of some days with what is `left` of their rows.

    Letters appended meanwhile are in other folders and stay. Where somebody else has rewritten the
    same folder, this starts anew on what is there now.
    """
    ledger = Ledger(spark, path)
    for attempt in range(ATTEMPTS):
        base = ledger.snapshot()
        old = {s: f for s, f in base.of(TABLE).items() if concerns(s.split("/")[0])}
        if not old:
            return
        put = put_letters(ledger, left(_letters(ledger, old.values())).drop("day"))
        try:
            ledger.commit(base, {TABLE: put}, {TABLE: old})
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        ledger.vacuum(KEEP_VERSIONS)
        return


def delete_replayed_at(
    spark: SparkSession, path: str, replayed: DataFrame, key: Sequence[str] = LETTER_KEY
) -> None:
    """Delete replayed letters from the table at `path`; only their days are read and replaced."""
    gone = written(replayed.select(*key, F.to_date("timestamp").alias("day")), "replayed")
    days = {str(row.day) for row in gone.select("day").distinct().collect()}
    _rewrite(spark, path, days.__contains__, lambda letters: delete_replayed(letters, gone, key))


def retain_at(spark: SparkSession, path: str, hours: float, now: Column) -> None:
    """Delete letters more than `hours` old from the table at `path`: the days before, and of
    the day in which the bound falls the part before it. Letters without a time go, as in `retain`."""
    first = F.to_date(F.timestamp_micros(micros(now) - F.lit(int(hours * 3_600_000_000))))
    cut = str(spark.range(1).select(first).first()[0])
    _rewrite(
        spark, path, lambda day: day == "None" or day <= cut, lambda letters: retain(letters, hours, now)
    )


def retain(dlq: DataFrame, hours: float, now: Column) -> DataFrame:
    """Rows at most `hours` old; whole days before that are never read."""
    cut = F.timestamp_micros(micros(now) - F.lit(int(hours * 3_600_000_000)))
    out = dlq.filter(F.col("timestamp") >= cut)
    if "day" in dlq.columns:
        out = out.filter(F.col("day") >= F.to_date(cut))
    return out


def replay_into(
    batches: DataFrame, replayed: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Replayed batches enter at the first stage along with new ones."""
    out = batches.unionByName(replayed)
    for stage in stages:
        out = out.transform(stage)
    return out
