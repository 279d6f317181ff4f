"""Derived requests written as nested JSON documents, and what flattening them must give back."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import request_rows
from usagelens.contract import REQUEST_FIELDS
from usagelens.sources.flatten import flatten

AT = datetime.datetime(2026, 1, 2, 3, 4, 5)
DETAIL = "cached_tokens"
# Columns that the documents leave out, or that have no counterpart in the derived requests.
DERIVED_SQL = {
    "source_path": "'logs/' || request_id || '.json'",
    "source_file": "request_id || '.json'",
    "source_file_original": "request_id || '.raw'",
    "weekday_local": "cast(isodow(ts_local) - 1 as bigint)",
    "ts_created_utc": "ts_utc + interval 20 second",
    "ts_created_local": "ts_local + interval 20 second",
    "log_lag_ms": "cast(-20000 as bigint)",
    "assistant_response_len": "prompt_len % 11",
    "temperature": "cast(case when k % 4 = 0 then 0 when k % 4 = 1 then 0.3 end as double)",
    "finish_reasons": "case when status_code < 400 then 'stop' else '' end",
    "error_type": "case when status_code >= 400 and k % 2 = 0 then 'invalid_request_error' end",
    "pipeline_version": "'0.5.0'",
    "ingested_at": f"timestamp '{AT}'",
}
VIEW_COLUMNS = set(
    "request_id ts_utc ts_local date_local hour_local username user_account endpoint status_code stream latency_ms provider "
    "model_returned model_family response_model user_agent client_type thread_id turn_id parent_thread_id prompt_tokens "
    "completion_tokens total_tokens cached_tokens usage_missing tool_count tool_types reasoning_effort text_format_name "
    "error_code error_param prompt_len message_count user_message_count assistant_message_count".split()
)
_SQL_TYPES = {"string": "varchar", "long": "bigint", "boolean": "boolean", "double": "double", "instant": "timestamp", "wall_clock": "timestamp"}


def view_columns() -> str:
    """Select list of the 89 columns over the request view, in SQL."""
    columns = []
    for f in REQUEST_FIELDS:
        text = DERIVED_SQL.get(f.name, f.name if f.name in VIEW_COLUMNS else "null")
        columns.append(f"cast({text} as {_SQL_TYPES[f.type]}) {f.name}")
    return ", ".join(columns)


def _values() -> dict[str, Column]:
    """Raw value of each column as the log writes it."""
    c = F.col
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Taipei"), c("ts_utc").cast("timestamp_ntz"))
    values = {name: c(name) for name in VIEW_COLUMNS if name not in ("ts_local", "date_local", "hour_local", "client_type", "model_family", "usage_missing")}
    values.update(
        ts_utc=F.when(c("event_id") % 2 == 0, F.concat(F.date_format("ts_utc", iso), F.lit("Z"))).otherwise(
            F.concat(F.date_format(local, iso), F.lit("+08:00"))
        ),
        ts_created_utc=F.concat(F.date_format(c("ts_utc") + F.expr("interval 20 second"), iso), F.lit("Z")),
        source_file_original=F.concat("request_id", F.lit(".raw")),
        # Direct calls send an empty thread id.
        thread_id=F.coalesce("thread_id", F.lit("")),
        prompt_len=F.repeat(F.lit("é"), c("prompt_len").cast("int")),
        assistant_response_len=F.repeat(F.lit("a"), (c("prompt_len") % 11).cast("int")),
        tool_types=F.when(c("tool_types") == "", F.array().cast("array<string>")).otherwise(F.split("tool_types", ",")),
        finish_reasons=F.when(c("status_code") < 400, F.array(F.lit("stop"))).otherwise(F.array().cast("array<string>")),
        temperature=F.when(c("k") % 4 == 0, 0.0).when(c("k") % 4 == 1, 0.3),
        error_type=F.when((c("status_code") >= 400) & (c("k") % 2 == 0), F.lit("invalid_request_error")),
    )
    return values


def _nest(leaves: dict[str, Column], at: str = "") -> Column:
    """One struct from dotted paths."""
    heads: dict[str, dict[str, Column]] = {}
    for path, value in leaves.items():
        head, _, rest = path.partition(".")
        heads.setdefault(head, {})[rest] = value
    return F.struct(
        *[
            (below[""] if "" in below else _nest(below, head)).alias(head)
            for head, below in heads.items()
        ]
    )


def as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_path, v): requests as JSON; token details are flat or nested in turn, or {}."""
    rows = request_rows(spark, sf_dir)
    values = _values()
    leaves = {f.sources[0]: values[f.name] for f in REQUEST_FIELDS if f.sources and f.name in values and f.name != DETAIL}
    flat, nested = next(f.sources for f in REQUEST_FIELDS if f.name == DETAIL)
    leaves[flat] = F.when(F.col("event_id") % 2 == 0, F.col(DETAIL))
    leaves[nested] = F.when(F.col("event_id") % 2 == 1, F.col(DETAIL))
    document = F.to_json(_nest(leaves))
    # to_json writes an all-null struct as {}, which for the inner one would be a detail of its own.
    cleaned = F.replace(
        F.replace(document, F.lit('"input_tokens_details":{}'), F.lit("")), F.lit(",}"), F.lit("}")
    )
    return rows.select(
        F.concat(F.lit("logs/"), F.col("request_id"), F.lit(".json")).alias("source_path"),
        cleaned.alias("text"),
        F.try_parse_json(cleaned).alias("v"),
    )


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(as_documents(spark, sf_dir), F.lit(AT))
