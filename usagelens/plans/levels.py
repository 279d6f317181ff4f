"""Requests rolled up to turns, threads and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.aggregates import (
    any_of,
    first_non_null,
    join_sorted,
    join_unique,
    sum0,
    union_csv,
)
from usagelens.functions.scalars import is_error, safe_ratio, tool_messages
from usagelens.functions.times import duration_ms
from usagelens.operators.concentration import concentration
from usagelens.operators.heavy import PIECE
from usagelens.operators.ordered import drop_flag, pieces, seam_aggregates, seam_flag
from usagelens.plans.identity import PERSON_COLUMNS

_TOKENS = ("prompt_tokens", "completion_tokens", "cached_tokens")
_COUNTERS = ("message_count", "user_message_count", "assistant_message_count")


def errors() -> Column:
    return F.count_if(is_error(F.col("status_code"), settings.ERROR_STATUS_FLOOR))


def build_turn(requests: DataFrame, min_rows: int | None = settings.HEAVY_ROWS) -> DataFrame:
    """One row per turn; requests without a turn are left out.

    Requests meet once per (turn, piece), where the window and the first aggregate share one
    exchange; only piece summaries travel on. A turn of ordinary size is a single piece.
    """
    rows, _ = pieces(requests.where(F.col("turn_id").isNotNull()), "turn_id", "ts_utc", min_rows)
    return merge_turns(turn_parts(rows))


_TURN_FIRSTS = ("thread_id", "username", "client_type", "reasoning_effort", "tool_count", "tool_types")


def turn_parts(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per (turn, piece, ``keep``) of requests with a piece: what can be merged, and the counter at both ends."""
    at = F.struct("ts_utc", "request_id")
    return (
        rows.withColumn("_drop", drop_flag("message_count", "turn_id", "ts_utc", "request_id"))
        .groupBy("turn_id", PIECE, *keep)
        .agg(
            *[first_non_null(F.col(c), at).alias(c) for c in _TURN_FIRSTS],
            F.min("ts_utc").alias("_from"),
            F.max("ts_utc").alias("_to"),
            F.min("ts_local").alias("ts_first"),
            F.max("ts_local").alias("ts_last"),
            F.count("*").alias("n_requests"),
            F.sum("_drop").alias("_drops"),
            *seam_aggregates("message_count", "ts_utc", "request_id"),
            *[F.sum(c).alias(c) for c in _TOKENS],
            F.sum("latency_ms").alias("latency_ms"),
            F.max("latency_ms").alias("latency_ms_max"),
            *[F.max(c).alias(c) for c in _COUNTERS],
            F.collect_set("model_family").alias("_families"),
            errors().alias("n_errors"),
            any_of(F.col("usage_missing")).alias("has_usage_missing"),
        )
    )


def merge_turns(per_piece: DataFrame) -> DataFrame:
    """Turns of ``turn_parts``; pieces follow each other in the order of their names."""
    drops = F.sum(F.col("_drops") + F.col("_seam"))
    turns = (
        per_piece.withColumn("_seam", seam_flag("turn_id"))
        .groupBy("turn_id")
        .agg(
            *[first_non_null(F.col(c), F.col(PIECE)).alias(c) for c in _TURN_FIRSTS],
            F.min("ts_first").alias("ts_first"),
            F.max("ts_last").alias("ts_last"),
            duration_ms(F.min("_from"), F.max("_to")).alias("duration_ms"),
            F.sum("n_requests").alias("n_requests"),
            (drops > 0).alias("has_compaction"),
            (drops + 1).alias("n_segments"),
            *[sum0(F.col(c)).alias(f"{c}_sum") for c in _TOKENS],
            sum0(F.col("latency_ms")).alias("latency_ms_sum"),
            F.max("latency_ms_max").alias("latency_ms_max"),
            *[F.max(c).alias(f"{c}_peak") for c in _COUNTERS],
            # One set per piece, so a few hundred at most.
            join_sorted(F.flatten(F.collect_list("_families"))).alias("model_family_set"),
            F.sum("n_errors").alias("n_errors"),
            F.bool_or("has_usage_missing").alias("has_usage_missing"),
        )
    )
    return turns.select(
        "turn_id", "thread_id", "username", "client_type", "ts_first", "ts_last", "duration_ms",
        "n_requests", "has_compaction", "n_segments",
        "prompt_tokens_sum", "completion_tokens_sum", "cached_tokens_sum",
        "latency_ms_sum", "latency_ms_max",
        "message_count_peak", "user_message_count_peak", "assistant_message_count_peak",
        tool_messages(*[F.col(f"{c}_peak") for c in _COUNTERS]).alias("tool_message_count"),
        "reasoning_effort", "tool_count", "tool_types",
        "model_family_set", "n_errors", "has_usage_missing",
    )


def build_thread(requests: DataFrame) -> DataFrame:
    """One row per thread.

    With its one distinct count Spark aggregates by (thread, turn) first and merges those buffers,
    so a heavy thread spreads over its turns and only distinct set members are ever held.
    """
    at = F.struct("ts_utc", "request_id")
    rows = requests.where(F.col("thread_id").isNotNull())
    threads = rows.groupBy("thread_id").agg(
        *[first_non_null(F.col(c), at).alias(c) for c in ("username", "client_type")],
        F.max("parent_thread_id").alias("parent_thread_id"),
        F.min("ts_local").alias("ts_first"),
        F.max("ts_local").alias("ts_last"),
        duration_ms(F.min("ts_utc"), F.max("ts_utc")).alias("duration_ms"),
        F.count_distinct("turn_id").alias("n_turns"),
        F.count("*").alias("n_requests"),
        *[sum0(F.col(c)).alias(f"{c}_sum") for c in _TOKENS],
        *[F.max(c).alias(f"{c}_peak") for c in _COUNTERS],
        join_unique(F.col("model_family")).alias("model_family_set"),
        join_unique(F.col("endpoint")).alias("endpoint_set"),
        union_csv(F.col("tool_types")).alias("tool_types_union"),
        errors().alias("n_errors"),
        join_unique(F.col("error_code")).alias("error_codes"),
    )
    peaks = [F.col(f"{c}_peak") for c in _COUNTERS]
    return threads.select(
        "thread_id", "username", "client_type", "parent_thread_id",
        "ts_first", "ts_last", "duration_ms", "n_turns", "n_requests",
        safe_ratio(F.col("n_requests"), F.col("n_turns")).alias("expansion_ratio"),
        "prompt_tokens_sum", "completion_tokens_sum", "cached_tokens_sum",
        "message_count_peak", "user_message_count_peak", "assistant_message_count_peak",
        safe_ratio(tool_messages(*peaks), peaks[0]).alias("tool_message_ratio"),
        "model_family_set", "endpoint_set",
        F.col("tool_types_union").isNotNull().alias("has_tool_types"), "tool_types_union",
        "n_errors", "error_codes",
    )


def build_user(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per user name seen, registry attributes attached where there are any.

    Distinct threads, turns and days are counted as the groups of narrower aggregates, so the
    requests of a heavy user spread over those groups.
    """
    rows = requests.where(F.col("username").isNotNull())
    per_day = rows.groupBy("username", "date_local", "client_type", "endpoint").agg(
        F.count("*").alias("n_requests"),
        F.min("ts_local").alias("ts_first"),
        F.max("ts_local").alias("ts_last"),
        *[F.sum(c).alias(c) for c in _TOKENS],
        errors().alias("n_errors"),
    )
    totals = per_day.groupBy("username").agg(
        F.sum("n_requests").alias("n_requests"),
        F.count_distinct("date_local").alias("n_active_days"),
        F.min("ts_first").alias("ts_first"),
        F.max("ts_last").alias("ts_last"),
        *[sum0(F.col(c)).alias(f"{c}_sum") for c in _TOKENS],
        join_unique(F.col("client_type")).alias("client_types"),
        join_unique(F.col("endpoint")).alias("endpoints"),
        F.sum("n_errors").alias("n_errors"),
    )
    distinct = rows.groupBy("username").agg(
        F.count_distinct("thread_id").alias("n_threads"), F.count_distinct("turn_id").alias("n_turns")
    )
    people = registry.select("username", *PERSON_COLUMNS)
    return (
        totals.join(distinct, "username")
        .join(people, "username", "left")
        .select(
            "username", *PERSON_COLUMNS,
            "n_requests", "n_threads", "n_turns", "n_active_days", "ts_first", "ts_last",
            "prompt_tokens_sum", "completion_tokens_sum", "cached_tokens_sum",
            "client_types", "endpoints", "n_errors",
        )
    )


def build_concentration(
    requests: DataFrame, registry: DataFrame, exclude_usage_missing: bool = False
) -> DataFrame:
    """Concentration over the person dimensions and the client type.

    Person attributes hang on the user name, so they are joined to the per-user sums.
    """
    rows = requests
    if exclude_usage_missing:
        rows = rows.where(~F.coalesce("usage_missing", F.lit(False)))
    sums = rows.groupBy("username", "client_type").agg(
        F.count("*").alias("_requests"), F.sum("total_tokens").alias("_tokens")
    )
    people = registry.select("username", *PERSON_COLUMNS)
    joined = sums.join(people, "username", "left")
    return concentration(
        joined, settings.CONCENTRATION_DIMENSIONS, "username", weight="_tokens", requests="_requests"
    )
