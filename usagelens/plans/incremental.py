"""Level tables that follow the request table: a batch re-aggregates only the turns, threads and users that it touches.

Requests are kept as partial aggregates by date, beside the levels made of them. The request table's snapshots tell which
dates changed; their partials are built anew, and keys whose partials differ are merged again from all their dates. Partials
and levels change in one commit.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens import settings
from usagelens.contract import PARTITION_COLUMN, REQUEST_SCHEMA
from usagelens.functions.aggregates import join_sorted, sum0
from usagelens.functions.scalars import safe_ratio, tool_messages
from usagelens.functions.times import duration_ms
from usagelens.operators.heavy import PIECE, staged
from usagelens.operators.ordered import pieces
from usagelens.plans.identity import PERSON_COLUMNS
from usagelens.plans.levels import _COUNTERS, _TOKENS, errors, merge_turns, turn_parts
from usagelens.sources import snapshots as S
from usagelens.sources import tables

#: The date that a part, or a level's first request, belongs to.
DAY = "day"
#: Of requests without a time.
_NO_DAY = "none"


def _day() -> Column:
    return F.coalesce(PARTITION_COLUMN, F.lit(_NO_DAY))


def _parts_of_turns(requests: DataFrame, min_rows: int | None) -> DataFrame:
    """Pieces never cross midnight, and are named so that they sort by date (none comes first), then by place in the date."""
    rows, _ = pieces(requests.where(F.col("turn_id").isNotNull()), "turn_id", "ts_utc", min_rows)
    name = F.concat_ws("/", F.coalesce(PARTITION_COLUMN, F.lit("")), F.lpad(F.col(PIECE).cast("string"), 9, "0"))
    parts = turn_parts(rows.withColumn(PIECE, name).withColumn(DAY, _day()), DAY)
    return parts.withColumn("_families", F.array_sort("_families"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _TOKENS]


_SETS = ("model_family", "endpoint", "tool_types", "error_code")


def _parts_of_threads(requests: DataFrame, min_rows: int | None) -> DataFrame:
    """One row per (thread, turn, date), so that distinct turns can be counted and a heavy thread spreads over its turns."""
    at = F.struct("ts_utc", "request_id")
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c) for c in ("username", "client_type")]
    return (
        requests.where(F.col("thread_id").isNotNull())
        .groupBy("thread_id", "turn_id", _day().alias(DAY))
        .agg(
            *firsts,
            F.max("parent_thread_id").alias("parent_thread_id"),
            F.min("ts_local").alias("ts_first"), F.max("ts_local").alias("ts_last"),
            F.min("ts_utc").alias("_from"), F.max("ts_utc").alias("_to"),
            F.count("*").alias("n_requests"),
            *_sums(),
            *[F.max(c).alias(c) for c in _COUNTERS],
            *[F.array_sort(F.collect_set(c)).alias(c) for c in _SETS],
            errors().alias("n_errors"),
        )
    )


def _merge_threads(parts: DataFrame) -> DataFrame:
    peaks = [F.col(f"{c}_peak") for c in _COUNTERS]

    def union(c: str) -> Column:
        return F.flatten(F.collect_list(c))

    tools = F.flatten(F.transform(union("tool_types"), lambda v: F.split(v, ",")))
    threads = parts.groupBy("thread_id").agg(
        *[F.min(c)["value"].alias(c) for c in ("username", "client_type")],
        F.max("parent_thread_id").alias("parent_thread_id"),
        F.min("ts_first").alias("ts_first"),
        F.max("ts_last").alias("ts_last"),
        duration_ms(F.min("_from"), F.max("_to")).alias("duration_ms"),
        F.count_distinct("turn_id").alias("n_turns"),
        F.sum("n_requests").alias("n_requests"),
        *[sum0(F.col(c)).alias(f"{c}_sum") for c in _TOKENS],
        *[F.max(c).alias(f"{c}_peak") for c in _COUNTERS],
        join_sorted(union("model_family")).alias("model_family_set"),
        join_sorted(union("endpoint")).alias("endpoint_set"),
        join_sorted(F.filter(tools, lambda part: part != "")).alias("tool_types_union"),
        F.sum("n_errors").alias("n_errors"),
        join_sorted(F.transform(union("error_code"), lambda v: v.cast("string"))).alias("error_codes"),
    )
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


def _parts_of_users(requests: DataFrame, min_rows: int | None) -> DataFrame:
    """One row per (user, thread, turn, client type, endpoint, date): distinct threads, turns and days remain countable."""
    rows = requests.where(F.col("username").isNotNull())
    return rows.groupBy("username", "thread_id", "turn_id", "client_type", "endpoint", _day().alias(DAY)).agg(
        F.max(PARTITION_COLUMN).alias("date"),
        F.count("*").alias("n_requests"),
        F.min("ts_local").alias("ts_first"),
        F.max("ts_local").alias("ts_last"),
        *_sums(),
        errors().alias("n_errors"),
    )


def _merge_users(parts: DataFrame) -> DataFrame:
    """Users without what the registry knows about them, which is joined when they are read."""
    totals = parts.groupBy("username", "date", "client_type", "endpoint").agg(
        F.sum("n_requests").alias("n_requests"), F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"),
        *_sums(), F.sum("n_errors").alias("n_errors"),
    )
    totals = totals.groupBy("username").agg(
        F.sum("n_requests").alias("n_requests"),
        F.count_distinct("date").alias("n_active_days"),
        F.min("ts_first").alias("ts_first"),
        F.max("ts_last").alias("ts_last"),
        *[sum0(F.col(c)).alias(f"{c}_sum") for c in _TOKENS],
        join_sorted(F.collect_set("client_type")).alias("client_types"),
        join_sorted(F.collect_set("endpoint")).alias("endpoints"),
        F.sum("n_errors").alias("n_errors"),
    )
    distinct = parts.groupBy("username").agg(F.count_distinct("thread_id").alias("n_threads"), F.count_distinct("turn_id").alias("n_turns"))
    return totals.join(distinct, "username")


class _Level(NamedTuple):
    key: str
    parts: Callable[[DataFrame, int | None], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


LEVELS = {
    "turn": _Level("turn_id", _parts_of_turns, merge_turns),
    "thread": _Level("thread_id", _parts_of_threads, _merge_threads),
    "user": _Level("username", _parts_of_users, _merge_users),
}


def _schema(df: DataFrame) -> T.StructType:
    """Columns as Parquet gives them back: all may be null."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def _folders(state: S.Snapshot, table: str) -> list[str]:
    return [f.split("/", 1)[1] for f in state.folders if f.startswith(f"{table}/")]


def _days_of(folders: set[str], column: str) -> list[str]:
    return sorted({S.partition_value(f) or _NO_DAY for f in folders if f.startswith(f"{column}=")})


def _empty(spark: SparkSession, level: _Level) -> DataFrame:
    return level.merge(level.parts(spark.createDataFrame([], REQUEST_SCHEMA), None))


def update_levels(spark: SparkSession, requests_dir: str, home: str, min_rows: int | None = settings.HEAVY_ROWS) -> dict[str, int]:
    """Bring the level tables in ``home`` up to the request table's newest snapshot; returns how many keys of each changed.

    Reads the requests of dates whose folders changed since the last update, added, rewritten or gone, and the partials of
    the keys that these touch. A stop before the last step leaves the old levels; without a change nothing is done.
    """
    base, now = S.current(spark, home), tables.prepare_requests(spark, requests_dir)
    changed = set(base.notes) ^ set(now.folders)
    if not changed:
        return dict.fromkeys(LEVELS, 0)
    days = _days_of(changed, PARTITION_COLUMN)
    # Partition values prune the scan: requests of other dates are not opened.
    wanted = F.col(PARTITION_COLUMN).isin(days)
    wanted = wanted | F.col(PARTITION_COLUMN).isNull() if _NO_DAY in days else wanted
    requests = tables.requests_at(spark, requests_dir, now.version).where(wanted)
    drop, add, touched = [], [], {}
    for name, level in LEVELS.items():
        parts, place = f"{name}_parts", f"{home}/{name}_parts"
        fresh = level.parts(requests, min_rows)
        schema = _schema(fresh)
        fresh = staged(fresh, parts)
        old_folders = [f for f in _folders(base, parts) if S.partition_value(f) in days]
        old = S.read_folders(spark, place, old_folders, schema, DAY).select(*schema.names)
        # Keys of parts that are not the same before and after, in the dates that changed.
        key = F.col(level.key)
        differ = fresh.exceptAll(old).select(key).union(old.exceptAll(fresh).select(key)).distinct()
        keys = staged(differ, f"{name}_keys")
        touched[name] = keys.count()
        if not touched[name]:
            continue
        added = S.write_commit(fresh, place, DAY)
        drop += [f"{parts}/{f}" for f in old_folders]
        add += [f"{parts}/{f}" for f in added]
        live = [f for f in _folders(base, parts) if f not in set(old_folders)] + added
        merged = level.merge(S.read_folders(spark, place, live, schema, DAY).join(keys, level.key, "left_semi"))
        merged = merged.withColumn(DAY, F.coalesce(F.date_format("ts_first", "yyyy-MM-dd"), F.lit(_NO_DAY)))
        # Only the folders that hold a touched key are written again.
        out, where = _schema(merged), f"{home}/{name}"
        hit = []
        if _folders(base, name):
            table = S.read_folders(spark, where, _folders(base, name), out, DAY).select(level.key, "_metadata")
            hit = [r["folder"] for r in S.folders_of(table.join(keys, level.key, "left_semi")).collect()]
        rest = S.read_folders(spark, where, hit, out, DAY).select(*out.names).join(keys, level.key, "left_anti")
        add += [f"{name}/{f}" for f in S.write_commit(rest.unionByName(merged), where, DAY)]
        drop += [f"{name}/{f}" for f in hit]
    S.publish(spark, home, base, drop, add, now.folders)
    S.vacuum(spark, home, 1, depth=2)
    return touched


def read_updated(spark: SparkSession, home: str, registry: DataFrame) -> dict[str, DataFrame]:
    """turn, thread and user as ``build_turn``, ``build_thread`` and ``build_user`` give them."""
    state = S.current(spark, home)
    if not state.version:
        raise FileNotFoundError(f"there are no levels at {home}: update them first")
    found = {}
    for name, level in LEVELS.items():
        schema = _schema(_empty(spark, level))
        found[name] = S.read_folders(spark, f"{home}/{name}", _folders(state, name), schema, DAY).select(*schema.names)
    people = registry.select("username", *PERSON_COLUMNS)
    found["user"] = found["user"].join(people, "username", "left").select(
        "username", *PERSON_COLUMNS,
        "n_requests", "n_threads", "n_turns", "n_active_days", "ts_first", "ts_last",
        "prompt_tokens_sum", "completion_tokens_sum", "cached_tokens_sum",
        "client_types", "endpoints", "n_errors",
    )
    return found
