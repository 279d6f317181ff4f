"""Slices of traffic that belong almost entirely to one user, described without naming them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.scalars import is_error, percent1, share
from usagelens.operators.counts import top1_share
from usagelens.operators.heavy import staged
from usagelens.operators.rhythm import cadence
from usagelens.plans.metrics.model import MetricResult, Tables

_BY = "anomaly"


def _conditions() -> list[tuple[str, Column]]:
    families, hours = settings.ANOMALY_LEGACY_FAMILIES, settings.ANOMALY_OFFPEAK_HOURS
    code = settings.ANOMALY_ERROR_CODE
    return [
        (f"{code} concentrated", F.col("error_code") == code),
        (f"legacy models ({'/'.join(families)}) concentrated", F.col("model_family").isin(*families)),
        (f"off-peak hours ({hours[0]}-{hours[-1]}) concentrated", F.col("hour_local").isin(*hours)),
    ]


def anomaly_names() -> list[str]:
    return [name for name, _ in _conditions()]


def sliced(requests: DataFrame) -> DataFrame:
    """Every request under each slice it belongs to, with the slice in ``anomaly``."""
    names = [F.when(condition, F.lit(name)) for name, condition in _conditions()]
    return requests.select("*", F.explode(F.array_compact(F.array(*names))).alias(_BY))


def owners(slices: DataFrame) -> DataFrame:
    """(anomaly, n, n_users, top_user, top_n, top_share) where one user has at least 80 %."""
    tops = top1_share(slices, [_BY], "username")
    # One row per slice: three at most.
    return tops.where(F.col("top_share") >= settings.ANOMALY_DOMINANT).limit(len(anomaly_names()))


def _owned(rows: DataFrame, owner: DataFrame, on: list[str]) -> DataFrame:
    keys = owner.select(_BY, F.col("top_user").alias("username"))
    return rows.join(F.broadcast(keys), on)


def anomaly_owners(requests: DataFrame) -> DataFrame:
    """(anomaly, slice_requests, slice_users, n_requests) of the slices that have an owner."""
    return owners(sliced(requests)).select(
        _BY,
        F.col("n").alias("slice_requests"),
        F.col("n_users").alias("slice_users"),
        F.col("top_n").alias("n_requests"),
    )


def flagged_requests(requests: DataFrame) -> DataFrame:
    """Distinct request ids in any owned slice: one user may own several."""
    slices = sliced(requests.select("request_id", "username", "error_code", "model_family", "hour_local"))
    return _owned(slices, owners(slices), [_BY, "username"]).select("request_id").distinct()


def _tops(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per slice, the most frequent value of each column, its count and its share; ties go low."""
    pairs = F.explode(
        F.array(
            *[
                # Padding makes numbers sort as numbers.
                F.struct(F.lit(out).alias("out"), (
                    F.lpad(F.col(c).cast("string"), 20, "0") if c == "prompt_len" else F.col(c)
                ).alias("value"))
                for out, c in columns.items()
            ]
        )
    )
    counts = (
        rows.select(_BY, pairs.alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy(_BY, "p.out", "p.value")
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy(_BY, "out").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"),
        F.max("n").alias("n"),
        F.sum("n").alias("total"),
    )

    def of(out: str, c: str) -> Column:
        return F.max(F.when(F.col("out") == out, F.col(c)))

    return best.groupBy(_BY).agg(
        *[of(out, "value").alias(f"top_{out}") for out in columns],
        *[of(out, "n").alias(f"n_top_{out}") for out in columns],
        *[(of(out, "n").cast("double") / of(out, "total")).alias(f"share_top_{out}") for out in columns],
    )


_USED = (
    "request_id", "username", "error_code", "model_family", "hour_local", "ts_utc", "endpoint", "status_code", "user_agent",
    "date_local", "prompt_len", "client_type",
)


def anomaly_facts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """One row per owned slice with every number its description uses; the owner is left out.

    All slices go through the same aggregates together. ``same_owner_as`` is the place of an
    earlier listed row with the same owner.
    """
    requests = requests.select(*_USED)
    slices = sliced(requests)
    # What owners sent is written once; every part below reads that, not the requests.
    owner = staged(owners(slices), "owners")
    mine = staged(_owned(slices, owner, [_BY, "username"]), "mine")
    whole = staged(_owned(requests, owner, ["username"]), "whole")
    names = anomaly_names()
    failed = is_error(F.col("status_code"), settings.ERROR_STATUS_FLOOR)
    chat = F.col("endpoint") == "/v1/chat/completions"
    offpeak = F.col("hour_local").isin(*settings.ANOMALY_OFFPEAK_HOURS)

    def rate(condition: Column) -> Column:
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))

    about_mine = mine.groupBy(_BY).agg(
        ((F.unix_micros(F.max("ts_utc")) - F.unix_micros(F.min("ts_utc"))) / F.lit(60e6)).alias("window_minutes"),
        rate(chat).alias("chat_share"),
    )
    about_whole = whole.groupBy(_BY).agg(
        F.count("*").alias("owner_requests"),
        rate(failed).alias("owner_error_share"),
        rate(offpeak).alias("owner_offpeak_share"),
        F.count_distinct("user_agent").alias("n_user_agents"),
        F.count_distinct("date_local").alias("n_active_days"),
    )
    top_mine = _tops(mine, {"prompt_len": "prompt_len", "client_type": "client_type", "user_agent": "user_agent"})
    top_whole = _tops(whole, {"endpoint": "endpoint", "model_family": "model_family"})
    # The rhythm of the third slice is that of everything its owner sends.
    timed = mine.where(F.col(_BY) != names[2]).select(_BY, "ts_utc").unionByName(
        whole.where(F.col(_BY) == names[2]).select(_BY, "ts_utc")
    )
    rhythm = cadence(timed, _BY, "ts_utc").select(_BY, "median_gap", "tight_share")
    kinds = _owned(users, owner, ["username"]).select(_BY, "account_type")
    totals = requests.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col("client_type") == "direct").alias("direct"))
    ).scalar()
    rows = owner
    for part in (about_mine, about_whole, top_mine, top_whole, rhythm, kinds):
        rows = rows.join(part, _BY, "left")
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(_BY))
    place = Window.orderBy("_order")
    earliest = F.min("_place").over(Window.partitionBy("top_user"))
    return (
        rows.withColumn("_order", order)
        .withColumn("_place", F.row_number().over(place))
        .withColumn("same_owner_as", F.when(earliest < F.col("_place"), earliest))
        .withColumn("_totals", totals)
        .select(
            "_order", _BY, F.lit(1).cast("bigint").alias("n_users"), F.col("top_n").alias("n_requests"),
            share(F.col("top_n"), F.col("_totals.n")).alias("share"),
            F.col("n").alias("slice_requests"), F.col("n_users").alias("slice_users"), "same_owner_as",
            "median_gap", "tight_share", "window_minutes",
            F.col("top_prompt_len").cast("bigint").alias("top_prompt_len"), "n_top_prompt_len",
            "top_client_type", "chat_share", F.col("share_top_user_agent").alias("top_agent_share"),
            "owner_requests", "owner_error_share", "owner_offpeak_share", "n_user_agents", "n_active_days",
            "top_endpoint", "top_model_family", "account_type",
            F.col("_totals.direct").alias("n_direct"), F.col("_totals.n").alias("n_total"),
        )
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _percent(n: str, total: str) -> Column:
    return percent1(F.col(n).cast("double") / F.col(total).cast("double"))


def _rhythm() -> Column:
    whole = F.floor(F.col("tight_share") * 100 + F.lit(0.5)).cast("bigint")
    return F.coalesce(
        _say(
            "median gap ", F.format_number("median_gap", 1), " s, ", whole,
            "% of the gaps within half to twice the median",
        ),
        F.lit("too few requests to describe a rhythm"),
    )


def description() -> Column:
    """Sentence about an owned slice, built from the columns of ``anomaly_facts``."""
    first = _say(
        "one ", F.col("top_client_type"), " user has ", F.col("n_requests"), " of ",
        F.col("slice_requests"), " requests with this error, all within ",
        F.rint("window_minutes").cast("bigint"), " minutes, ", F.col("n_top_prompt_len"),
        " with a prompt of ", F.col("top_prompt_len"), " characters; ", _rhythm(),
        "; the account sent ", F.col("owner_requests"), " requests in all, ",
        percent1(F.col("owner_error_share")), "% failed, mostly to ", F.col("top_endpoint"), " with ",
        F.col("top_model_family"), ", using ", F.col("n_user_agents"), " user agents",
    )
    second = _say(
        F.col("slice_requests"), " requests by ", F.col("slice_users"), " users, ",
        _percent("n_requests", "slice_requests"), "% by one user; the other ",
        F.col("slice_users") - 1, " users have ", F.col("slice_requests") - F.col("n_requests"), "; ",
        F.floor(F.col("chat_share") * 100 + F.lit(0.5)).cast("bigint"), "% go to /v1/chat/completions and ",
        F.floor(F.col("top_agent_share") * 100 + F.lit(0.5)).cast("bigint"),
        "% come from one user agent; ", _rhythm(),
    )
    third = _say(
        F.col("slice_requests"), " requests by ", F.col("slice_users"), " users, ",
        _percent("n_requests", "slice_requests"), "% by one user with account type ",
        F.coalesce("account_type", F.lit("unknown")), "; the account sent ", F.col("owner_requests"),
        " requests (", _percent("owner_requests", "n_total"), "% of all, ",
        F.coalesce(F.when(F.col("n_direct") > 0, _percent("owner_requests", "n_direct")), F.lit("-")),
        "% of the direct ones), ", percent1(F.col("owner_offpeak_share")), "% of them off-peak, on ",
        F.col("n_active_days"), " days; ", _rhythm(),
    )
    text = F.when(F.col("_order") == 1, first).when(F.col("_order") == 2, second).otherwise(third)
    return F.concat(
        text, F.coalesce(_say(" (same account as row ", F.col("same_owner_as"), ")"), F.lit(""))
    )


def anomaly_profile(t: Tables) -> MetricResult:
    requests = t["request"]
    facts = anomaly_facts(requests, t["user"])
    report = facts.orderBy("_order").select(
        "anomaly", "n_users", "n_requests", "share", description().alias("description")
    )
    counts = requests.agg(F.count("*").alias("n_total")).unionByName(
        flagged_requests(requests).agg(F.count("*").alias("n_covered")), allowMissingColumns=True
    )
    return MetricResult(
        report, counts.agg(F.max("n_total").alias("n_total"), F.max("n_covered").alias("n_covered")), []
    )
