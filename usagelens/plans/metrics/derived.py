"""Metrics that need a quantity to be worked out first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.aggregates import share_true
from usagelens.functions.scalars import (
    MODEL_DATE_SUFFIX,
    cache_rate,
    inflation,
    is_error,
    null_label,
    position_bucket,
    round4,
    share,
)
from usagelens.operators.counts import value_counts_long
from usagelens.operators.heavy import staged
from usagelens.operators.literals import value_rows
from usagelens.operators.ordered import position_in
from usagelens.operators.quantiles import label, quantile_table
from usagelens.plans.metrics.anomalies import anomaly_profile
from usagelens.plans.metrics.model import MetricResult, MetricSpec, Tables, counters

_STATS = [label(q) for q in settings.QUANTILES] + ["max"]


def missing_flag(flag: str = "usage_missing") -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def drop_missing(df: DataFrame, flag: str = "usage_missing") -> tuple[DataFrame, DataFrame]:
    """(rows whose usage was recorded, one-row table n_excluded). An unknown flag means recorded."""
    return df.where(~missing_flag(flag)), df.agg(F.count_if(missing_flag(flag)).alias("n_excluded"))


def turn_expansion_depth(t: Tables) -> MetricResult:
    # The quantiles look for large groups first; written, so that the turns are built once for all passes.
    turns = staged(t["turn"].select("n_requests", "has_compaction"), "turns")
    compacted = F.coalesce("has_compaction", F.lit(False))
    groups = F.array_compact(
        F.array(F.lit("all_turns"), F.when(~compacted, F.lit("excluding_compacted")))
    )
    depth = turns.select("n_requests", compacted.alias("_c"), F.explode(groups).alias("bucket"))
    table = quantile_table(
        depth,
        ["bucket"],
        "n_requests",
        extra=[
            round4(share_true(F.col("n_requests") == 1)).alias("single_request_share"),
            round4(F.avg("n_requests")).alias("mean (reference only)"),
            F.count_if("_c").cast("double").alias("n_turns_with_compaction"),
        ],
    ).withColumn("n_turns", F.col("n").cast("double"))
    names = ["n_turns", *_STATS, "single_request_share", "mean (reference only)", "n_turns_with_compaction"]
    # Both groups become columns: one row per statistic.
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("_order"), F.lit(n).alias("statistic"), F.col(f"`{n}`").alias("v"))
            for i, n in enumerate(names)
        ]
    )
    long = table.select("bucket", F.explode(pairs).alias("p")).select("bucket", "p.*")
    report = long.groupBy("_order", "statistic").agg(
        *[
            F.max(F.when(F.col("bucket") == b, F.col("v"))).alias(b)
            for b in ("all_turns", "excluding_compacted")
        ]
    )
    return MetricResult(
        report.orderBy("_order").drop("_order"), counters(turns, F.col("n_requests").isNotNull())
    )


def thread_tool_message_ratio(t: Tables) -> MetricResult:
    threads = t["thread"]
    ratio = F.col("tool_message_ratio")
    table = quantile_table(
        threads, [], "tool_message_ratio",
        extra=[round4(share_true(ratio == 0)).alias("zero_ratio_share")],
    )
    report = table.select(F.lit("all threads").alias("bucket"), "n", *_STATS, "zero_ratio_share")
    return MetricResult(report, counters(threads, ratio.isNotNull()))


def cache_hit_by_request_position(t: Tables) -> MetricResult:
    scoped = t["request"].where(F.col("turn_id").isNotNull())
    positive = F.coalesce("prompt_tokens", F.lit(0)) > 0
    recorded = ~missing_flag()
    usable = scoped.where(recorded & positive).select(
        "turn_id", "ts_utc", "request_id",
        cache_rate(F.col("cached_tokens"), F.col("prompt_tokens")).alias("cache_rate"),
    )
    placed = position_in(usable, "turn_id", "ts_utc", "request_id").select(
        "turn_id", "cache_rate", position_bucket(F.col("position")).alias("bucket")
    )
    placed = staged(placed)
    table = quantile_table(
        placed, ["bucket"], "cache_rate",
        extra=[
            F.count("*").alias("n_requests"),
            F.count_distinct("turn_id").alias("n_turns"),
            round4(share_true(F.col("cache_rate") == 0)).alias("zero_cache_share"),
        ],
    )
    excluded = {
        "n_excluded_usage_missing": ~recorded,
        "n_excluded_zero_prompt_tokens": recorded & ~positive,
    }
    buckets = value_rows(t["request"].sparkSession, ["bucket"], [("1st",), ("2nd",), ("3rd+",)])
    counts = ("n", "n_requests", "n_turns")
    report = buckets.join(table, "bucket", "left").select(
        "bucket",
        F.coalesce("n", F.lit(0)).alias("n"),
        *_STATS,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts[1:]],
        "zero_cache_share",
        *[scoped.agg(F.count_if(c)).scalar().alias(name) for name, c in excluded.items()],
    )
    return MetricResult(report.orderBy("bucket"), counters(scoped, recorded & positive))


def token_inflation_by_client_type(t: Tables) -> MetricResult:
    requests = t["request"]
    recorded = ~missing_flag()
    uncached = F.col("prompt_tokens") - F.coalesce("cached_tokens", F.lit(0))
    usable = requests.where(recorded & (uncached > 0)).select(
        null_label(F.col("client_type")).alias("client_type"),
        "username",
        inflation(F.col("prompt_tokens"), F.col("cached_tokens")).alias("inflation"),
    )
    table = quantile_table(
        usable, ["client_type"], "inflation",
        extra=[F.count("*").alias("n_requests"), F.count_distinct("username").alias("n_users")],
    )
    excluded = {
        "n_excluded_usage_missing": ~recorded,
        "n_excluded_zero_denominator": recorded & (uncached <= 0),
    }
    report = table.select(
        "client_type", F.col("client_type").alias("bucket"), "n_requests", "n_users", *_STATS,
        *[requests.agg(F.count_if(c)).scalar().alias(name) for name, c in excluded.items()],
    )
    return MetricResult(
        report.orderBy("client_type"), counters(requests, recorded & (uncached > 0)), list(_STATS)
    )


def usage_missing_impact(t: Tables) -> MetricResult:
    requests = t["request"]
    missing = requests.where(missing_flag())
    status = F.col("status_code")
    kinds = (
        ("usage_missing total", F.lit(True)),
        ("of which status=200 (tokens lost)", status == 200),
        ("of which status>=400 (never reached a model)", is_error(status, settings.ERROR_STATUS_FLOOR)),
    )
    per_user = missing.groupBy("username", "status_code").agg(F.count("*").alias("_n"))
    aggregates = []
    for i, (_, condition) in enumerate(kinds):
        aggregates.append(F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0)).alias(f"_n{i}"))
        aggregates.append(F.count_distinct(F.when(condition, F.col("username"))).alias(f"_u{i}"))
    summary = per_user.agg(*aggregates).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit("summary").alias("category"),
                        F.lit(name).alias("value"),
                        F.col(f"_n{i}").alias("n_requests"),
                        F.col(f"_u{i}").alias("n_users"),
                        F.lit(i).alias("_order"),
                    )
                    for i, (name, _) in enumerate(kinds)
                ]
            )
        ).alias("r")
    ).select("r.*")
    columns = ("endpoint", "status_code", "stream", "provider")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("category"))
    counted = value_counts_long(missing, columns).select(
        "category", "value", F.col("n").alias("n_requests"),
        F.lit(None).cast("bigint").alias("n_users"), (place + 2).cast("int").alias("_order"),
    )
    total = requests.agg(F.count("*")).scalar()
    report = (
        summary.unionByName(counted)
        .orderBy("_order", F.desc("n_requests"), "value")
        .select("category", "value", "n_requests",
                share(F.col("n_requests"), total).alias("share_of_all_requests"), "n_users")
    )
    return MetricResult(report, counters(requests, missing_flag()))


def prompt_length_distribution(t: Tables) -> MetricResult:
    requests = t["request"]
    scoped = requests.where(F.col("prompt_len") > 0)
    groups = F.array(null_label(F.col("client_type")), F.lit("all"))
    rows = scoped.select("username", "prompt_len", F.explode(groups).alias("client_type"))
    table = quantile_table(
        rows, ["client_type"], "prompt_len",
        extra=[F.count("*").alias("n_requests"), F.count_distinct("username").alias("n_users")],
    )
    report = table.select("client_type", "n_requests", "n_users", *_STATS)
    return MetricResult(
        report.orderBy(F.col("client_type") == "all", "client_type"),
        counters(requests, F.col("prompt_len") > 0),
        list(_STATS),
        total_row=True,
    )


def context_length_exceeded_profile(t: Tables) -> MetricResult:
    requests = t["request"]
    hit = F.col("error_code") == settings.ANOMALY_ERROR_CODE
    hits = requests.where(hit)
    note = F.lit("usage details are empty, token columns cannot be trusted")
    summary = hits.agg(
        F.count("*").alias("n_requests"),
        F.count_distinct("username").alias("n_users"),
        F.count_if(missing_flag()).alias("n_usage_missing"),
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_order"), F.lit("summary").alias("category"),
                        F.lit(c).alias("value"), F.col(c).alias("n"),
                        (note if c == "n_usage_missing" else F.lit("")).alias("note"),
                    )
                    for i, c in enumerate(("n_requests", "n_users", "n_usage_missing"))
                ]
            )
        ).alias("r")
    ).select("r.*")
    columns = ("model_family", "error_param", "endpoint", "client_type")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("category"))
    counted = value_counts_long(hits, columns).select(
        (place + 9).cast("int").alias("_order"), "category", "value", "n", F.lit("").alias("note")
    )
    rows = summary.unionByName(counted)
    for i, (column, name) in enumerate((("prompt_len", "prompt_len"), ("prompt_tokens", "prompt_tokens (not reliable)"))):
        rows = rows.unionByName(slice_statistics(hits, column, name, 20 + 4 * i))
    report = rows.orderBy("_order", F.desc("n"), "value").drop("_order")
    return MetricResult(report, counters(requests, hit))


def slice_statistics(df: DataFrame, column: str, name: str, order: int = 0) -> DataFrame:
    """p50, p90, min and max of a column as rows, rounded half to even; no rows without a value."""
    table = quantile_table(
        df, [], column, (0.5, 0.9), extra=[F.min(F.col(column).cast("double")).alias("min")]
    )
    names = ("p50", "p90", "min", "max")
    pairs = [
        F.struct(
            F.lit(order + i).alias("_order"), F.lit(name).alias("category"), F.lit(s).alias("value"),
            F.rint(s).cast("bigint").alias("n"), F.lit("").alias("note"),
        )
        for i, s in enumerate(names)
    ]
    return table.where(F.col("n") > 0).select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def model_consistency(t: Tables) -> MetricResult:
    """All figures come from one pre-aggregate over the few columns involved."""
    requests = t["request"]
    returned, response = F.col("model_returned"), F.col("response_model")
    base = requests.select(
        "username",
        "client_type",
        "endpoint",
        returned.isNotNull().alias("_has_returned"),
        response.isNotNull().alias("_has_response"),
        (returned == response).alias("_same_text"),
        F.regexp_replace(returned, MODEL_DATE_SUFFIX, "").alias("_returned"),
        F.regexp_replace(response, MODEL_DATE_SUFFIX, "").alias("_response"),
    )
    keys = base.columns
    base = staged(base.groupBy(*keys).agg(F.count("*").alias("_n")), "base")
    both = F.col("_has_returned") & F.col("_has_response")
    same = F.col("_returned") == F.col("_response")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    sums = base.agg(
        rows_where(F.lit(True)).alias("total"),
        rows_where(F.col("_has_response")).alias("response"),
        rows_where(both).alias("both"),
        rows_where(both & F.col("_same_text")).alias("same_text"),
        rows_where(both & same).alias("same_family"),
        rows_where(both & ~same).alias("other_family"),
    )
    comparable = sums.select("both").scalar()

    def line(i: int, item: str, n: str, of: str, note: str) -> Column:
        part = F.lit(1.0) if n == of else share(F.col(n), F.col(of))
        return F.struct(
            F.lit(i).alias("_order"), F.lit(item).alias("item"), F.col(n).alias("n"),
            part.alias("share"), F.lit(note).alias("note"),
        )

    summary = sums.select(
        F.explode(
            F.array(
                line(0, "n_requests (all)", "total", "total", ""),
                line(1, "response_model present", "response", "total",
                     "absent when there is no response summary"),
                line(2, "both present (comparable)", "both", "total", ""),
                line(3, "identical text", "same_text", "both", "release dates included"),
                line(4, "same model family", "same_family", "both", "release dates cut off"),
                line(5, "different model family", "other_family", "both", "a real substitution"),
            )
        ).alias("r")
    ).select("r.*")
    pairs = (
        base.where(both & ~same)
        .groupBy("_returned", "_response", "username")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_returned", "_response")
        .agg(F.sum("_n").alias("n"), F.count("username").alias("_users"))
        .select(
            F.lit(6).alias("_order"),
            F.concat(F.lit("different: "), F.col("_returned"), F.lit(" -> "), F.col("_response")).alias("item"),
            "n",
            share(F.col("n"), comparable).alias("share"),
            F.concat(F.col("_users").cast("string"), F.lit(" users")).alias("note"),
        )
    )
    report = summary.unionByName(pairs)
    for i, column in enumerate(("client_type", "endpoint")):
        covered = base.groupBy(column).agg(
            rows_where(F.col("_has_response")).alias("n"), F.sum("_n").alias("_total")
        )
        report = report.unionByName(
            covered.select(
                F.lit(7 + i).alias("_order"),
                F.concat(F.lit(f"comparable: {column}="), null_label(F.col(column))).alias("item"),
                "n",
                share(F.col("n"), F.col("_total")).alias("share"),
                F.concat(
                    F.lit("group of "), F.col("_total").cast("string"),
                    F.when(F.col("n") == 0, F.lit(", not comparable at all")).otherwise(F.lit("")),
                ).alias("note"),
            )
        )
    return MetricResult(
        report.orderBy("_order", "item").drop("_order"),
        counters(requests, returned.isNotNull() & response.isNotNull()),
        [],
    )


SPECS = (
    MetricSpec(
        "turn_expansion_depth",
        "Into how many requests does one user action unfold?",
        "turn", "turn", "turns (direct calls have none)",
        turn_expansion_depth,
        "Neither speed nor cost. Read the median; the tail pulls the mean. A compacted turn joins several segments.",
        version="1.2",
    ),
    MetricSpec(
        "thread_tool_message_ratio",
        "What part of a thread's messages comes from tools?",
        "thread", "thread", "threads; (peak - user - assistant) / peak",
        thread_tool_message_ratio,
        "A share of messages, not of time or cost. Peaks are the longest history sent.",
    ),
    MetricSpec(
        "cache_hit_by_request_position",
        "From which request of a turn on does the prompt cache help?",
        "request", "request", "requests in a turn with recorded usage and a positive prompt",
        cache_hit_by_request_position,
        "A property of the protocol, not of users. Both exclusions are counted in their own column.",
        version="1.1",
    ),
    MetricSpec(
        "token_inflation_by_client_type",
        "By what factor do prompt tokens exceed the uncached part?",
        "request", "request", "requests with recorded usage and an uncached part",
        token_inflation_by_client_type,
        "Not a basis for billing. Requests served entirely from the cache have no ratio and are counted.",
        ("client_type",),
    ),
    MetricSpec(
        "usage_missing_impact",
        "How many requests have no recorded usage, and which are they?",
        "request", "request", "all requests",
        usage_missing_impact,
        "Their tokens are lost, not zero; failed requests legitimately have none.",
    ),
    MetricSpec(
        "prompt_length_distribution",
        "How long are the prompts, in characters?",
        "request", "request", "requests with a non-empty prompt",
        prompt_length_distribution,
        "Characters, not tokens, of this request's input alone.",
        ("client_type",), "1.1",
    ),
    MetricSpec(
        "context_length_exceeded_profile",
        "What do requests that exceed the context length look like?",
        "request", "request", "requests with that error code",
        context_length_exceeded_profile,
        "Counts only; too few for shares.",
    ),
    MetricSpec(
        "model_consistency",
        "Does the reported model agree with the one in the response summary?",
        "request", "request", "requests with both columns",
        model_consistency,
        "A cross-check of data. Read the agreement together with the comparable range below it.",
    ),
    MetricSpec(
        "anomaly_profile",
        "Which slices of traffic belong almost entirely to one user?",
        "user", "request", "three slices; each is listed only if one user has at least 80 % of it",
        anomaly_profile,
        "Describes behaviour, names nobody. Rows may be the same account. Not a detection rule.",
    ),
)
