"""Metrics that count what is recorded, without a derived quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.aggregates import join_unique
from usagelens.functions.scalars import is_error, null_label, shape_key, split_csv
from usagelens.functions.times import weekday_note
from usagelens.operators.counts import group_users, with_share, with_share_exact, with_watched
from usagelens.operators.heavy import staged
from usagelens.plans.metrics.model import MetricResult, MetricSpec, Tables, counters

_SHAPE = ("text_format_name", "message_count", "user_message_count", "assistant_message_count")


def _orphan() -> Column:
    return (F.col("client_type") == "codex") & F.col("turn_id").isNull()


def orphan_profile(requests: DataFrame) -> DataFrame:
    """One row about conversational requests without a turn.

    Requests of the same shape that do have a turn are counted per shape, so no join is needed.
    """
    shape = shape_key([F.col(c) for c in _SHAPE])
    same = (
        requests.groupBy(shape.alias("_shape"))
        .agg(F.count_if(_orphan()).alias("_orphans"), F.count("turn_id").alias("_with_turn"))
        .where(F.col("_orphans") > 0)
        .agg(F.coalesce(F.sum("_with_turn"), F.lit(0)).alias("n_same_shape_with_turn"))
    )
    about = requests.where(_orphan()).agg(
        F.count("*").alias("n_requests"),
        F.count_distinct("thread_id").alias("n_threads"),
        F.count_distinct("username").alias("n_users"),
        join_unique(F.col("endpoint")).alias("endpoints"),
        join_unique(F.col("status_code")).alias("statuses"),
        join_unique(F.col("text_format_name")).alias("formats"),
    )
    both = about.unionByName(same, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def dataset_scale(t: Tables) -> MetricResult:
    requests = t["request"]
    whole = requests.agg(
        F.count("*").alias("n_requests"),
        F.count_distinct("date_local").alias("n_days"),
        F.min("ts_local").cast("string").alias("ts_first"),
        F.max("ts_local").cast("string").alias("ts_last"),
    )
    null_note = F.lit(None).cast("string")
    scale = whole.select(
        F.explode(
            F.array(
                _item(1, "n_requests", F.col("n_requests")),
                _item(5, "n_days", F.col("n_days")),
                _item(6, "n_columns", F.lit(len(requests.columns))),
                _item(9, "ts_first", F.lit(None), F.col("ts_first")),
                _item(10, "ts_last", F.lit(None), F.col("ts_last")),
            )
        ).alias("r")
    )
    levels = [
        t[level].agg(_item(order, name, F.count("*"), null_note).alias("r"))
        for order, name, level in ((2, "n_turns", "turn"), (3, "n_threads", "thread"), (4, "n_users", "user"))
    ]
    days = (
        requests.groupBy("date_local", "username")
        .agg(F.count("*").alias("_n"), F.min("weekday_local").alias("_weekday"))
        .groupBy("date_local")
        .agg(
            F.sum("_n").alias("_n"), F.count("username").alias("_users"), F.min("_weekday").alias("_weekday")
        )
        .select(
            _item(
                7,
                F.concat(F.lit("requests_on_"), null_label(F.col("date_local"))),
                F.col("_n"),
                weekday_note(F.col("_weekday"), F.col("_users")),
            ).alias("r")
        )
    )
    text = [F.coalesce(c, F.lit("")) for c in ("endpoints", "statuses", "formats")]
    note = F.when(F.col("n_requests") == 0, F.lit("")).otherwise(
        F.concat(
            F.col("n_threads").cast("string"), F.lit(" threads, "),
            F.col("n_users").cast("string"), F.lit(" users; endpoint="), text[0],
            F.lit(", status="), text[1], F.lit(", text_format_name="), text[2], F.lit("; "),
            F.col("n_same_shape_with_turn").cast("string"),
            F.lit(" requests of the same shape carry a turn_id"),
        )
    )
    orphans = orphan_profile(requests).select(
        _item(8, "codex requests without turn_id", F.col("n_requests"), note).alias("r")
    )
    rows = scale
    for block in (*levels, days, orphans):
        rows = rows.unionByName(block)
    data = rows.select("r.*").orderBy("_order", "item").drop("_order")
    return MetricResult(data, counters(requests, F.lit(True)))


def _item(order: int, name: str | Column, value: Column, note: Column | None = None) -> Column:
    return F.struct(
        F.lit(order).alias("_order"),
        (F.lit(name) if isinstance(name, str) else name).alias("item"),
        value.cast("double").alias("value"),
        (F.lit(None) if note is None else note).cast("string").alias("note"),
    )


def requests_by_account_type(t: Tables) -> MetricResult:
    users = t["user"]
    report = users.groupBy("account_type").agg(
        F.count("username").alias("n_users"),
        F.sum("n_requests").alias("n_requests"),
        F.sum("n_threads").alias("n_threads"),
        F.sum("n_turns").alias("n_turns"),
    )
    report = with_share(with_share(report, "n_requests", "request_share"), "n_users", "user_share")
    return MetricResult(
        report.orderBy(F.desc("n_requests"), "account_type"),
        counters(users, F.col("account_type").isNotNull()),
        ["request_share", "user_share"],
    )


def requests_by_client_type(t: Tables) -> MetricResult:
    requests = t["request"]
    report = requests.groupBy("client_type").agg(
        F.count("*").alias("n_requests"),
        F.count_distinct("username").alias("n_users"),
        F.count_distinct("thread_id").alias("n_threads"),
        F.count_distinct("turn_id").alias("n_turns"),
    )
    return _by_requests(requests, report, "client_type")


def requests_by_endpoint(t: Tables) -> MetricResult:
    requests = t["request"]
    report = requests.groupBy("endpoint").agg(
        F.count("*").alias("n_requests"),
        F.count_distinct("username").alias("n_users"),
        F.count_distinct("thread_id").alias("n_threads"),
    )
    return _by_requests(requests, report, "endpoint")


def _by_requests(requests: DataFrame, report: DataFrame, key: str) -> MetricResult:
    report = with_share(report, "n_requests", "request_share")
    return MetricResult(
        report.orderBy(F.desc("n_requests"), key),
        counters(requests, F.col(key).isNotNull()),
        ["request_share"],
    )


def requests_by_model_family(t: Tables) -> MetricResult:
    requests = t["request"]
    counts = group_users(requests, ["model_family"], "username")
    known = with_share_exact(
        counts.where(F.col("model_family").isNotNull()), "n_requests", "model_family", "request_share"
    )
    unknown = counts.where(F.col("model_family").isNull()).withColumn(
        "model_family", F.lit("(unrecorded)")
    )
    report = (
        known.withColumn("_last", F.lit(0))
        .unionByName(unknown.withColumn("_last", F.lit(1)), allowMissingColumns=True)
        .orderBy("_last", F.desc("n_requests"), "model_family")
        .drop("_last")
    )
    return MetricResult(
        report, counters(requests, F.col("model_family").isNotNull()), ["request_share"]
    )


def requests_by_hour(t: Tables) -> MetricResult:
    requests = t["request"]
    report = with_share(
        group_users(requests, ["hour_local"], "username"), "n_requests", "request_share"
    )
    return MetricResult(
        report.orderBy("hour_local"),
        counters(requests, F.col("hour_local").isNotNull()),
        ["request_share"],
    )


def status_and_errors(t: Tables) -> MetricResult:
    """Everything is read off one pre-aggregate per (status, error code, user)."""
    requests = t["request"]
    base = staged(requests.groupBy("status_code", "error_code", "username").agg(F.count("*").alias("_n")), "base")
    status = F.col("status_code")
    failed = is_error(status, settings.ERROR_STATUS_FLOOR)

    def pair(order: int, category: str, value: Column) -> Column:
        return F.struct(
            F.lit(order).alias("_order"), F.lit(category).alias("category"), value.alias("value")
        )

    code = F.coalesce("error_code", F.lit("(none)"))
    outcome = F.when(failed, F.lit("error_4xx_5xx")).when(~failed, F.lit("success_lt_400"))
    pairs = F.array(
        pair(1, "status_code", status.cast("string")),
        pair(3, "error_code", F.when(failed, code)),
        pair(4, "summary", outcome),
    )
    counted = (
        base.select("username", "_n", F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p._order", "p.category", "p.value", "username")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_order", "category", "value")
        .agg(F.sum("_n").alias("n_requests"), F.count("username").alias("n_users"))
    )
    zeros = ("n_requests", "n_users")
    by_status = with_watched(
        counted.where(F.col("_order") == 1), "value", settings.WATCHED_STATUS, zeros
    ).select(F.coalesce("_order", F.lit(2)).alias("_order"), F.lit("status_code").alias("category"), "value", *zeros)
    summary = with_watched(
        counted.where(F.col("_order") == 4), "value", ("success_lt_400", "error_4xx_5xx"), zeros
    ).select(F.lit(4).alias("_order"), F.lit("summary").alias("category"), "value", *zeros)
    report = by_status.unionByName(counted.where(F.col("_order") == 3)).unionByName(summary)
    by_code = F.when(F.col("_order") == 3, -F.col("n_requests"))
    numeric = F.when(F.col("_order") <= 2, F.col("value").try_cast("bigint"))
    ordered = report.orderBy("_order", numeric, F.col("value") == "(none)", by_code, F.desc("value"))
    return MetricResult(ordered.drop("_order"), counters(requests, status.isNotNull()))


def users_by_degree_and_entry_year(t: Tables) -> MetricResult:
    students = t["user"].where(F.col("account_type") == "student")
    report = (
        students.where(F.col("degree").isNotNull() & F.col("entry_year").isNotNull())
        .groupBy("degree", "entry_year")
        .agg(
            F.count("username").alias("n_users"),
            F.sum("n_requests").alias("n_requests"),
            F.sum("n_threads").alias("n_threads"),
        )
    )
    report = with_share(with_share(report, "n_users", "user_share"), "n_requests", "request_share")
    return MetricResult(
        report.orderBy("degree", "entry_year"),
        counters(students, F.col("degree").isNotNull()),
        ["user_share", "request_share"],
    )


def reasoning_effort_distribution(t: Tables) -> MetricResult:
    codex = t["request"].where(F.col("client_type") == "codex")
    report = (
        codex.where(F.col("reasoning_effort").isNotNull())
        .groupBy("reasoning_effort")
        .agg(
            F.count("*").alias("n_requests"),
            F.count_distinct("username").alias("n_users"),
            F.count_distinct("turn_id").alias("n_turns"),
        )
    )
    return _by_requests(codex, report, "reasoning_effort")


def tool_types_distribution(t: Tables) -> MetricResult:
    threads = t["thread"]
    declares = F.col("tool_types_union").isNotNull()
    declaring = "(denominator) threads declaring tools"
    absent = "(denominator) threads without tool_types"
    # A thread counts once under every tool it declares and once under its denominator row.
    note = F.when(declares, F.lit(declaring)).otherwise(F.lit(absent))
    labels = F.concat(
        F.array(F.struct(F.lit(1).alias("_note"), note.alias("tool_type"))),
        F.transform(
            F.coalesce(split_csv(F.col("tool_types_union")), F.array().cast("array<string>")),
            lambda tool: F.struct(F.lit(0).alias("_note"), tool.alias("tool_type")),
        ),
    )
    counted = group_users(
        threads.select("username", F.explode(labels).alias("l")).select("username", "l.*"),
        ["_note", "tool_type"],
        "username",
        "n_threads",
    )
    zeros = with_watched(
        counted, "tool_type", (declaring, absent), ("n_threads", "n_users")
    ).withColumn("_note", F.coalesce("_note", F.lit(1)))
    # The total is a scalar subquery over the same small report.
    total = threads.agg(F.count("tool_types_union")).scalar()
    report = with_share(zeros, "n_threads", "declared_thread_share", total).withColumn(
        "declared_thread_share", F.when(F.col("_note") == 0, F.col("declared_thread_share"))
    )
    ordered = report.orderBy(
        "_note", F.when(F.col("_note") == 0, -F.col("n_threads")), F.col("tool_type") == absent, "tool_type"
    )
    return MetricResult(ordered.drop("_note"), counters(threads, declares))


SPECS = (
    MetricSpec(
        "dataset_scale",
        "How large is the data at each level, and which days does it cover?",
        "request", "request", "none: a description of size",
        dataset_scale,
        "First and last day are usually incomplete. Requests without a turn stay outside the turn level.",
        version="1.1",
    ),
    MetricSpec(
        "requests_by_account_type",
        "How many users and requests does each kind of account have?",
        "request", "user", "all requests, grouped by the account type of their user",
        requests_by_account_type,
        "Service accounts are not people; leave them out of per-person averages.",
        ("account_type",), "1.1",
    ),
    MetricSpec(
        "requests_by_client_type",
        "How do requests and users divide between the conversational client and direct calls?",
        "request", "request", "all requests, split by whether a thread id is present",
        requests_by_client_type,
        "A group dominated by one user describes that user, so its ratios are hidden.",
        ("client_type",),
    ),
    MetricSpec(
        "requests_by_endpoint",
        "Which endpoints are called, and by how many users?",
        "request", "request", "all requests",
        requests_by_endpoint,
        "An endpoint tells which API was called, not for what purpose. Read shares beside n_users.",
        ("endpoint",),
    ),
    MetricSpec(
        "requests_by_model_family",
        "Which model families served the requests?",
        "request", "request", "requests with a recorded model; the others are listed without a share",
        requests_by_model_family,
        "Release dates are cut off. The rounding residual sits in the largest group.",
        ("model_family",), "1.1",
    ),
    MetricSpec(
        "requests_by_hour",
        "At which local hours do requests arrive?",
        "request", "request", "all requests, grouped by local hour",
        requests_by_hour,
        "A description of the covered period; not a basis for daily rhythms.",
        ("hour_local",),
    ),
    MetricSpec(
        "status_and_errors",
        "How many requests succeed, and with which errors do the others fail?",
        "request", "request", "all requests",
        status_and_errors,
        "Watched statuses are listed even at zero. The error code rows add up to the failed requests.",
        version="1.1",
    ),
    MetricSpec(
        "users_by_degree_and_entry_year",
        "Which degrees and entry years do the student users have?",
        "user", "user", "users with a student account",
        users_by_degree_and_entry_year,
        "Answers who is there, not who uses more. Most groups are too small to show ratios.",
        ("degree", "entry_year"),
    ),
    MetricSpec(
        "reasoning_effort_distribution",
        "Which reasoning effort settings do the requests carry?",
        "request", "request", "requests of the conversational client that carry the setting",
        reasoning_effort_distribution,
        "Client defaults rather than user choices. Read shares beside n_users.",
        ("reasoning_effort",),
    ),
    MetricSpec(
        "tool_types_distribution",
        "Which kinds of tools do threads declare?",
        "thread", "thread", "threads that declare tools; both denominators are listed",
        tool_types_distribution,
        "Declared, not called.",
        version="1.1",
    ),
)
