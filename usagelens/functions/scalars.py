"""Small column expressions shared by the levels and the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A release date at the end of a model name, and the masked account formats.
MODEL_DATE_SUFFIX = r"-\d{4}-\d{2}-\d{2}$"
STUDENT_ACCOUNT = r"^([A-Za-z])(\d{2})(\d{2})XXX$"
STAFF_ACCOUNT = r"^D\d{6}XXX$"


def model_family(model: Column) -> Column:
    """Model name without its release date; '' counts as not recorded."""
    return F.when(model != "", F.regexp_replace(model, MODEL_DATE_SUFFIX, ""))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def client_type(thread_id: Column) -> Column:
    """Only the conversational client sends a thread id (blank ids must be null by now)."""
    return F.when(thread_id.isNull(), F.lit("direct")).otherwise(F.lit("codex"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify_account(account: Column) -> Column:
    """struct(account_type, degree, entry_year, dept_code) of a masked account.

    Both account formats may start with D, so the number of digits decides, students first.
    """
    local = F.substring_index(account, "@", 1)
    student = local.rlike(STUDENT_ACCOUNT)

    def part(i: int) -> Column:
        return F.when(student, F.regexp_extract(local, STUDENT_ACCOUNT, i))

    return F.struct(
        F.when(student, F.lit("student"))
        .when(local.rlike(STAFF_ACCOUNT), F.lit("staff"))
        .otherwise(F.lit("service"))
        .alias("account_type"),
        F.upper(part(1)).alias("degree"),
        part(2).alias("entry_year"),
        part(3).alias("dept_code"),
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null, not infinity, when the denominator is zero or missing."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def split_csv(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda part: part != "")


def round4(x: Column) -> Column:
    """Four decimals, halves up, the same on every engine."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def share(count: Column, total: Column) -> Column:
    """count / total to four decimals, null without a total."""
    return F.when(total > 0, round4(count.cast("double") / total.cast("double")))


def percent1(x: Column) -> Column:
    """A share as a percentage with one decimal, built from integers so no engine rounds it."""
    tenths = F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("bigint")
    return F.concat(
        F.floor(tenths / F.lit(10)).cast("bigint").cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
    )


def shape_key(columns: Sequence[Column]) -> Column:
    return F.concat_ws("|", *[null_label(c) for c in columns])


def null_label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("<null>"))


def position_bucket(position: Column) -> Column:
    return (
        F.when(position == 1, F.lit("1st")).when(position == 2, F.lit("2nd")).otherwise(F.lit("3rd+"))
    )


def cache_rate(cached: Column, prompt: Column) -> Column:
    """Cached part of the prompt; a cached count that was not reported stays null."""
    return F.when(prompt > 0, cached.cast("double") / prompt.cast("double"))


def inflation(prompt: Column, cached: Column) -> Column:
    """Prompt tokens per token that was not served from the cache."""
    return safe_ratio(prompt, prompt - F.coalesce(cached, F.lit(0)))


def tool_messages(total: Column, user: Column, assistant: Column) -> Column:
    """Messages of neither side. The counters are cumulative: pass peaks, not single requests."""
    return total - user - assistant


def is_error(status: Column, floor: int) -> Column:
    return status >= floor
