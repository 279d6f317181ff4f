"""Aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_null(value: Column, order: Column) -> Column:
    """First value present, in the given order: unlike first(), the same on every run."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def any_of(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def join_sorted(values: Column) -> Column:
    """Distinct non-null entries of an array, sorted and comma joined; null when there are none."""
    present = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(present) > 0, F.array_join(present, ","))


def join_unique(c: Column) -> Column:
    """Distinct values of a group, sorted and comma joined; null when all are null."""
    return join_sorted(F.collect_set(c.cast("string")))


def union_csv(c: Column) -> Column:
    """Distinct parts of comma separated values, sorted and comma joined; null when none."""
    parts = F.flatten(F.transform(F.collect_set(c), lambda v: F.split(v, ",")))
    return join_sorted(F.filter(parts, lambda part: part != ""))


def share_true(predicate: Column) -> Column:
    """Share of true among the rows where the predicate is known."""
    return F.avg(predicate.cast("double"))
