"""What a metric declares and what it returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.scalars import round4
from usagelens.plans.disclosure import policy_warnings, suppress

Tables = dict[str, DataFrame]
LEVELS = ("request", "turn", "thread", "user")


@dataclass
class MetricResult:
    """A lazy report and the one-row table (n_total, n_covered) behind its coverage.

    ``ratio_columns`` lists what suppression may blank: None means by column suffix, [] nothing.
    ``total_row`` says that the report also shows an unsuppressed total.
    """

    data: DataFrame
    counters: DataFrame
    ratio_columns: list[str] | None = None
    total_row: bool = False
    suppressed: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def coverage(self) -> DataFrame:
        n, covered = F.col("n_total"), F.col("n_covered")
        ratio = F.when(n > 0, round4(covered.cast("double") / n)).otherwise(0.0)
        return self.counters.select("n_total", "n_covered", ratio.alias("coverage"))


@dataclass(frozen=True)
class MetricSpec:
    name: str
    question: str
    unit: str
    source: str
    denominator: str
    fn: Callable[[Tables], MetricResult]
    caveat: str = ""
    group_by: tuple[str, ...] = ()
    version: str = "1.0"

    def __post_init__(self) -> None:
        if not self.name.replace("_", "a").isalnum() or self.name != self.name.lower():
            raise ValueError(f"a metric name must be snake_case: {self.name!r}")
        if self.unit not in LEVELS or self.source not in LEVELS:
            raise ValueError(f"unit and source must be one of {LEVELS}")


def counters(df: DataFrame, covered: Column) -> DataFrame:
    """(n_total, n_covered) of a table and a condition on its rows."""
    return df.agg(F.count("*").alias("n_total"), F.count_if(covered).alias("n_covered"))


def run_metric(spec: MetricSpec, tables: Tables, rules: DataFrame | None) -> MetricResult:
    """Evaluate one metric and hide the ratios its groups may not show. Still lazy."""
    result = spec.fn(tables)
    if not spec.group_by:
        return result
    columns = result.data.columns
    result.warnings += policy_warnings(columns, spec.group_by, result.ratio_columns)
    result.data, result.suppressed = suppress(
        result.data, spec.group_by, result.ratio_columns, rules, result.total_row
    )
    return result
