"""The chained runs: ingest, validate, aggregate, metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from usagelens import settings
from usagelens.operators.concentration import concentration_summary
from usagelens.plans import levels
from usagelens.plans.checks import validate
from usagelens.plans.identity import build_registry
from usagelens.plans.ingest import Places, ingest
from usagelens.plans.metrics.runner import run_metrics
from usagelens.sources import tables as T


def validate_requests(
    spark: SparkSession, requests_dir: str, registry_dir: str, tz: str = settings.TIMEZONE
) -> DataFrame:
    """Check the request table, then write the registry; returns the warnings."""
    requests = T.read_requests(spark, requests_dir)
    found = validate(requests, tz)
    T.write_registry(build_registry(requests), registry_dir)
    return found


def aggregate(
    spark: SparkSession, requests_dir: str, registry_dir: str, levels_dir: str, runs_dir: str, run_id: str
) -> None:
    """Write turn, thread and user, and this run's concentration and its summary."""
    requests = T.read_requests(spark, requests_dir)
    registry = T.read_registry(spark, registry_dir)
    T.write_levels(
        {
            "turn": levels.build_turn(requests),
            "thread": levels.build_thread(requests),
            "user": levels.build_user(requests, registry),
        },
        levels_dir,
    )
    T.write_run(levels.build_concentration(requests, registry), f"{runs_dir}/concentration", run_id)
    rules = spark.read.parquet(f"{runs_dir}/concentration/run_id={run_id}")
    T.write_run(concentration_summary(rules), f"{runs_dir}/concentration_summary", run_id)


def metrics(
    spark: SparkSession, requests_dir: str, levels_dir: str, runs_dir: str, run_id: str, only=None, without_rules: bool = False
) -> DataFrame:
    """Run the metrics over the stored tables with the newest rules up to this run, and keep the summary.

    Rules of an older run are used with a warning. Without any rules nothing would be hidden, so that is an error unless
    it is asked for by ``without_rules``.
    """
    runs = T.read_runs(spark, f"{runs_dir}/concentration")
    newest = T.snapshot_id(runs, run_id)
    if newest is None and not without_rules:
        raise ValueError(f"there are no suppression rules up to run {run_id}: aggregate first, or ask to run without rules")
    if newest is not None and newest != run_id:
        warnings.warn(f"run {run_id} has no suppression rules of its own: those of run {newest} are used", stacklevel=2)
    rules = T.latest_snapshot(runs, run_id)
    stored = T.read_levels(spark, requests_dir, levels_dir)
    summary = run_metrics(stored, rules, f"{runs_dir}/metrics", run_id, only)
    T.write_run(summary, f"{runs_dir}/metrics_summary", run_id)
    return summary


def run_all(spark: SparkSession, places: Places, home: str, run_id: str) -> DataFrame:
    """All stages in order; the first one that fails stops the run."""
    ingest(spark, places, run_id)
    validate_requests(spark, places.requests, f"{home}/registry")
    aggregate(spark, places.requests, f"{home}/registry", f"{home}/levels", f"{home}/runs", run_id)
    return metrics(spark, places.requests, f"{home}/levels", f"{home}/runs", run_id)
