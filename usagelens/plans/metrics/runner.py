"""Running metrics: write every report, keep going when one fails, summarise the run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from usagelens.plans.disclosure import rule_warnings
from usagelens.plans.metrics import METRICS
from usagelens.plans.metrics.model import MetricSpec, Tables, run_metric

SUMMARY_SCHEMA = (
    "name string, question string, unit string, source string, coverage double, n_total bigint, "
    "n_covered bigint, n_suppressed bigint, version string, status string, message string"
)


def run_metrics(
    tables: Tables,
    rules: DataFrame | None,
    out_dir: str,
    run_id: str,
    only: Sequence[str] | None = None,
    parallel: int = 4,
    specs: dict[str, MetricSpec] = METRICS,
    limit: float | None = None,
) -> DataFrame:
    """Run metrics by name (all by default) and return one summary row per metric.

    Reports go to ``out_dir/run_id=../metric=..``. The writes happen inside the try, so a failing
    job marks its own metric only. Several metrics run at a time to keep the cluster busy. A metric
    that takes more than ``limit`` seconds is reported as failed, and its jobs, known by a tag of
    their own, are cancelled; the others go on.
    """
    for name in only or ():
        if name not in specs:
            raise KeyError(f"no metric named {name!r}; there are {sorted(specs)}")
    chosen = [specs[name] for name in sorted(only or specs)]
    spark, folder = tables["request"].sparkSession, f"{out_dir}/run_id={run_id}"
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(lambda s: _run_limited(spark, s, tables, rules, folder, limit), chosen))
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


#: Seconds that a cancelled metric has to end; after that its thread is left behind.
_GRACE = 10


def _head(spec: MetricSpec) -> tuple:
    return (spec.name, spec.question, spec.unit, spec.source)


def _failed(spec: MetricSpec, message: str) -> tuple:
    return (*_head(spec), None, None, None, None, spec.version, "failed", message)


def _run_limited(
    spark: SparkSession, spec: MetricSpec, tables: Tables, rules: DataFrame | None, folder: str, limit: float | None
) -> tuple:
    """Run a metric in a thread of its own, whose jobs carry a tag, and cancel these when its time is over."""
    context, tag, rows = spark.sparkContext, f"metric-{spec.name}-{uuid.uuid4().hex}", []

    def work() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        rows.append(_run_one(spec, tables, rules, folder))

    worker = InheritableThread(target=work, daemon=True)
    worker.start()
    worker.join(limit)
    if worker.is_alive():
        context.cancelJobsWithTag(tag)
        worker.join(_GRACE)
        return _failed(spec, f"TimeoutError: not done after {limit} seconds")
    return rows[0]


def _run_one(spec: MetricSpec, tables: Tables, rules: DataFrame | None, folder: str) -> tuple:
    try:
        result = run_metric(spec, tables, rules)
        result.data.coalesce(1).write.mode("overwrite").parquet(f"{folder}/metric={spec.name}")
        hidden = []
        if result.suppressed is not None:
            target = f"{folder}_suppressed/metric={spec.name}"
            result.suppressed.coalesce(1).write.mode("overwrite").parquet(target)
            written = result.data.sparkSession.read.parquet(target)
            hidden = written.orderBy("dimension", "group_value").collect()
        counts = result.coverage().first()
        missing = rule_warnings(rules, spec.group_by, result.data.columns)
    except Exception as exc:  # noqa: BLE001 - one failing metric must not stop the others
        return _failed(spec, f"{type(exc).__name__}: {exc}")
    notes = [*result.warnings, *missing, *[f"suppressed {h.dimension}={h.group_value} ({h.reason})" for h in hidden]]
    return (
        *_head(spec), counts.coverage, counts.n_total, counts.n_covered, len(hidden), spec.version,
        "success", " | ".join(notes),
    )
