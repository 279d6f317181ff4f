"""A metric that never ends is cancelled alone."""

import threading
import time

from pyspark.sql import functions as F

from catalog.views import level_tables
from usagelens.operators.heavy import staged
from usagelens.plans.metrics import METRICS
from usagelens.plans.metrics import runner
from usagelens.plans.metrics.model import MetricResult, MetricSpec
from usagelens.plans.metrics.runner import run_metrics


def counted(t):
    return t["request"].agg(F.count("*").alias("n_total"), F.count("*").alias("n_covered"))


def test_stuck_metrics_are_reported_and_the_others_succeed(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(runner, "_GRACE", 2)
    release = threading.Event()

    def endless_job(t):
        return MetricResult(spark.range(10**16).where(F.xxhash64("id") == 7), counted(t))

    def endless_python(t):
        release.wait()
        return MetricResult(t["request"], counted(t))

    tables = level_tables(spark, sf)
    fixed = {"request": staged(tables["request"], "request")}
    specs = {n: METRICS[n] for n in ("requests_by_hour", "requests_by_endpoint", "status_and_errors")}
    specs |= {n: MetricSpec(n, "?", "request", "request", "-", fn) for n, fn in (("endless_job", endless_job), ("endless_python", endless_python))}
    start = time.time()
    got = {r.name: r for r in run_metrics(fixed, tables["rules"], str(tmp_path), "r1", specs=specs, parallel=2, limit=40).collect()}
    release.set()
    assert time.time() - start < 150
    assert {n for n, r in got.items() if r.status == "failed"} == {"endless_job", "endless_python"}
    assert all("TimeoutError" in got[n].message for n in ("endless_job", "endless_python"))
    # Nothing of the cancelled metric runs on.
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
