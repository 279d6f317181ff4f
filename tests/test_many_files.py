"""Trees of very many small files: written by many tasks, listed by few."""

import re

from catalog.sources import supplier_files
from usagelens.sources import raw as R

LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def suppliers(spark, folder, n):
    rows = [(i, f"s{i}", i % 25) for i in range(n)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return supplier_files(spark, str(folder))


def test_files_are_written_by_several_tasks(spark, tmp_path):
    listed = [r.source_path for r in R.list_files(spark, suppliers(spark, tmp_path, 60)).collect()]
    found = [re.fullmatch(r"s_suppkey=(\d+)/part-(\d+)-.*\.json", p).groups() for p in listed]
    assert sorted(int(k) for k, _ in found) == list(range(60))
    assert len({task for _, task in found}) > 1


def test_a_listing_task_takes_many_folders(spark, tmp_path):
    root, context, before = suppliers(spark, tmp_path, 100), spark.sparkContext, spark.conf.get(LISTERS)
    for name, listing in (("list", R.list_files), ("read", R.read_raw)):
        context.setJobGroup(f"listing-{name}", name)
        df = listing(spark, root)
        context._jsc.clearJobGroup()
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(f"listing-{name}") for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages]
        assert tasks and max(tasks) <= 4 * context.defaultParallelism
        assert df.count() == 100 and spark.conf.get(LISTERS) == before
