"""Reading, replacing and writing (A03-A19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.documents import as_documents
from catalog.metrics import EXEMPT, part
from catalog.registry import query
from catalog.scalars import K
from catalog.views import level_tables, requests, sql, table
from usagelens.contract import REQUEST_SCHEMA
from usagelens.functions.variant import json_get
from usagelens.operators.dedupe import dedupe, dedupe_against, drop_keys, replace_rows
from usagelens.plans.ingest import ingest_summary, write_kept, write_read
from usagelens.plans.metrics.runner import run_metrics
from usagelens.plans.overview import overview
from usagelens.sources import manifest as M
from usagelens.sources import raw as R
from usagelens.sources import tables as T
from usagelens.sources.flatten import flatten
from usagelens.sources.keys import add_keys, stored_keys
from usagelens.sources.paths import scratch_dir
from usagelens.sources.snapshots import versions

BROKEN_TEXT = """case event_id % 10 when 0 then concat('{"k": ', k) when 1 then '[1, 2]' when 2 then '"text"' else concat('{"k": ', k, '}') end"""


def raw_records(spark, sf):
    """One text per event; some are cut off or hold no object."""
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", f"{K} as k")
        .selectExpr("concat('e', cast(event_id as string)) as source_path", f"{BROKEN_TEXT} as text", "k")
        .withColumn("v", R.parse("text"))
    )


def supplier_files(spark, sf) -> str:
    """Each supplier as a JSON file of its own in a folder of its own; returns the root.

    The rows are few bytes but many files: with a number of tasks asked for, they are not merged into one task, and each
    task moves its own files into place, not the driver those of all.
    """
    folder = scratch_dir(spark, "raw")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").json(folder)
    return folder


@query("a01_scan_raw_json", "select cast(s_suppkey as bigint) s_suppkey, s_name, cast(s_nationkey as bigint) s_nationkey from supplier")
def scanned(spark, sf):
    """The documents of a folder tree, one in each file."""
    raw = R.read_raw(spark, supplier_files(spark, sf))
    key = F.regexp_extract("source_path", r"^s_suppkey=(\d+)/", 1).cast("bigint")
    return raw.select(key.alias("s_suppkey"), json_get("v", "s_name").alias("s_name"), json_get("v", "s_nationkey", "bigint").alias("s_nationkey"))


@query("a02_source_path", "select 's_suppkey=' || s_suppkey || '/part.json' source_path from supplier")
def paths(spark, sf):
    """Paths below the root, of the files that a listing finds; Spark's own part names are cut off."""
    listed = R.list_files(spark, supplier_files(spark, sf))
    return listed.select(F.regexp_replace("source_path", r"/part-[^/]*\.json$", "/part.json").alias("source_path"))


ODD_TEXT = """case event_id % 4 when 0 then concat('{"k": 1, "k": ', k, '}') when 1 then concat('{"k": ', k, ', "x": NaN}')
 when 2 then concat('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":', k, '}}}}}}}}}}') else concat('{"k": ', k, '}') end"""


@query("a03_odd_documents", f"select count(*) n, cast(sum(k) as bigint) k from (select {K} k from events)")
def odd_documents(spark, sf):
    """A repeated key takes its last value; NaN and documents of ten levels are read."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = table(spark, sf, "events").selectExpr("event_id", f"{K} as k").selectExpr("cast(event_id as string) as source_path", f"{ODD_TEXT} as text")
    good, _ = R.split_bad(rows.withColumn("v", R.parse("text")))
    k = F.coalesce(json_get("v", "k", "bigint"), json_get("v", "a.b.c.d.e.f.g.h.i.j", "bigint"))
    return good.agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("a03_quarantine", f"""
select 'e' || event_id source_path, case when slot = 0 then 'invalid JSON' else 'not an object' end error_type,
  case when slot = 0 then 'not a JSON document, ' || length('{{"k": ' || k) || ' characters' else 'the top level of the document is not an object' end error_message
from (select event_id, event_id % 10 slot, {K} k from events) where slot < 3""")
def quarantine(spark, sf):
    return R.split_bad(raw_records(spark, sf))[1]


@query("a03_readable_records", f"select count(*) n, cast(sum({K}) as bigint) k from events where event_id % 10 >= 3")
def readable(spark, sf):
    good, _ = R.split_bad(raw_records(spark, sf))
    return good.agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def files(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_path"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id"))).alias("file_mtime"),
        F.col("n_chars").alias("file_size"),
        "doc_id",
    )


def known(spark, sf):
    """A manifest that lacks every seventh file and has another size or time for some."""
    minute = F.expr("interval 1 minute")
    rows = files(spark, sf).where(F.col("doc_id") % 7 != 0)
    return rows.select(
        "source_path",
        F.when(F.col("doc_id") % 11 == 0, F.col("file_mtime") + minute).otherwise(F.col("file_mtime")).alias("file_mtime"),
        F.when(F.col("doc_id") % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"),
        F.lit("2024-02-01").cast("timestamp").alias("ingested_at"),
        F.lit("old").alias("pipeline_version"),
    )


PENDING = "doc_id % 7 = 0 or doc_id % 5 = 0 or doc_id % 11 = 0"


@query("a04_select_pending", f"select cast(doc_id as varchar) source_path, n_chars file_size from documents where {PENDING}")
def pending(spark, sf):
    return M.select_pending(files(spark, sf), known(spark, sf)).select("source_path", "file_size")


@query("a04_read_pending", "select cast(s_suppkey as bigint) s_suppkey, s_name from supplier where s_suppkey % 3 = 0 or s_suppkey % 5 = 0")
def read_pending(spark, sf):
    """A backfill: every third file is new and every fifth has another size; these are read, and no others."""
    root = supplier_files(spark, sf)
    key = F.regexp_extract("source_path", r"^s_suppkey=(\d+)/", 1).cast("bigint")
    listed = R.list_files(spark, root)
    size = F.when(key % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    pending = M.select_pending(listed, listed.where(key % 3 != 0).withColumn("file_size", size))
    return R.read_raw(spark, root, only=pending).select(key.alias("s_suppkey"), json_get("v", "s_name").alias("s_name"))


@query("a05_manifest_upsert", f"select cast(doc_id as varchar) source_path, n_chars file_size, case when {PENDING} then 'new' else 'old' end pipeline_version from documents")
def upsert(spark, sf):
    manifest = known(spark, sf)
    fresh = M.select_pending(files(spark, sf), manifest).select(
        "source_path", "file_mtime", "file_size",
        F.lit("2024-03-01").cast("timestamp").alias("ingested_at"), F.lit("new").alias("pipeline_version"),
    )
    return M.upsert_manifest(manifest, fresh).select("source_path", "file_size", "pipeline_version")


COPIES = "case when event_id % 10 <> 0 then case when event_id % 3 = 0 then 'hot' else concat(user_id, '-', event_type) end end"


@query("a06_dedupe_in_batch", f"""
select event_id, id, value from (select *, row_number() over (partition by id order by event_id) r from (select event_id, value, {COPIES} id from events)) where id is null or r = 1""")
def in_batch(spark, sf):
    """A third of the rows share one id; rows without an id all stay."""
    rows = table(spark, sf, "events").selectExpr("event_id", "value", f"{COPIES} as id")
    return dedupe(rows, "id", "event_id").select("event_id", "id", "value")


NOT_STORED = """
select l_orderkey, l_linenumber, k from (select *, case when l_linenumber <> 3 then l_orderkey end k from lineitem) where k is null or k not in (select o_orderkey from orders where o_orderstatus {})"""


def keyed_lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber <> 3 then l_orderkey end as k")


@query("a07_dedupe_against", NOT_STORED.format("= 'F'"))
def against(spark, sf):
    stored = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"))
    return dedupe_against(keyed_lines(spark, sf), stored, "k")


@query("a07_key_index", NOT_STORED.format("in ('F', 'P')"))
def against_index(spark, sf):
    """Stored ids in buckets: two commits, the second of which drops a source of the first."""
    folder = scratch_dir(spark, "keys")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("source"))
    commits = ()
    for status, dropped in (("FO", None), ("P", orders.where("source = 'O'").select("source"))):
        commits += (add_keys(orders.where(F.col("source").isin(*status)), folder, "key", "source", commits, dropped),)
    rows = keyed_lines(spark, sf)
    asked = rows.where("k is not null").select(F.col("k").alias("_k")).distinct()
    return drop_keys(rows, stored_keys(spark, folder, asked, commits), "k")


@query("a08_replace_rows", """
select l_orderkey, count(*) n, cast(sum(l_linenumber) as bigint) lines, 'stored' origin from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') group by 1
union all select o_orderkey, 1, 0, 'fresh' from orders where o_orderstatus = 'P'""")
def replaced(spark, sf):
    stored = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("stored").alias("origin"))
    fresh = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("fresh").alias("origin")
    )
    return replace_rows(stored, fresh, "l_orderkey").groupBy("l_orderkey", "origin").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")
    )


def stored_requests(spark, sf) -> str:
    """The derived requests written as a request table; returns its folder."""
    folder = scratch_dir(spark, "requests")
    rows = requests(spark, sf)
    rows = rows.withColumn("source_path", F.concat(F.lit("logs/"), F.col("username")))
    T.write_requests(rows, folder)
    return folder


BY_DATE = "select date_local, count(*) n, count(distinct request_id) n_ids from req {} group by 1"


@query("a08_replace_by_source_table", sql(BY_DATE.format("where username not in ('user0003', 'user0007') and uid % 10 <> 4"), "req"))
def replace_table(spark, sf):
    """Delete the rows of some sources from a partitioned table on disk."""
    folder = stored_requests(spark, sf)
    gone = requests(spark, sf).where(
        F.col("username").isin("user0003", "user0007") | F.col("username").endswith("4")
    ).select(F.concat(F.lit("logs/"), F.col("username")).alias("source_path"))
    T.replace_by_source(spark, folder, gone)
    return _by_date(T.read_requests(spark, folder))


@query("a08_snapshot_history", sql("""
select 1 version, count(*) n, count(distinct username) users from req union all
select 2, count(*), count(distinct username) from req where username <> 'user0003' union all
select 3, count(*) + count(case when username = 'user0003' then 1 end), count(distinct username) from req""", "req"))
def history(spark, sf):
    """Three states of one table: all rows, one source deleted, and that source and more rows added in one commit."""
    folder = stored_requests(spark, sf)
    gone = F.lit("logs/user0003").alias("source_path")
    rows = T.read_requests(spark, folder)
    T.replace_by_source(spark, folder, spark.range(1).select(gone))
    again = rows.where("username = 'user0003'").withColumn("source_path", F.lit("logs/again"))
    T.replace_by_source(spark, folder, spark.range(1).select(gone), again.unionByName(again))
    found = None
    for version in versions(spark, folder):
        one = T.read_requests(spark, folder, version).agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.count_distinct("username").alias("users"))
        found = one if found is None else found.unionByName(one)
    return found


def _by_date(rows):
    return rows.groupBy("date_local").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("n_ids"))


@query("a09_write_partitioned", sql(BY_DATE.format(""), "req"))
def write(spark, sf):
    return _by_date(spark.read.schema("request_id string, date_local string").parquet(stored_requests(spark, sf)))


@query("a10_read_dataset", sql("select request_id, date_local, ts_local, hour_local, usage_missing, cached_tokens, 'logs/' || username source_path from req", "req"))
def read(spark, sf):
    rows = T.read_requests(spark, stored_requests(spark, sf))
    return rows.select("request_id", "date_local", "ts_local", "hour_local", "usage_missing", "cached_tokens", "source_path")


@query("a11_registry_csv", sql("select * from reg", "reg"))
def registry_csv(spark, sf):
    folder = scratch_dir(spark, "registry")
    T.write_registry(level_tables(spark, sf)["registry"], folder)
    return T.read_registry(spark, folder)


@query("a12_level_tables", sql("""
select 'request' level, count(*) n, 89 n_columns from req union all select 'turn', count(*), 25 from turn
union all select 'thread', count(*), 23 from thread union all select 'user', count(*), 17 from usr""", "req", "turn", "thread", "usr"))
def levels(spark, sf):
    folder = scratch_dir(spark, "levels")
    built = level_tables(spark, sf)
    T.write_levels({level: built[level] for level in T.LEVELS}, folder)
    stored = T.read_levels(spark, stored_requests(spark, sf), folder)
    rows = None
    for level, df in stored.items():
        one = df.agg(F.lit(level).alias("level"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("n_columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("a13_metric_sink", sql(f"""
select hour_local, count(*) n_requests, count(distinct username) n_users, {part('count(*)', '(select count(*) from req)')} request_share, {EXEMPT} from req group by 1""", "req"))
def metric_sink(spark, sf):
    tables = level_tables(spark, sf)
    folder = scratch_dir(spark, "metrics")
    run_metrics(tables, tables["rules"], folder, "r1", ["requests_by_hour"])
    return spark.read.parquet(f"{folder}/run_id=r1/metric=requests_by_hour")


@query("a14_row_count", "select count(*) n_rows from lineitem")
def row_count(spark, sf):
    return T.row_count(spark, f"{sf}/lineitem.parquet")


def order_runs(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("run_id"))


@query("a15_latest_snapshot", """
select o_orderkey, m run_id from (select o_orderkey, strftime(o_orderdate, '%Y-%m') m from orders)
where m = (select max(strftime(o_orderdate, '%Y-%m')) from orders where strftime(o_orderdate, '%Y-%m') <= '1996-05-15')""")
def snapshot(spark, sf):
    return T.latest_snapshot(order_runs(spark, sf), "1996-05-15")


# Summary rows of many runs, the same text in both engines.
SUMMARY_COLUMNS = (
    "concat(event_type, '-', user_id % 5) as name",
    "lpad(cast(event_id as varchar(9)), 9, '0') as run_id",
    "case when event_id % 3 = 0 then 'failed' else 'success' end as status",
    "case when event_id % 7 <> 0 then cast(k as double) / 100 end as coverage",
)


def summaries(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "event_type", "user_id", f"{K} as k")
    return rows.selectExpr(*SUMMARY_COLUMNS)


LAST = f"select * from (select {', '.join(SUMMARY_COLUMNS)} from (select *, {K} k from events)) qualify row_number() over (partition by name order by run_id desc) = 1"


query("a16_latest_per_metric", LAST)(lambda spark, sf: T.latest_per_metric(summaries(spark, sf)))

query("a17_coverage_lookup", f"""
select name, case when status = 'success' and coverage is not null then cast(cast(floor(coverage * 1000 + 0.5) as bigint) // 10 as varchar) || '.' || cast(cast(floor(coverage * 1000 + 0.5) as bigint) % 10 as varchar) || '%' else 'failed' end coverage_text
from ({LAST})""")(lambda spark, sf: T.coverage_lookup(summaries(spark, sf)))


@query("a18_ingest_report", sql("""
select count(*) processed, cast(0 as bigint) failed, count(*) "rows", count(distinct date_local) partitions, min(ts_local) ts_min, max(ts_local) ts_max, cast(0 as bigint) duplicates from req""", "req"))
def report(spark, sf):
    """Flatten all documents, drop repeated ids and report the batch from what the two writes observed."""
    checked = R.with_error(as_documents(spark, sf))
    read = write_read(flatten(checked, F.lit(None).cast("timestamp"), keep=("_error",)))
    kept = write_kept(dedupe(read.rows.select(*REQUEST_SCHEMA.names), "request_id", "source_path"))
    summary = ingest_summary(read, kept).drop("scanned", "skipped", "reprocessed", "replaced_rows")
    return summary.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts_min", "ts_max")})


@query("a19_overview", sql("""
select 'request' item, cast(count(*) as varchar) value from req union all select 'columns', '89' union all select 'ts_first', cast(min(ts_local) as varchar) from req
union all select 'ts_last', cast(max(ts_local) as varchar) from req union all select 'partitions', cast(count(distinct date_local) as varchar) from req
union all select 'pipeline_version', '' union all select 'turn', cast(count(*) as varchar) from turn
union all select 'thread', cast(count(*) as varchar) from thread union all select 'user', cast(count(*) as varchar) from usr""", "req", "turn", "thread", "usr"))
def describe(spark, sf):
    return overview(level_tables(spark, sf))
