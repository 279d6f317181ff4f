"""The data contract (H01-H12) on requests into which violations are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import request_rows, requests, sql, table
from usagelens.contract import REQUEST_FIELDS
from usagelens.plans import checks
from usagelens.sources.paths import scratch_dir

# Constants for required columns that the derived requests do not have.
FILLED = {
    "source_file": "f", "source_file_original": "f", "method": "POST", "worker": "w", "originator": "Codex Desktop",
    "host": "h", "remote_addr": "a", "conversation_key": "c", "messages_format": "m", "noise_category": "",
    "pipeline_version": "0.5.0", "assistant_response_len": 1, "memory_len": 0, "session_id": "s",
}
# Violations by event, the same text in both engines.
BROKEN = {
    "username": "case when event_id % 101 <> 0 then username end",
    "status_code": "case when event_id % 103 = 0 then 700 else status_code end",
    "hour_local": "case when event_id % 107 = 0 then 24 else hour_local end",
    "weekday_local": "case when event_id % 109 = 0 then -1 else weekday_local end",
    "prompt_tokens": "case when event_id % 113 = 0 then -1 else prompt_tokens end",
    "client_type": "case when event_id % 127 = 0 then 'other' else client_type end",
    "session_id": "case when event_id % 131 = 0 then '' else session_id end",
    "ts_local": "case when event_id % 137 = 0 then ts_local + interval '1' hour else ts_local end",
    "date_local": "case when event_id % 139 = 0 then '2000-01-01' else date_local end",
    "request_id": "case when event_id % 149 = 0 then 'again' when event_id % 151 = 0 then concat('twin', cast(event_id % 7 as varchar(9))) else request_id end",
}


def dirty(spark, sf):
    extra = request_rows(spark, sf).select("request_id", "event_id")
    rows = requests(spark, sf).drop(*FILLED).join(extra, "request_id")
    rows = rows.withColumns({c: F.lit(v) for c, v in FILLED.items()})
    path = F.concat(F.lit("logs/"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    rows = rows.withColumns({"source_path": path, "ingested_at": F.col("ts_utc")})
    columns = []
    for f in REQUEST_FIELDS:
        c = F.expr(BROKEN[f.name]) if f.name in BROKEN else F.col(f.name)
        columns.append(c.cast(f.spark_type).alias(f.name))
    return rows.select(*columns)


BAD = "with bad as (select * replace ({})".format(
    ", ".join(f"{text} as {name}" for name, text in BROKEN.items() if name != "session_id")
) + f", case when event_id % 131 = 0 then '' else 's' end session_id, 'logs/' || lpad(cast(event_id as varchar), 8, '0') source_path from (select *, cast(isodow(ts_local) - 1 as bigint) weekday_local from ({sql('select * from req', 'req')})))"

# (column, check, condition) of every violation that is written in or follows from one.
EXPECTED = {
    "h01_nullability": [("username", "not null", "username is null")],
    "h03_ranges": [
        ("status_code", "between 100 and 599", "status_code not between 100 and 599"),
        ("hour_local", "between 0 and 23", "hour_local not between 0 and 23"),
        ("weekday_local", "between 0 and 6", "weekday_local not between 0 and 6"),
        ("prompt_tokens", "non_negative", "prompt_tokens < 0"),
    ],
    "h04_membership": [("client_type", "client_type", "client_type not in ('codex', 'direct')")],
    "h05_no_blank": [("session_id", "not_blank", "session_id = ''")],
    "h06_wall_clock": [("(row)", "ts_local is the local time of ts_utc", "ts_local <> ts_utc + interval 8 hour")],
    "h07_partition_date": [("(row)", "date_local is the date of ts_local", "date_local <> cast(cast(ts_local as date) as varchar)")],
    "h08_client_type_rule": [
        ("(row)", "client_type agrees with thread_id", "client_type <> case when thread_id is null then 'direct' else 'codex' end")
    ],
}


def _register(name, expected):
    union = " union all ".join(
        f"select '{c}' \"column\", '{check}' \"check\", count(*) n from bad where {where}" for c, check, where in expected
    )
    names = [check for _, check, _ in expected]

    def run(spark, sf):
        found = checks.violations(dirty(spark, sf))
        columns = [c for c, _, _ in expected]
        return found.where(F.col("check").isin(names) & F.col("column").isin(columns))

    query(name, f"{BAD}\nselect * from ({union}) where n > 0")(run)


for _name, _expected in EXPECTED.items():
    _register(_name, _expected)

ALL = [e for group in EXPECTED.values() for e in group]
UNIQUE = "select 'request_id', 'unique', cast(sum(n) as bigint) n from (select count(*) n from bad group by request_id having count(*) > 1)"

query("h02_unique_key", f"{BAD}\nselect request_id as value, count(*) n from bad group by 1 having count(*) > 1")(
    lambda spark, sf: checks.duplicates(dirty(spark, sf), "request_id")
)


@query("h01_all_violations", f"{BAD}\nselect * from (" + " union all ".join(
    f"select '{c}' \"column\", '{check}' \"check\", count(*) n from bad where {where}" for c, check, where in ALL
) + f" union all {UNIQUE}) where n > 0")
def all_violations(spark, sf):
    """The whole contract at once: nothing but the written violations is reported."""
    return checks.violations(dirty(spark, sf))


SAMPLES = " union all ".join(
    f"select '{c}' \"column\", '{check}' \"check\", {'null' if c == '(row)' else f'cast({c} as varchar)'} v, source_path from bad where {where}"
    for c, check, where in ALL
)


@query("h09_failure_samples", f"""{BAD}
select "column", "check", string_agg(coalesce(v, '<null>'), ', ' order by source_path) samples, string_agg(source_path, ', ' order by source_path) keys
from (select *, row_number() over (partition by "column", "check" order by source_path) r from ({SAMPLES})) where r <= 3 group by 1, 2""")
def samples(spark, sf):
    return checks.failure_samples(dirty(spark, sf))


def _lagged(spark, sf):
    lag = F.expr("cast(-20126 - 9000 * cast(event_id % 3 = 0 as int) - event_id % 4000 as bigint)")
    return table(spark, sf, "events").select(lag.alias("log_lag_ms"))


@query("h11_lag_drift", """
select median, median + 20000 drift from (select quantile_cont(cast(-20126 - 9000 * cast(event_id % 3 = 0 as int) - event_id % 4000 as double), .5) median from events) where abs(median + 20000) > 1000""")
def lag_drift(spark, sf):
    return checks.lag_drift(_lagged(spark, sf), tolerance=1000)


@query("h12_unseen_categories", sql("""
select 'provider' "column", 'unseen value' warning, p detail from (select distinct provider || '-x' p from req)
union all select 'endpoint', 'unseen value', e from (select distinct endpoint || '/' || k % 3 e from req where k % 3 > 0)""", "req"))
def unseen(spark, sf):
    rows = request_rows(spark, sf)
    changed = rows.select(
        F.lit(-20000).cast("bigint").alias("log_lag_ms"),
        F.lit("").alias("originator"),
        F.concat("provider", F.lit("-x")).alias("provider"),
        F.when(F.col("k") % 3 > 0, F.concat("endpoint", F.lit("/"), (F.col("k") % 3).cast("string")))
        .otherwise(F.col("endpoint")).alias("endpoint"),
    )
    return checks.warnings(changed)


@query("h10_schema_drift", sql("""
select partition_value, c as "column", ch as "check" from (select min(date_local) partition_value from req),
  (values ('endpoint', 'missing column'), ('note', 'undeclared column'), ('latency_ms', 'type is string, expected bigint')) v(c, ch)""", "req"))
def schema_drift(spark, sf):
    """The first date's files lack a column, have one more, and hold one as another type; the other dates are as declared."""
    folder = scratch_dir(spark, "drifted")
    rows = requests(spark, sf)
    first = rows.agg(F.min("date_local")).first()[0]
    rows.where(F.col("date_local") != first).write.partitionBy("date_local").parquet(folder)
    drifted = rows.where(F.col("date_local") == first).drop("date_local", "endpoint").withColumns({"note": F.lit("x"), "latency_ms": F.col("latency_ms").cast("string")})
    drifted.write.parquet(f"{folder}/date_local={first}")
    return checks.schema_drift(spark, folder)
