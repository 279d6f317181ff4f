"""Scalar functions (B01-B32) over JSON and columns built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.documents import flattened, view_columns
from catalog.registry import query
from catalog.views import request_rows, requests, sql, table
from usagelens.functions import scalars as S
from usagelens.functions import times
from usagelens.functions import variant as V
from usagelens.functions.aggregates import any_of
from usagelens.operators.counts import with_share, with_share_exact
from usagelens.sources.flatten import to_typed

# JSON texts by event. Slot a runs through the kinds of values.
SLOTS = "event_id % 12"
JSON_TEXT = """concat('{"k": ', k, ', "s": "', event_type, '", "n": {"x": ', k * 2, ', "z": null}, "a": ',
  case event_id % 12 when 0 then 'null' when 1 then '"text"' when 2 then '""' when 3 then concat('', k) when 4 then concat('', k, '.75')
    when 5 then concat('"', k, '"') when 6 then 'true' when 7 then '[1, "b", false]' when 8 then '[]' when 9 then '{"y": 2, "b": [3]}'
    when 10 then '{}' else '"1.5"' end, '}')"""
K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"


def documents(spark, sf):
    """(event_id, k, v): one parsed document per event."""
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", "event_type", f"{K} as k")
        .selectExpr("event_id", "k", f"{JSON_TEXT} as text")
        .select("event_id", "k", F.try_parse_json("text").alias("v"))
    )


def doc_query(name: str, column, expected: str) -> None:
    """A function of slot a, against a CASE over the kinds of values."""
    query(name, f"select event_id, {expected} result from (select event_id, event_type, {K} k, {SLOTS} slot from events)")(
        lambda spark, sf: documents(spark, sf).select("event_id", column().alias("result"))
    )


NODE = lambda: V.json_node("v", "a")
doc_query("b01_json_get", lambda: V.json_get("v", "n.x", "bigint"), "k * 2")
doc_query("b01_json_get_through_scalar", lambda: V.json_get("v", "k.x.y"), "cast(null as varchar)")
doc_query("b02_json_first", lambda: V.to_text(V.json_first("v", "n.z", "missing.z", "a", "s")),
          "case slot when 0 then event_type when 1 then 'text' when 2 then '' when 3 then k || '' when 4 then k || '.75' when 5 then k || '' when 6 then 'true' "
          "when 7 then '[1,\"b\",false]' when 8 then '[]' when 9 then '{\"b\":[3],\"y\":2}' when 10 then '{}' else '1.5' end")
doc_query("b03_to_text", lambda: V.to_text(NODE()),
          "case slot when 1 then 'text' when 2 then '' when 3 then k || '' when 4 then k || '.75' when 5 then k || '' when 6 then 'true' "
          "when 7 then '[1,\"b\",false]' when 8 then '[]' when 9 then '{\"b\":[3],\"y\":2}' when 10 then '{}' when 11 then '1.5' end")
doc_query("b04_join_list", lambda: V.join_list(NODE()),
          "case slot when 1 then 'text' when 2 then '' when 3 then k || '' when 4 then k || '.75' when 5 then k || '' when 6 then 'true' "
          "when 7 then '1,b,false' when 8 then '' when 9 then '{\"b\":[3],\"y\":2}' when 10 then '{}' when 11 then '1.5' end")
doc_query("b05_to_int", lambda: V.to_long(NODE()), "case when slot in (3, 4, 5) then k end")
doc_query("b06_to_float", lambda: V.to_double(NODE()),
          "cast(case when slot in (3, 5) then k when slot = 4 then cast(k as double) + 0.75 when slot = 11 then 1.5 end as double)")
doc_query("b07_to_bool", lambda: V.to_bool(NODE()), "case when slot = 6 then true end")
doc_query("b08_length_only", lambda: V.length_only(NODE()),
          "cast(case slot when 1 then 4 when 2 then 0 when 3 then length(k || '') when 4 then length(k || '.75') when 5 then length(k || '') when 6 then 4 "
          "when 7 then 13 when 8 then 2 when 9 then 15 when 10 then 2 when 11 then 3 end as bigint)")
doc_query("b09_count_of", lambda: V.count_of(NODE()),
          "cast(case slot when 3 then k when 4 then k when 5 then k when 7 then 3 when 8 then 0 when 9 then 2 when 10 then 0 end as bigint)")

STAMP = """case event_id % 8 when 0 then concat(t, 'Z') when 1 then t when 2 then replace(t, 'T', ' ') when 3 then concat(t, '+08:00') when 4 then concat(substr(t, 1, 19), 'z')
  when 5 then substr(t, 1, 10) when 6 then '2026' else concat(substr(t, 1, 10), 'T99:00:00') end"""


@query("b10_parse_ts", """
select event_id, case event_id % 8 when 0 then ts when 1 then ts when 2 then ts when 3 then ts - interval 8 hour
  when 4 then date_trunc('second', ts) when 5 then date_trunc('day', ts) end parsed from events""")
def parse_ts(spark, sf):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return (
        table(spark, sf, "events")
        .select("event_id", t.alias("t"))
        .selectExpr("event_id", f"{STAMP} as text")
        .select("event_id", times.parse_ts(F.col("text")).alias("parsed"))
    )


@query("b11_local_calendar", """
select event_id, ts + interval 8 hour ts_local, cast(cast(ts + interval 8 hour as date) as varchar) date_local,
  cast(hour(ts + interval 8 hour) as bigint) hour_local, cast(isodow(ts + interval 8 hour) - 1 as bigint) weekday_local from events""")
def calendar(spark, sf):
    ts = F.col("ts").cast("timestamp")
    columns = times.local_calendar(ts, "Asia/Taipei")
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in columns.items()])


@query("b12_log_lag_ms", """
select event_id, cast(round_even(cast(epoch_us(ts) - epoch_us(created) as double) / 1000, 0) as bigint) log_lag_ms
from (select event_id, ts, case when event_id % 5 <> 0 then ts + to_microseconds(cast(20126000 + event_id * 37 as bigint)) end created from events)""")
def lag(spark, sf):
    received = F.col("ts").cast("timestamp")
    later = F.timestamp_micros(F.unix_micros(received) + 20126000 + F.col("event_id") * 37)
    created = F.when(F.col("event_id") % 5 != 0, later)
    return table(spark, sf, "events").select("event_id", times.log_lag_ms(received, created).alias("log_lag_ms"))


@query("b13_usage_missing", "select event_id, event_id % 4 <> 0 usage_missing from events")
def usage_missing(spark, sf):
    """Present, {}, not an object and absent, in turn."""
    details = "case event_id % 4 when 0 then '{\"usage_details\": {\"cached_tokens\": 0}}' when 1 then '{\"usage_details\": {}}' when 2 then '{\"usage_details\": 7}' else '{}' end"
    rows = table(spark, sf, "events").selectExpr("event_id", f"{details} as text")
    return rows.select("event_id", V.usage_missing(F.try_parse_json("text")).alias("usage_missing"))


def from_requests(name: str, column, expected: str) -> None:
    query(name, sql(f"select request_id, {expected} result from req", "req"))(
        lambda spark, sf: requests(spark, sf).select("request_id", column().alias("result"))
    )


from_requests("b14_model_family", lambda: S.model_family(F.col("model_returned")), "model_family")
from_requests("b15_blank_to_null", lambda: S.blank_to_null(F.col("tool_types")), "nullif(tool_types, '')")
from_requests("b16_client_type", lambda: S.client_type(F.col("thread_id")), "client_type")
from_requests("b21_safe_ratio", lambda: S.safe_ratio(F.col("cached_tokens"), F.col("prompt_tokens")),
              "case when prompt_tokens > 0 then cast(cached_tokens as double) / prompt_tokens end")
from_requests("b26_shape_key", lambda: S.shape_key([F.col("text_format_name"), F.col("message_count"), F.col("error_code")]),
              "coalesce(text_format_name, '<null>') || '|' || message_count || '|' || coalesce(error_code, '<null>')")
from_requests("b28_null_label", lambda: S.null_label(F.col("error_code")), "coalesce(error_code, '<null>')")
from_requests("b31_cache_rate", lambda: S.cache_rate(F.col("cached_tokens"), F.col("prompt_tokens")),
              "case when prompt_tokens > 0 then cast(cached_tokens as double) / prompt_tokens end")
from_requests("b32_inflation", lambda: S.inflation(F.col("prompt_tokens"), F.col("cached_tokens")),
              "case when prompt_tokens - coalesce(cached_tokens, 0) > 0 then cast(prompt_tokens as double) / (prompt_tokens - coalesce(cached_tokens, 0)) end")


@query("b17_basename", "select page_id, string_split(url, '/')[-1] file from pages")
def basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.basename(F.col("url")).alias("file"))


@query("b18_to_typed_frame", "select cast(event_id as varchar) request_id, cast(null as bigint) prompt_len, cast(event_id as double) temperature from events")
def typed(spark, sf):
    """A frame with three of the columns gets all 89 in contract types; three are shown."""
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_id").alias("temperature"), F.lit(None).alias("prompt_len")
    )
    return to_typed(rows).select("request_id", "prompt_len", "temperature")


@query("b19_flatten", sql(f"select {view_columns()} from req", "req"))
def flatten(spark, sf):
    """Requests written as nested JSON, parsed and flattened again: all 89 columns."""
    return flattened(spark, sf)


@query("b20_classify_account", """
select c_custkey, case when a % 4 = 0 then 'student' when a % 4 = 1 then 'staff' else 'service' end account_type,
  case when a % 4 = 0 then upper(chr(cast(97 + a % 26 as integer))) end degree, case when a % 4 = 0 then lpad(cast(a % 100 as varchar), 2, '0') end entry_year,
  case when a % 4 = 0 then lpad(cast(a % 97 as varchar), 2, '0') end dept_code
from (select c_custkey, c_custkey a from customer)""")
def accounts(spark, sf):
    """Lower-case students, staff, service names and a nearly right student, in turn."""
    a = F.col("c_custkey")

    def digits(n, width):
        return F.lpad((a % n).cast("string"), width, "0")

    student = F.concat(F.char(97 + a % 26), digits(100, 2), digits(97, 2), F.lit("XXX@mail"))
    account = (
        F.when(a % 4 == 0, student)
        .when(a % 4 == 1, F.concat(F.lit("D"), digits(999, 6), F.lit("XXX")))
        .when(a % 4 == 2, F.concat(F.lit("link-"), a.cast("string")))
        .otherwise(F.concat(F.lit("B1"), digits(100, 2), F.lit("XXX@mail")))
    )
    return table(spark, sf, "customer").select(a, S.classify_account(account).alias("c")).select("c_custkey", "c.*")


@query("b22_duration_ms", """
select o_orderkey, cast(round_even(cast(epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate)) as double) / 1000, 0) as bigint) duration_ms
from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def duration(spark, sf):
    shipped = F.col("l_shipdate").cast("timestamp")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        times.duration_ms(F.min(shipped), F.max(shipped)).alias("duration_ms")
    )
    return lines.join(table(spark, sf, "orders"), "o_orderkey", "left_semi")


@query("b23_split_csv", sql("""
select part, count(*) n from (select unnest(string_split(tool_types, ',')) part from req) where part <> '' group by 1""", "req"))
def split(spark, sf):
    parts = requests(spark, sf).select(F.explode(S.split_csv(F.col("tool_types"))).alias("part"))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@query("b24_share", """
select p_brand, count(*) n, floor(cast(count(*) as double) / sum(count(*)) over () * 10000 + 0.5) / 10000 part_share from part group by 1""")
def share(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return with_share(counts, "n", "part_share")


@query("b25_share_exact", """
select p_type, n, cast(units + case when row_number() over (order by n desc, p_type) = 1 then 10000 - sum(units) over () else 0 end as double) / 10000 part_share
from (select p_type, count(*) n, cast(floor(cast(count(*) as double) * 10000 / (select count(*) from part) + 0.5) as bigint) units from part group by 1)""")
def share_exact(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return with_share_exact(counts, "n", "p_type", "part_share")


@query("b27_position_bucket", """
select case l_linenumber when 1 then '1st' when 2 then '2nd' else '3rd+' end bucket, count(*) n from lineitem group by 1""")
def bucket(spark, sf):
    named = table(spark, sf, "lineitem").select(S.position_bucket(F.col("l_linenumber")).alias("bucket"))
    return named.groupBy("bucket").agg(F.count("*").alias("n"))


@query("b29_weekday_note", """
select cast(cast(ts as date) as varchar) on_day, list_element(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], cast(isodow(ts) as bigint)) || ' (weekday_local=' || (isodow(ts) - 1) || '), ' || count(distinct user_id) || ' users' note
from events group by 1, isodow(ts)""")
def weekday(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count_distinct("user_id").alias("u"))
    return days.select(
        F.col("d").cast("string").alias("on_day"),
        times.weekday_note(F.weekday("d").cast("bigint"), F.col("u")).alias("note"),
    )


@query("b30_tool_message_count", """
select conv_id, count(*) - count(*) filter (where role = 'user') - count(*) filter (where role = 'assistant') tool_messages from conversations group by 1""")
def tool_messages(spark, sf):
    def of(role):
        return F.count_if(F.col("role") == role)

    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        S.tool_messages(F.count("*"), of("user"), of("assistant")).alias("tool_messages")
    )


@query("b30_cumulative_peaks", sql("""
select thread_id, max(message_count) - max(user_message_count) - max(assistant_message_count) tool_messages, bool_or(usage_missing) any_missing
from req where thread_id is not null group by 1""", "req"))
def peaks(spark, sf):
    rows = request_rows(spark, sf).where(F.col("thread_id").isNotNull())
    return rows.groupBy("thread_id").agg(
        S.tool_messages(F.max("message_count"), F.max("user_message_count"), F.max("assistant_message_count")).alias("tool_messages"),
        any_of(F.col("usage_missing")).alias("any_missing"),
    )
