"""The field audit (P01-P07) on one JSON document per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.scalars import JSON_TEXT, K
from catalog.views import table
from usagelens.plans import audit
from usagelens.sources.raw import hash_sample

DECLARED = [("c1", "k"), ("c2", "n.x"), ("c3", "a"), ("c4", "gone.path"), ("c5", "n"), ("c6", "a.y")]
REDACTED = ("s", "a.y")


def records(spark, sf):
    """(source_path, v): the slots of the scalar queries, plus a text of varying length."""
    text = JSON_TEXT.replace("""'{"k": '""", """'{"t": "', repeat('x', cast(event_id % 300 as int)), '", "k": '""", 1)
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", "event_type", f"{K} as k")
        .selectExpr("lpad(cast(event_id as string), 8, '0') as source_path", f"{text} as text")
        .select("source_path", F.parse_json("text").alias("v"))
    )


# The same paths by hand: (key, path, kind, text), kind null for a container.
LEAVES = f"""
with e as (select lpad(cast(event_id as varchar), 8, '0') as key, event_id, event_type, {K} k, event_id % 12 slot from events),
p as (
  select key, 't' path, 'string' kind, repeat('x', cast(event_id % 300 as bigint)) as text from e
  union all select key, 'k', 'integer', cast(k as varchar) from e
  union all select key, 's', 'string', event_type from e
  union all select key, 'n', null, null from e
  union all select key, 'n.x', 'integer', cast(k * 2 as varchar) from e
  union all select key, 'n.z', 'null', 'null' from e
  union all select key, 'a', null, null from e where slot in (9, 10)
  union all select key, 'a', case slot when 0 then 'null' when 3 then 'integer' when 4 then 'number' when 6 then 'boolean' when 7 then 'list' when 8 then 'list' else 'string' end,
    case slot when 0 then 'null' when 1 then 'text' when 2 then '' when 3 then k || '' when 4 then k || '.75' when 5 then k || '' when 6 then 'true'
      when 7 then '[1,"b",false]' when 8 then '[]' else '1.5' end from e where slot not in (9, 10)
  union all select key, 'a.y', 'integer', '2' from e where slot = 9
  union all select key, 'a.b', 'list', '[3]' from e where slot = 9)"""

STATS = f"""{LEAVES},
leaf as (select * from p where kind is not null),
types as (select path, string_agg(kind || ':' || c, ',' order by c desc, kind) types from (select path, kind, count(*) c from leaf group by 1, 2) group by 1),
shown as (select path, string_agg(v, ' | ' order by first_key, v) samples from (
    select *, row_number() over (partition by path order by first_key, v) r from (
      select path, case when length(text) > 200 then '<' || length(text) || ' characters, not shown>' else left(text, 80) end v, min(key) first_key
      from leaf where path not in ('s', 'a.y') group by 1, 2)) where r <= 5 group by 1),
stats as (
  select l.path, count(*) n_records, floor(cast(count(*) as double) / (select count(*) from e) * 10000 + 0.5) / 10000 share, max(types) types,
    count(distinct text) n_values, cast(count(*) filter (where length(text) > 0) as bigint) n_non_empty,
    cast(quantile_disc(length(text), 0.5) as bigint) length_p50, cast(max(length(text)) as bigint) length_max,
    l.path in ('s', 'a.y') redacted, coalesce(max(samples), '') samples
  from leaf l left join types on types.path = l.path left join shown on shown.path = l.path group by l.path)"""


def paths(spark, sf):
    return audit.walk_paths(records(spark, sf), "source_path")


def stats(spark, sf):
    total = table(spark, sf, "events").agg(F.count("*")).scalar()
    return audit.path_stats(paths(spark, sf), total, REDACTED)


def declared(spark, sf):
    return audit.declared_paths(table(spark, sf, "events"), DECLARED)


@query("p01_walk_paths", f"{LEAVES}\nselect path, kind, kind is null is_container, count(*) n, min(key) first_key, count(distinct text) n_texts from p group by 1, 2")
def walk(spark, sf):
    return paths(spark, sf).groupBy("path", "kind", "is_container").agg(
        F.count("*").alias("n"), F.min("key").alias("first_key"), F.count_distinct("text").alias("n_texts")
    )


@query("p01_walk_paths_shallow", f"{LEAVES}\nselect path, coalesce(kind, 'object') kind, count(*) n from p where path not like '%.%' group by 1, 2")
def shallow(spark, sf):
    """One level deep: objects are kept as leaves of kind 'object', never dropped."""
    found = audit.walk_paths(records(spark, sf), "source_path", levels=1)
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"))


query("p02_path_stats", f"{STATS}\nselect * from stats")(stats)

DECLARED_SQL = "(values " + ", ".join(f"('{c}', '{p}')" for c, p in DECLARED) + ') d("column", path)'


@query("p03_unmapped", f"{STATS}\nselect * from stats where path not in (select path from {DECLARED_SQL})")
def unmapped(spark, sf):
    return audit.unmapped(stats(spark, sf), declared(spark, sf))


@query("p04_missing", f"{LEAVES}\nselect * from {DECLARED_SQL} where path not in (select path from p)")
def missing(spark, sf):
    return audit.missing(paths(spark, sf), declared(spark, sf))


@query("p05_catalogue", f"{STATS}\nselect *, path in (select path from {DECLARED_SQL}) mapped from stats")
def catalogue(spark, sf):
    return audit.catalogue(stats(spark, sf), declared(spark, sf))


@query("p06_redaction", """
select doc_id, case when length(text) > 200 then '<' || length(text) || ' characters, not shown>' else left(text, 80) end shown,
  source = 'src1' or source like 'src1.%' or source = 'src2' or source like 'src2.%' redacted
from documents""")
def redaction(spark, sf):
    """What a report may show of whole documents, and which sources would be redacted as paths."""
    return table(spark, sf, "documents").select(
        "doc_id",
        audit.sample_text(F.col("text")).alias("shown"),
        audit.is_redacted(F.col("source"), ("src1", "src2")).alias("redacted"),
    )


@query("p07_hash_sample", "select page_id, url from pages where cast('0x' || left(md5(url), 8) as bigint) < cast(floor(0.3 * 4294967296) as bigint)")
def sample(spark, sf):
    """The sampling operator itself: a fixed part of the pages by a hash of the address."""
    return hash_sample(table(spark, sf, "pages").select("page_id", "url"), "url", 0.3)
