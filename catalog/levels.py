"""Level tables, registry and concentration (L01-L07, E22, E23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import requests, sql
from usagelens.operators.concentration import concentration_summary, flagged_groups
from usagelens.operators.heavy import staged
from usagelens.plans.identity import build_registry, registry_report
from usagelens.plans.incremental import read_updated, update_levels
from usagelens.plans.levels import build_concentration, build_thread, build_turn, build_user
from usagelens.sources import tables as T
from usagelens.sources.paths import scratch_dir


@query("l01_build_turn", sql("select * from turn", "turn"))
def turn(spark, sf):
    return build_turn(requests(spark, sf))


@query("l02_build_thread", sql("select * from thread", "thread"))
def thread(spark, sf):
    return build_thread(requests(spark, sf))


@query("l03_build_user", sql("select * from usr", "usr"))
def user(spark, sf):
    r = requests(spark, sf)
    return build_user(r, build_registry(r))


def followed(spark, sf):
    """Level tables brought up to date after each of three commits: some sources, all others, and one that is read again."""
    folder, home = scratch_dir(spark, "requests"), scratch_dir(spark, "levels")
    # Derived once: the commits below take it in parts, and the registry takes it whole.
    derived = staged(requests(spark, sf), "derived")
    rows = derived.withColumn("source_path", F.concat(F.lit("logs/"), F.col("username"))).where("username is not null")
    again, early = F.col("username") == "user0003", F.col("username") < "user0008"
    stale = rows.where(again).withColumns({"prompt_tokens": F.lit(10**6).cast("bigint"), "turn_id": F.lit("stale")}).where("hour_local < 12")
    T.write_requests(rows.where(early & ~again).unionByName(stale), folder)
    update_levels(spark, folder, home)
    T.write_requests(rows.where(~early), folder)
    update_levels(spark, folder, home)
    T.replace_by_source(spark, folder, stale.select("source_path"), rows.where(again))
    update_levels(spark, folder, home)
    return read_updated(spark, home, build_registry(derived))


@query("l01_followed_turns", sql("select * from turn", "turn"))
def followed_turns(spark, sf):
    return followed(spark, sf)["turn"]


@query("l02_followed_threads", sql("select * from thread", "thread"))
def followed_threads(spark, sf):
    return followed(spark, sf)["thread"]


@query("l03_followed_users", sql("select * from usr", "usr"))
def followed_users(spark, sf):
    return followed(spark, sf)["user"]


@query("l04_build_registry", sql("select * from reg", "reg"))
def registry(spark, sf):
    return build_registry(requests(spark, sf))


@query(
    "l05_registry_report",
    sql("""select account_type, count(*) n_users, count(*) filter (where n_accounts > 1) n_multi_account
           from reg group by 1""", "reg"),
)
def report(spark, sf):
    return registry_report(build_registry(requests(spark, sf)))


def rules(spark, sf):
    r = requests(spark, sf)
    return build_concentration(r, build_registry(r))


query("e22_concentration", sql("select * from conc", "conc"))(rules)


@query(
    "e23_concentration_summary",
    sql("""select dimension, count(*) n_groups, count(*) filter (where ok) n_usable,
             count(*) filter (where below_min_group_size) n_below_min_group_size, count(*) filter (where dominant) n_dominant,
             coalesce(string_agg(group_value, ',' order by n_requests desc, group_value) filter (where ok), '(none)') usable_values,
             bool_and(ok) all_usable
           from (select *, not (below_min_group_size or dominant) ok from conc) group by 1""", "conc"),
)
def summary(spark, sf):
    return concentration_summary(rules(spark, sf))


@query("l06_build_concentration", sql("""
    select dimension, count(*) n_groups, cast(sum(n_requests) as bigint) n_requests, cast(sum(n_tokens) as bigint) n_tokens
    from (select dimension, group_value, count(*) n_requests, cast(sum(total_tokens) as bigint) n_tokens from (
        select 'client_type' dimension, client_type group_value, total_tokens from req where not usage_missing
        union all select 'account_type', account_type, total_tokens from req join reg using (username) where not usage_missing
        union all select 'degree', degree, total_tokens from req join reg using (username) where not usage_missing
        union all select 'entry_year', entry_year, total_tokens from req join reg using (username) where not usage_missing
        union all select 'dept_code', dept_code, total_tokens from req join reg using (username) where not usage_missing)
      where group_value is not null group by 1, 2)
    group by 1""", "reg"))
def recorded_only(spark, sf):
    """Concentration over the requests with recorded usage, totals per dimension."""
    r = requests(spark, sf)
    found = build_concentration(r, build_registry(r), exclude_usage_missing=True)
    return found.groupBy("dimension").agg(
        F.count("*").alias("n_groups"),
        F.sum("n_requests").alias("n_requests"),
        F.sum("n_tokens").alias("n_tokens"),
    )


@query("l07_flagged_groups", sql("select * from flag", "flag"))
def flagged(spark, sf):
    return flagged_groups(rules(spark, sf))
