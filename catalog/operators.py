"""Filters, joins, aggregates, windows and set operations (C01-G05) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.metrics import QS, quantiles, r4
from catalog.registry import query
from catalog.views import level_tables, requests, sql, table
from usagelens.functions import aggregates as A
from usagelens.functions import scalars as S
from usagelens.operators import counts as C
from usagelens.operators.dedupe import dedupe_against
from usagelens.operators.ordered import compaction_stats, gaps, position_in
from usagelens.operators.heavy import staged
from usagelens.operators.quantiles import exact_quantiles, quantile_table
from usagelens.operators.sketches import DISTINCT_ERROR, RANK_ERROR, estimates, merge_sketches, part_sketches
from usagelens.operators.rhythm import cadence
from usagelens.plans.checks import KNOWN
from usagelens.plans.metrics.derived import drop_missing, slice_statistics

# Filters ---------------------------------------------------------------------------------------


def counted(name: str, condition, where: str) -> None:
    """Rows, users and the smallest id under a filter."""
    query(name, sql(f"select count(*) n, count(distinct username) n_users, min(request_id) first_id from req where {where}", "req"))(
        lambda spark, sf: requests(spark, sf).where(condition()).agg(
            F.count("*").alias("n"), F.count_distinct("username").alias("n_users"), F.min("request_id").alias("first_id")
        )
    )


counted("c01_key_scope", lambda: F.col("turn_id").isNotNull(), "turn_id is not null")
counted("c02_is_error", lambda: S.is_error(F.col("status_code"), 400), "status_code >= 400")
counted("c05_value_in_set", lambda: F.col("model_family").isin("gpt-4o-mini", "m-small") & F.col("hour_local").isin(0, 1, 2), "model_family in ('gpt-4o-mini', 'm-small') and hour_local in (0, 1, 2)")
counted("c06_error_code_slice", lambda: F.col("error_code") == "context_length_exceeded", "error_code = 'context_length_exceeded'")
counted("c07_orphans", lambda: (F.col("client_type") == "codex") & F.col("turn_id").isNull(), "client_type = 'codex' and turn_id is null")
counted("c08_both_present", lambda: F.col("model_returned").isNotNull() & F.col("response_model").isNotNull(), "model_returned is not null and response_model is not null")


@query("c03_drop_usage_missing", sql("""
select count(*) filter (where not usage_missing) n_kept, cast(sum(prompt_tokens) filter (where not usage_missing) as bigint) tokens,
  count(*) filter (where usage_missing) n_excluded from req""", "req"))
def drop(spark, sf):
    kept, excluded = drop_missing(requests(spark, sf))
    sums = kept.agg(F.count("*").alias("n_kept"), F.sum("prompt_tokens").alias("tokens"))
    both = sums.unionByName(excluded, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("c04_positive_denominator", """
select count(*) filter (where l_discount > 0) n_kept, count(*) filter (where not l_discount > 0) n_excluded from lineitem""")
def positive(spark, sf):
    kept = F.col("l_discount") > 0
    return table(spark, sf, "lineitem").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_excluded"))


# Joins -----------------------------------------------------------------------------------------


@query("d01_users_left_registry", """
select c_custkey, c_mktsegment, count(o_orderkey) n_orders from (select * from customer) c left join orders on o_custkey = c_custkey group by 1, 2""")
def left_join(spark, sf):
    """Every customer stays, with or without orders; orders shrink to counts before the join."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(n, "c_custkey", "left").select(
        "c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n_orders")
    )


@query("d02_requests_left_registry", sql("""
select account_type, count(*) n, cast(sum(total_tokens) as bigint) n_tokens from req left join reg using (username) group by 1""", "req", "reg"))
def grouped_by_attribute(spark, sf):
    t = level_tables(spark, sf)
    per_user = t["request"].groupBy("username").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("t"))
    people = t["registry"].select("username", "account_type")
    return per_user.join(people, "username", "left").groupBy("account_type").agg(
        F.sum("n").alias("n"), F.sum("t").alias("n_tokens")
    )


@query("d03_turns_left_compaction", sql("select turn_id, n_requests, n_segments, has_compaction from turn", "turn"))
def turns_compaction(spark, sf):
    rows = requests(spark, sf)
    stats = compaction_stats(rows, "turn_id", "message_count", "ts_utc", "request_id")
    sizes = rows.where(F.col("turn_id").isNotNull()).groupBy("turn_id").agg(F.count("*").alias("n_requests"))
    return sizes.join(stats, "turn_id", "left")


@query("d04_semi_join", """
select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where toxic = 1)""")
def semi(spark, sf):
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1)
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(toxic, "doc_id", "left_semi")


@query("d05_anti_join", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti(spark, sf):
    return dedupe_against(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("d06_rule_lookup", sql("""
select client_type, endpoint, count(*) n, max(reason) reason from req left join flag on dimension = 'client_type' and group_value = client_type group by 1, 2""", "req", "flag"))
def rule_lookup(spark, sf):
    from usagelens.operators.concentration import flagged_groups

    t = level_tables(spark, sf)
    rules = flagged_groups(t["rules"]).where(F.col("dimension") == "client_type")
    counts = t["request"].groupBy("client_type", "endpoint").agg(F.count("*").alias("n"))
    rule = rules.select(F.col("group_value").alias("client_type"), "reason")
    return counts.join(rule, "client_type", "left")


@query("d07_owner_join_back", sql("""
select endpoint, count(*) n from req where username = (select username from req where hour_local < 8 group by 1 order by count(*) desc, username limit 1) group by 1""", "req"))
def owner(spark, sf):
    rows = requests(spark, sf)
    top = C.top1_share(rows.where(F.col("hour_local") < 8), [], "username")
    return C.owner_rows(rows, top, "username").groupBy("endpoint").agg(F.count("*").alias("n"))


# Aggregates ------------------------------------------------------------------------------------


@query("e01_group_without_null_keys", sql("select error_code, count(*) n from req where error_code is not null group by 1", "req"))
def no_nulls(spark, sf):
    return requests(spark, sf).where(F.col("error_code").isNotNull()).groupBy("error_code").agg(F.count("*").alias("n"))


@query("e02_group_with_null_keys", sql("select error_code, count(*) n from req group by 1", "req"))
def nulls(spark, sf):
    return requests(spark, sf).groupBy("error_code").agg(F.count("*").alias("n"))


@query("e03_row_count", "select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2")
def size(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("e04_count_distinct", "select l_shipmode_flag, count(distinct l_suppkey) n_suppliers, count(distinct l_partkey) n_parts from (select l_returnflag l_shipmode_flag, * from lineitem) group by 1".replace("l_shipmode_flag", "flag"))
def distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count_distinct("l_suppkey").alias("n_suppliers"), F.count_distinct("l_partkey").alias("n_parts")
    )


@query("e05_sum_or_zero", sql("select error_code, cast(coalesce(sum(cached_tokens), 0) as bigint) cached from req group by 1", "req"))
def sum_or_zero(spark, sf):
    return requests(spark, sf).groupBy("error_code").agg(A.sum0(F.col("cached_tokens")).alias("cached"))


@query("e06_min_max", sql("select thread_id, max(parent_thread_id) parent, min(ts_local) ts_first, max(latency_ms) slowest from req where thread_id is not null group by 1", "req"))
def extremes(spark, sf):
    return requests(spark, sf).where(F.col("thread_id").isNotNull()).groupBy("thread_id").agg(
        F.max("parent_thread_id").alias("parent"), F.min("ts_local").alias("ts_first"), F.max("latency_ms").alias("slowest")
    )


@query("e07_first_non_null", sql("select username, arg_min(error_code, (ts_utc, request_id)) filter (where error_code is not null) first_error from req group by 1", "req"))
def first(spark, sf):
    at = F.struct("ts_utc", "request_id")
    return requests(spark, sf).groupBy("username").agg(A.first_non_null(F.col("error_code"), at).alias("first_error"))


@query("e08_any", sql("select turn_id, bool_or(usage_missing) any_missing from req where turn_id is not null group by 1", "req"))
def any_missing(spark, sf):
    return requests(spark, sf).where(F.col("turn_id").isNotNull()).groupBy("turn_id").agg(
        A.any_of(F.col("usage_missing")).alias("any_missing")
    )


@query("e09_count_if", sql("select username, count(*) filter (where status_code >= 400) n_errors from req group by 1", "req"))
def errors(spark, sf):
    return requests(spark, sf).groupBy("username").agg(F.count_if(S.is_error(F.col("status_code"), 400)).alias("n_errors"))


@query("e10_join_unique", """
select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) flags from lineitem group by 1""")
def join_unique(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(A.join_unique(F.col("l_returnflag")).alias("flags"))


@query("e11_union_csv", sql("""
select u.username, t.tools from (select distinct username from req) u left join
(select username, string_agg(distinct part, ',' order by part) tools from (select username, unnest(string_split(tool_types, ',')) part from req) where part <> '' group by 1) t using (username)""", "req"))
def union_csv(spark, sf):
    return requests(spark, sf).groupBy("username").agg(A.union_csv(F.col("tool_types")).alias("tools"))


@query("e12_exact_quantiles", f"""
select l_returnflag, {', '.join(f'{r4(f"quantile_cont(l_extendedprice, {q})")} {p}' for q, p in QS)} from lineitem group by 1""")
def exact(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", *[S.round4(F.col(p)).alias(p) for _, p in QS])


@query("e12_exact_quantiles_heavy", f"""
select l_returnflag, {', '.join(f'{r4(f"quantile_cont(l_extendedprice, {q})")} {p}' for q, p in QS)} from lineitem group by 1""")
def heavy(spark, sf):
    """The same by way of brackets: any group over 100 rows counts as heavy."""
    found = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", min_rows=100)
    return found.select("l_returnflag", *[S.round4(F.col(p)).alias(p) for _, p in QS])


@query("e12_quantile_table", f"select lang, count(n_chars) n, {quantiles('n_chars')} from documents group by 1")
def lengths(spark, sf):
    return quantile_table(table(spark, sf, "documents"), ["lang"], "n_chars")


@query("e04_approx_distinct", "select l_returnflag flag, count(*) n, true near_suppliers, true near_parts from lineitem group by 1")
def approx_distinct(spark, sf):
    """Sketches by ship month, merged by flag: the estimates lie within the stated error of the exact counts."""
    rows = table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    kept = staged(part_sketches(rows, ["l_returnflag"], "month", ["l_suppkey", "l_partkey"]), "sketches")
    near = estimates(merge_sketches(kept, ["l_returnflag"]), ["l_returnflag"])
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("s"), F.count_distinct("l_partkey").alias("p"))
    both = near.join(exact, "l_returnflag")
    within = [(F.abs(F.col(f"n_{c}") - F.col(e)) <= F.col(e) * DISTINCT_ERROR + 1).alias(name) for c, e, name in (("l_suppkey", "s", "near_suppliers"), ("l_partkey", "p", "near_parts"))]
    return both.select(F.col("l_returnflag").alias("flag"), "n", *within)


@query("e12_approx_quantiles", "select l_returnflag flag, q, true near from lineitem, (values (0.1), (0.5), (0.99)) v(q) group by 1, 2".replace("q, true", "cast(q as double) q, true"))
def approx_quantiles(spark, sf):
    """Sketches by ship month, merged by flag: each quantile's true ranks lie within the stated error of the rank asked for."""
    rows = table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    kept = staged(part_sketches(rows, ["l_returnflag"], "month", values=["l_extendedprice"]), "sketches")
    qs = (0.1, 0.5, 0.99)
    near = estimates(merge_sketches(kept, ["l_returnflag"]), ["l_returnflag"], qs)
    cells = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"l_extendedprice_p{round(q * 100)}").alias("v")) for q in qs]))
    asked = near.select("l_returnflag", "n", cells.alias("c")).select("l_returnflag", "n", "c.*")
    met = rows.select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x")).join(asked, "l_returnflag")
    ranks = met.groupBy("l_returnflag", "q", "n").agg(F.count_if(F.expr("x < v")).alias("below"), F.count_if(F.expr("x <= v")).alias("upto"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    return ranks.select(F.col("l_returnflag").alias("flag"), "q", (off <= RANK_ERROR).alias("near"))


@query("e13_share_true", "select lang, avg(case when quality = 1 then 1.0::double when quality is not null then 0.0::double end) good from documents left join labels using (doc_id) group by 1")
def share_true(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(A.share_true(F.col("quality") == 1).alias("good"))


@query("e14_mean", "select source, cast(sum(n_chars) as double) / count(n_chars) mean_chars from documents group by 1")
def mean(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"))


@query("e15_value_counts", """
select 'lang' category, lang as value, count(*) n from documents group by lang union all select 'source', source, count(*) from documents group by source
union all select 'quality', coalesce(cast(quality as varchar), '<null>'), count(*) from documents left join labels using (doc_id) group by quality""")
def value_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.value_counts_long(rows, ["lang", "source", "quality"])


@query("e15_value_counts_users", sql("""
select 'endpoint' category, endpoint as value, count(*) n, count(distinct username) n_users from req group by endpoint
union all select 'error_code', coalesce(error_code, '<null>'), count(*), count(distinct username) from req group by error_code""", "req"))
def value_counts_users(spark, sf):
    return C.value_counts_long(requests(spark, sf), ["endpoint", "error_code"], "username")


@query("e16_watched_values", """
select w as value, (select count(*) from orders where o_orderstatus = w) n from unnest(['F', 'O', 'P', 'X', 'Y']) t(w)""")
def watched(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))
    return C.with_watched(counts, "value", ("F", "O", "P", "X", "Y"), ("n",))


@query("e17_mode", "select p_brand, arg_min(p_size, (-n, p_size)) size, max(n) n from (select p_brand, p_size, count(*) n from part group by 1, 2) group by 1")
def mode(spark, sf):
    return C.mode_of(table(spark, sf, "part"), ["p_brand"], "p_size", "size")


@query("e19_constant_check", sql("""
select 'reasoning_effort' "column", count(*) filter (where count(distinct reasoning_effort) > 1) over () n_violations from req where turn_id is not null group by turn_id
union select 'tool_types', count(*) filter (where count(distinct tool_types) > 1) over () from req where turn_id is not null group by turn_id
union select 'tool_count', count(*) filter (where count(distinct tool_count) > 1) over () from req where turn_id is not null group by turn_id""", "req"))
def constant(spark, sf):
    return C.constant_violations(requests(spark, sf), "turn_id", ["reasoning_effort", "tool_types", "tool_count"])


@query("e20_slice_statistics", """
select 'prices' category, s as value, cast(round_even(case s when 'p50' then quantile_cont(o_totalprice, .5) when 'p90' then quantile_cont(o_totalprice, .9)
  when 'min' then min(o_totalprice) else max(o_totalprice) end, 0) as bigint) n from orders, unnest(['p50', 'p90', 'min', 'max']) t(s) where o_orderstatus = 'F' group by s""")
def slice_stats(spark, sf):
    filled = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return slice_statistics(filled, "o_totalprice", "prices").select("category", "value", "n")


@query("e21_distinct_union", "select count(*) n from (select l_orderkey from lineitem where l_quantity > 45 union select o_orderkey from orders where o_orderstatus = 'P')")
def distinct_union(spark, sf):
    a = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select("l_orderkey")
    b = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return a.unionByName(b).distinct().agg(F.count("*").alias("n"))


@query("e22_concentration_orders", """
with o as (select c_mktsegment, n_name, o_custkey, cast(floor(o_totalprice * 100 + 0.5) as bigint) cents from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select dimension, group_value, count(*) n_users, cast(sum(n) as bigint) n_requests, cast(sum(w) as bigint) n_tokens,
  floor(cast(max(n) as double) / sum(n) * 10000 + 0.5) / 10000 top1_user_share, floor(cast(max(w) as double) / sum(w) * 10000 + 0.5) / 10000 top1_user_token_share,
  count(*) < 10 below_min_group_size, cast(max(n) as double) / sum(n) > 0.3 dominant
from (select 'c_mktsegment' dimension, c_mktsegment group_value, o_custkey, count(*) n, sum(cents) w from o group by 2, 3
      union all select 'n_name', n_name, o_custkey, count(*), sum(cents) from o group by 2, 3) group by 1, 2""")
def concentration_orders(spark, sf):
    """Customers as users, order value in cents as weight; orders shrink per customer first."""
    from usagelens.operators.concentration import concentration

    cents = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("bigint")
    per_customer = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum(cents).alias("w")
    )
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = per_customer.join(people, "c_custkey").select("c_custkey", "n", "w", "c_mktsegment", "n_name")
    return concentration(rows, ["c_mktsegment", "n_name"], "c_custkey", weight="w", requests="n")


# Windows, sorts, limits ------------------------------------------------------------------------


@query("f01_lag_in_key", """
select conv_id, turn, length(text) - lag(length(text)) over (partition by conv_id order by turn) growth from conversations""")
def lag(spark, sf):
    from pyspark.sql import Window

    previous = F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.length("text") - previous).cast("bigint").alias("growth")
    )


COMPACTED = sql("select turn_id, n_segments, has_compaction from turn", "turn")


@query("f02_compaction_stats", COMPACTED)
def compaction(spark, sf):
    return compaction_stats(requests(spark, sf), "turn_id", "message_count", "ts_utc", "request_id")


@query("f02_compaction_stats_split", COMPACTED)
def compaction_split(spark, sf):
    """The same with every turn over 3 requests cut into pieces."""
    return compaction_stats(requests(spark, sf), "turn_id", "message_count", "ts_utc", "request_id", min_rows=3)


POSITION = sql("""
select request_id, row_number() over (partition by turn_id order by ts_utc, request_id) position from req where turn_id is not null and not usage_missing""", "req")


def _position(spark, sf, **options):
    usable = requests(spark, sf).where(~F.col("usage_missing"))
    return position_in(usable, "turn_id", "ts_utc", "request_id", **options).select("request_id", "position")


query("f03_position_in_key", POSITION)(lambda spark, sf: _position(spark, sf))
query("f03_position_in_key_split", POSITION)(lambda spark, sf: _position(spark, sf, min_rows=3))

GAPS = """
select user_id, gap gap_seconds from (select user_id, cast(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as double) / 1000000 gap from events) where gap is not null"""


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


query("f04_gaps", GAPS)(lambda spark, sf: gaps(_events(spark, sf), "user_id", "ts"))
query("f04_gaps_split", GAPS)(lambda spark, sf: gaps(_events(spark, sf), "user_id", "ts", min_rows=20))


@query("f05_cadence", f"""
select user_id, count(*) n_gaps, case when count(*) >= 3 then max(m) end median_gap,
  case when count(*) >= 3 then avg(case when gap_seconds between 0.5 * m and 2 * m then 1.0::double else 0.0::double end) end tight_share
from (select *, median(gap_seconds) over (partition by user_id) m from ({GAPS})) group by 1""")
def rhythm(spark, sf):
    return cadence(_events(spark, sf), "user_id", "ts")


@query("f06_stable_sort", "select event_id, user_id, ts from events order by user_id, ts, event_id")
def stable_sort(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id")


@query("f07_order_by_count", "select p_type, n, row_number() over (order by n desc, p_type) place from (select p_type, count(*) n from part group by 1)")
def by_count(spark, sf):
    from pyspark.sql import Window

    counts = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "p_type")).cast("bigint")
    return counts.withColumn("place", place).orderBy("place")


@query("f08_largest_row", "select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 1")
def largest(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "p_brand").limit(1)


@query("f09_account_ranking", """
select user_id, event_type, count(*) n, row_number() over (partition by user_id order by count(*) desc, event_type) place from events group by 1, 2""")
def ranking(spark, sf):
    from pyspark.sql import Window

    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("place", F.row_number().over(order).cast("bigint"))


@query("f10_head_with_annotations", """
select * from (select p_type, n, row_number() over (order by n desc, p_type) row_number from (select p_type, count(*) n from part group by 1)) where row_number <= 7
union all select '(all types)', count(*), null from part""")
def head(spark, sf):
    parts = table(spark, sf, "part")
    counts = parts.groupBy("p_type").agg(F.count("*").alias("n"))
    total = parts.agg(F.lit("(all types)").alias("p_type"), F.count("*").alias("n"))
    return C.head_with_annotations(
        counts.unionByName(total), 7, [F.desc("n"), F.col("p_type")], F.col("p_type").startswith("(")
    )


# Set operations --------------------------------------------------------------------------------


@query("g01_labelled_blocks", """
select 1 block, 'region' kind, r_name as name, cast(r_regionkey as bigint) k from region union all select 2, 'nation', n_name, n_nationkey from nation""")
def blocks(spark, sf):
    regions = table(spark, sf, "region").select(F.lit(1).alias("block"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("k"))
    nations = table(spark, sf, "nation").select(F.lit(2).alias("block"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("k"))
    return regions.unionByName(nations).orderBy("block", "name")


@query("g02_total_row", "select coalesce(o_orderstatus, '(all)') status, count(*) n from orders group by grouping sets ((o_orderstatus), ())")
def total_row(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = per.agg(F.lit("(all)").alias("status"), F.sum("n").alias("n"))
    return per.select(F.col("o_orderstatus").alias("status"), "n").unionByName(total)


@query("g03_unseen_values", sql(f"""
select distinct 'endpoint' category, endpoint as value from req where endpoint not in ({', '.join(f"'{e}'" for e in KNOWN['endpoint'][:2])})
union all select distinct 'model_family', model_family from req where model_family not in ('m-large')""", "req"))
def unseen(spark, sf):
    return C.unseen_values(requests(spark, sf), {"endpoint": KNOWN["endpoint"][:2], "model_family": ("m-large",)})


@query("g05_transposed_statistics", """
select a.statistic, a.v filled, b.v open, c.v pending from
(unpivot (select cast(count(*) as double) n, max(o_totalprice) high, min(o_totalprice) low from orders where o_orderstatus = 'F') on columns(*) into name statistic value v) a join
(unpivot (select cast(count(*) as double) n, max(o_totalprice) high, min(o_totalprice) low from orders where o_orderstatus = 'O') on columns(*) into name statistic value v) b on a.statistic = b.statistic join
(unpivot (select cast(count(*) as double) n, max(o_totalprice) high, min(o_totalprice) low from orders where o_orderstatus = 'P') on columns(*) into name statistic value v) c on a.statistic = c.statistic""")
def transposed(spark, sf):
    """Statistics as rows, three groups side by side."""
    stats = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")
    )
    long = stats.unpivot(["o_orderstatus"], ["n", "high", "low"], "statistic", "v")

    def of(status):
        return F.max(F.when(F.col("o_orderstatus") == status, F.col("v")))

    return long.groupBy("statistic").agg(of("F").alias("filled"), of("O").alias("open"), of("P").alias("pending"))
