"""The metrics (M01-M20) with suppression applied, coverage and the run summary (N03-N11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import level_tables, requests, sql
from usagelens.operators.counts import top1_share
from usagelens.operators.heavy import staged
from usagelens.plans.disclosure import suppress
from usagelens.plans.metrics import METRICS, run_metric
from usagelens.plans.levels import build_concentration, build_thread, build_turn, build_user
from usagelens.plans.metrics.anomalies import anomaly_facts, anomaly_owners, flagged_requests
from usagelens.plans.metrics.model import MetricResult, MetricSpec
from usagelens.plans.metrics.runner import run_metrics
from usagelens.plans.metrics.volumes import orphan_profile
from usagelens.sources.paths import scratch_dir

QS = ((".1", "p10"), (".25", "p25"), (".5", "p50"), (".75", "p75"), (".9", "p90"), (".99", "p99"))
EXEMPT = "'exempt by policy: this dimension groups requests, not people' suppression_reason"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def part(n: str, total: str) -> str:
    return r4(f"cast({n} as double) / ({total})")


def quantiles(value: str) -> str:
    cells = [f"{r4(f'quantile_cont(cast({value} as double), {q})')} {p}" for q, p in QS]
    return ", ".join(cells) + f", {r4(f'max(cast({value} as double))')} max"


def register(name: str, metric: str, oracle: str) -> None:
    def run(spark, sf):
        tables = level_tables(spark, sf)
        return run_metric(METRICS[metric], tables, tables["rules"]).data

    query(name, oracle)(run)


SHAPE = "concat_ws('|', coalesce(text_format_name, '<null>'), cast(message_count as varchar), cast(user_message_count as varchar), cast(assistant_message_count as varchar))"
ORPHANS = f"""
select count(*) n_requests, count(distinct thread_id) n_threads, count(distinct username) n_users,
  string_agg(distinct endpoint, ',' order by endpoint) endpoints,
  string_agg(distinct cast(status_code as varchar), ',' order by cast(status_code as varchar)) statuses,
  string_agg(distinct text_format_name, ',' order by text_format_name) formats,
  (select count(*) from req where turn_id is not null and {SHAPE} in (select {SHAPE} from req where client_type = 'codex' and turn_id is null)) n_same_shape_with_turn
from req where client_type = 'codex' and turn_id is null"""

register("m01_dataset_scale", "dataset_scale", sql(f"""
select 'n_requests' item, cast(count(*) as double) value, cast(null as varchar) note from req
union all select 'n_turns', count(*), null from turn
union all select 'n_threads', count(*), null from thread
union all select 'n_users', count(*), null from usr
union all select 'n_days', count(distinct date_local), null from req
union all select 'n_columns', 89, null
union all select 'requests_on_' || date_local, count(*),
  list_element(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], cast(isodow(cast(date_local as date)) as bigint)) || ' (weekday_local=' || (isodow(cast(date_local as date)) - 1) || '), ' || count(distinct username) || ' users'
  from req group by date_local
union all select 'codex requests without turn_id', n_requests, n_threads || ' threads, ' || n_users || ' users; endpoint=' || endpoints || ', status=' || statuses
  || ', text_format_name=' || formats || '; ' || n_same_shape_with_turn || ' requests of the same shape carry a turn_id' from ({ORPHANS})
union all select 'ts_first', null, cast(min(ts_local) as varchar) from req
union all select 'ts_last', null, cast(max(ts_local) as varchar) from req
""", "req", "turn", "thread", "usr"))

query("m02_orphan_profile", sql(ORPHANS, "req"))(lambda spark, sf: orphan_profile(requests(spark, sf)))

register("m03_requests_by_account_type", "requests_by_account_type", sql(f"""
select u.account_type, n_users, n_requests, n_threads, n_turns,
  case when f.reason is null then {part('n_requests', 'sum(n_requests) over ()')} end request_share,
  case when f.reason is null then {part('n_users', 'sum(n_users) over ()')} end user_share,
  coalesce('account_type: ' || f.reason, '') suppression_reason
from (select account_type, count(*) n_users, cast(sum(n_requests) as bigint) n_requests, cast(sum(n_threads) as bigint) n_threads, cast(sum(n_turns) as bigint) n_turns
      from usr group by 1) u
left join flag f on f.dimension = 'account_type' and f.group_value = u.account_type""", "usr", "flag"))

register("m04_requests_by_client_type", "requests_by_client_type", sql(f"""
select u.client_type, n_requests, n_users, n_threads, n_turns,
  case when f.reason is null then {part('n_requests', '(select count(*) from req)')} end request_share,
  coalesce('client_type: ' || f.reason, '') suppression_reason
from (select client_type, count(*) n_requests, count(distinct username) n_users, count(distinct thread_id) n_threads, count(distinct turn_id) n_turns from req group by 1) u
left join flag f on f.dimension = 'client_type' and f.group_value = u.client_type""", "req", "flag"))

register("m05_requests_by_endpoint", "requests_by_endpoint", sql(f"""
select endpoint, count(*) n_requests, count(distinct username) n_users, count(distinct thread_id) n_threads,
  {part('count(*)', '(select count(*) from req)')} request_share, {EXEMPT} from req group by endpoint""", "req"))

FAMILY = """
select model_family, count(*) n, count(distinct username) n_users,
  cast(floor(cast(count(*) as double) / (select count(model_family) from req) * 10000 + 0.5) as bigint) units
from req where model_family is not null group by 1"""
register("m06_requests_by_model_family", "requests_by_model_family", sql(f"""
select model_family, n n_requests, n_users,
  cast(units + case when row_number() over (order by n desc, model_family) = 1 then 10000 - sum(units) over () else 0 end as double) / 10000 request_share, {EXEMPT}
from ({FAMILY})
union all select '(unrecorded)', count(*), count(distinct username), null, {EXEMPT} from req where model_family is null having count(*) > 0""", "req"))

register("m07_requests_by_hour", "requests_by_hour", sql(f"""
select hour_local, count(*) n_requests, count(distinct username) n_users, {part('count(*)', '(select count(*) from req)')} request_share, {EXEMPT}
from req group by 1""", "req"))

register("m08_status_and_errors", "status_and_errors", sql("""
select 'status_code' category, cast(status_code as varchar) value, count(*) n_requests, count(distinct username) n_users from req group by status_code
union all select 'status_code', cast(w as varchar), 0, 0 from unnest([429, 402, 403]) t(w) where w not in (select status_code from req)
union all select 'error_code', coalesce(error_code, '(none)'), count(*), count(distinct username) from req where status_code >= 400 group by 2
union all select 'summary', 'success_lt_400', count(*), count(distinct username) from req where status_code < 400
union all select 'summary', 'error_4xx_5xx', count(*), count(distinct username) from req where status_code >= 400""", "req"))

register("m09_users_by_degree_and_entry_year", "users_by_degree_and_entry_year", sql(f"""
select u.degree, u.entry_year, n_users, n_requests, n_threads,
  case when d.reason is null and y.reason is null then {part('n_users', 'sum(n_users) over ()')} end user_share,
  case when d.reason is null and y.reason is null then {part('n_requests', 'sum(n_requests) over ()')} end request_share,
  concat_ws('; ', 'degree: ' || d.reason, 'entry_year: ' || y.reason) suppression_reason
from (select degree, entry_year, count(*) n_users, cast(sum(n_requests) as bigint) n_requests, cast(sum(n_threads) as bigint) n_threads
      from usr where account_type = 'student' group by 1, 2) u
left join flag d on d.dimension = 'degree' and d.group_value = u.degree
left join flag y on y.dimension = 'entry_year' and y.group_value = u.entry_year""", "usr", "flag"))

register("m10_reasoning_effort_distribution", "reasoning_effort_distribution", sql(f"""
select reasoning_effort, count(*) n_requests, count(distinct username) n_users, count(distinct turn_id) n_turns,
  {part('count(*)', 'sum(count(*)) over ()')} request_share, {EXEMPT}
from req where client_type = 'codex' and reasoning_effort is not null group by 1""", "req"))

register("m11_tool_types_distribution", "tool_types_distribution", sql(f"""
select part tool_type, count(*) n_threads, count(distinct username) n_users,
  {part('count(*)', '(select count(tool_types_union) from thread)')} declared_thread_share
from (select username, unnest(string_split(tool_types_union, ',')) part from thread) group by 1
union all select '(denominator) threads declaring tools', count(*), count(distinct username), null from thread where tool_types_union is not null
union all select '(denominator) threads without tool_types', count(*), count(distinct username), null from thread where tool_types_union is null""", "thread"))

DEPTH = ", ".join([f"{r4(f'quantile_cont(cast(n_requests as double), {q}) filter (where W)')} {p}" for q, p in QS])
DEPTH_BLOCK = f"""select cast(count(*) filter (where W) as double) n_turns, {DEPTH}, cast(max(n_requests) filter (where W) as double) max,
  {r4('avg(case when n_requests = 1 then 1.0::double else 0.0::double end) filter (where W)')} single_request_share,
  {r4('avg(n_requests) filter (where W)')} "mean (reference only)",
  cast(count(*) filter (where W and has_compaction) as double) n_turns_with_compaction from turn"""
register("m12_turn_expansion_depth", "turn_expansion_depth", sql(f"""
select a.statistic, a.v all_turns, b.v excluding_compacted
from (unpivot ({DEPTH_BLOCK.replace('W', 'true')}) on columns(*) into name statistic value v) a
join (unpivot ({DEPTH_BLOCK.replace('W', 'not has_compaction')}) on columns(*) into name statistic value v) b on a.statistic = b.statistic""", "turn"))

register("m13_thread_tool_message_ratio", "thread_tool_message_ratio", sql(f"""
select 'all threads' bucket, count(tool_message_ratio) n, {quantiles('tool_message_ratio')},
  {r4('avg(case when tool_message_ratio = 0 then 1.0::double when tool_message_ratio is not null then 0.0::double end)')} zero_ratio_share
from thread""", "thread"))

register("m14_cache_hit_by_request_position", "cache_hit_by_request_position", sql(f"""
select bucket, count(rate) n, {quantiles('rate')}, count(*) n_requests, count(distinct turn_id) n_turns,
  {r4('avg(case when rate = 0 then 1.0::double when rate is not null then 0.0::double end)')} zero_cache_share,
  (select count(*) from req where turn_id is not null and usage_missing) n_excluded_usage_missing,
  (select count(*) from req where turn_id is not null and not usage_missing and prompt_tokens <= 0) n_excluded_zero_prompt_tokens
from (select turn_id, cast(cached_tokens as double) / prompt_tokens rate,
        case row_number() over (partition by turn_id order by ts_utc, request_id) when 1 then '1st' when 2 then '2nd' else '3rd+' end bucket
      from req where turn_id is not null and not usage_missing and prompt_tokens > 0)
group by bucket""", "req"))

COLUMNS = [p for _, p in QS] + ["max"]
HIDDEN = ", ".join(f"case when f.reason is null then q.{c} end {c}" for c in COLUMNS)
register("m15_token_inflation_by_client_type", "token_inflation_by_client_type", sql(f"""
select q.client_type, q.client_type bucket, n_requests, n_users, {HIDDEN},
  (select count(*) from req where usage_missing) n_excluded_usage_missing,
  (select count(*) from req where not usage_missing and prompt_tokens - coalesce(cached_tokens, 0) <= 0) n_excluded_zero_denominator,
  coalesce('client_type: ' || f.reason, '') suppression_reason
from (select client_type, count(*) n_requests, count(distinct username) n_users, {quantiles('cast(prompt_tokens as double) / (prompt_tokens - coalesce(cached_tokens, 0))')}
      from req where not usage_missing and prompt_tokens - coalesce(cached_tokens, 0) > 0 group by 1) q
left join flag f on f.dimension = 'client_type' and f.group_value = q.client_type""", "req", "flag"))

ALL = part("count(*)", "(select count(*) from req)")
register("m16_usage_missing_impact", "usage_missing_impact", sql(f"""
with gone as (select * from req where usage_missing)
select 'summary' category, 'usage_missing total' value, count(*) n_requests, {ALL} share_of_all_requests, count(distinct username) n_users from gone
union all select 'summary', 'of which status=200 (tokens lost)', count(*), {ALL}, count(distinct username) from gone where status_code = 200
union all select 'summary', 'of which status>=400 (never reached a model)', count(*), {ALL}, count(distinct username) from gone where status_code >= 400
union all select 'endpoint', endpoint, count(*), {ALL}, null from gone group by endpoint
union all select 'status_code', cast(status_code as varchar), count(*), {ALL}, null from gone group by status_code
union all select 'stream', cast(stream as varchar), count(*), {ALL}, null from gone group by stream
union all select 'provider', provider, count(*), {ALL}, null from gone group by provider""", "req").replace("\nwith gone", ",\ngone", 1).replace(",\ngone", ", gone", 1))

register("m17_prompt_length_distribution", "prompt_length_distribution", sql(f"""
select q.client_type, n_requests, n_users, {HIDDEN},
  coalesce('client_type: ' || f.reason || '; the total row of this table is shown, so this row can be derived', '') suppression_reason
from (select client_type, count(*) n_requests, count(distinct username) n_users, {quantiles('prompt_len')} from req where prompt_len > 0 group by 1
      union all select 'all', count(*), count(distinct username), {quantiles('prompt_len')} from req where prompt_len > 0) q
left join flag f on f.dimension = 'client_type' and f.group_value = q.client_type""", "req", "flag"))


def slice_rows(column: str, name: str, where: str) -> str:
    stats = (("p50", f"quantile_cont(cast({column} as double), .5)"), ("p90", f"quantile_cont(cast({column} as double), .9)"),
             ("min", f"min({column})"), ("max", f"max({column})"))
    return " union all ".join(
        f"select '{name}' category, '{s}' value, cast(round_even({e}, 0) as bigint) n, '' note from req where {where} and {column} is not null"
        for s, e in stats
    )


HIT = "error_code = 'context_length_exceeded'"
register("m18_context_length_exceeded_profile", "context_length_exceeded_profile", sql(f"""
select 'summary' category, 'n_requests' value, count(*) n, '' note from req where {HIT}
union all select 'summary', 'n_users', count(distinct username), '' from req where {HIT}
union all select 'summary', 'n_usage_missing', count(*) filter (where usage_missing), 'usage details are empty, token columns cannot be trusted' from req where {HIT}
union all select 'model_family', coalesce(model_family, '<null>'), count(*), '' from req where {HIT} group by model_family
union all select 'error_param', coalesce(error_param, '<null>'), count(*), '' from req where {HIT} group by error_param
union all select 'endpoint', endpoint, count(*), '' from req where {HIT} group by endpoint
union all select 'client_type', client_type, count(*), '' from req where {HIT} group by client_type
union all {slice_rows('prompt_len', 'prompt_len', HIT)}
union all {slice_rows('prompt_tokens', 'prompt_tokens (not reliable)', HIT)}""", "req"))

RANGES = " union all ".join(
    f"""select 'comparable: {c}=' || {c} item, count(response_model) n, {part('count(response_model)', 'count(*)')} share,
    'group of ' || count(*) || case when count(response_model) = 0 then ', not comparable at all' else '' end note from req group by {c}"""
    for c in ("client_type", "endpoint")
)
register("m19_model_consistency", "model_consistency", sql(f"""
select 'n_requests (all)' item, count(*) n, 1.0::double share, '' note from req
union all select 'response_model present', count(response_model), {part('count(response_model)', 'count(*)')}, 'absent when there is no response summary' from req
union all select 'both present (comparable)', count(*), {ALL}, '' from cmp
union all select 'identical text', count(*) filter (where model_returned = response_model), {part('count(*) filter (where model_returned = response_model)', 'count(*)')}, 'release dates included' from cmp
union all select 'same model family', count(*) filter (where a = b), {part('count(*) filter (where a = b)', 'count(*)')}, 'release dates cut off' from cmp
union all select 'different model family', count(*) filter (where a <> b), {part('count(*) filter (where a <> b)', 'count(*)')}, 'a real substitution' from cmp
union all select 'different: ' || a || ' -> ' || b, count(*), {part('count(*)', '(select count(*) from cmp)')}, count(distinct username) || ' users' from cmp where a <> b group by a, b
union all {RANGES}""", "req").replace("\nselect 'n_requests (all)'", """, cmp as (select *, regexp_replace(model_returned, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') a, regexp_replace(response_model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') b
  from req where model_returned is not null and response_model is not null)
select 'n_requests (all)'""", 1))

SLICES = (
    ("context_length_exceeded concentrated", HIT),
    ("legacy models (gpt-4o-mini) concentrated", "model_family = 'gpt-4o-mini'"),
    ("off-peak hours (0-7) concentrated", "hour_local between 0 and 7"),
)
OWNED = " union all ".join(
    f"""select {i} ord, '{name}' anomaly, cast(sum(n) over () as bigint) slice_requests, count(*) over () slice_users, n n_requests, username owner
    from (select username, count(*) n from req where {where} group by 1) qualify row_number() over (order by n desc, username) = 1"""
    for i, (name, where) in enumerate(SLICES, 1)
)
OWNED = f"select * from ({OWNED}) where cast(n_requests as double) / slice_requests >= 0.8"

query("m20_anomaly_owners", sql(f"select anomaly, slice_requests, slice_users, n_requests from ({OWNED})", "req"))(
    lambda spark, sf: anomaly_owners(requests(spark, sf))
)


def gap_facts(where: str) -> str:
    return f"""select median(gap) median_gap, avg(case when gap between 0.5 * m and 2 * m then 1.0::double else 0.0::double end) tight_share
      from (select gap, median(gap) over () m from (select cast(epoch_us(ts_utc) - lag(epoch_us(ts_utc)) over (order by ts_utc) as double) / 1e6 gap from req where {where}) where gap is not null)"""


def first_of(c: str, where: str) -> str:
    return f"(select {c} from req where {where} and {c} is not null group by 1 order by count(*) desc, {c} limit 1)"


def facts_sql() -> str:
    """The numbers behind each listed anomaly, one row per slice."""
    me = [f"username = (select owner from own where ord = {i})" for i in (1, 2, 3)]
    mine = [f"{m} and {w}" for m, (_, w) in zip(me, SLICES)]
    whole = me
    cells = {
        "window_minutes": ("double", lambda i: f"(select cast(epoch_us(max(ts_utc)) - epoch_us(min(ts_utc)) as double) / 60e6 from req where {mine[i]})"),
        "top_prompt_len": ("bigint", lambda i: first_of("prompt_len", mine[i])),
        "n_top_prompt_len": ("bigint", lambda i: f"(select max(n) from (select count(*) n from req where {mine[i]} group by prompt_len))"),
        "top_client_type": ("varchar", lambda i: first_of("client_type", mine[i])),
        "owner_requests": ("bigint", lambda i: f"(select count(*) from req where {whole[i]})"),
        "owner_error_share": ("double", lambda i: f"(select cast(count(*) filter (where status_code >= 400) as double) / count(*) from req where {whole[i]})"),
        "n_user_agents": ("bigint", lambda i: f"(select count(distinct user_agent) from req where {whole[i]})"),
        "top_endpoint": ("varchar", lambda i: first_of("endpoint", whole[i])),
        "top_model_family": ("varchar", lambda i: first_of("model_family", whole[i])),
        "chat_share": ("double", lambda i: f"(select cast(count(*) filter (where endpoint = '/v1/chat/completions') as double) / count(*) from req where {mine[i]})"),
        "top_agent_share": ("double", lambda i: f"(select cast(max(n) as double) / sum(n) from (select count(*) n from req where {mine[i]} group by user_agent))"),
        "owner_offpeak_share": ("double", lambda i: f"(select cast(count(*) filter (where hour_local < 8) as double) / count(*) from req where {whole[i]})"),
        "n_active_days": ("bigint", lambda i: f"(select count(distinct date_local) from req where {whole[i]})"),
        "account_type": ("varchar", lambda i: f"(select account_type from reg where username = (select owner from own where ord = {i + 1}))"),
        "n_direct": ("bigint", lambda i: "(select count(*) from req where client_type = 'direct')"),
    }
    rows = []
    for i in (1, 2, 3):
        source = mine[i - 1] if i < 3 else me[2]
        columns = ", ".join(f"cast({cell(i - 1)} as {kind}) {k}" for k, (kind, cell) in cells.items())
        rows.append(f"select o.anomaly, cast(1 as bigint) n_users, o.n_requests, slice_requests, slice_users, {part('o.n_requests', '(select count(*) from req)')} share, "
                    f"(select count(*) from req) n_total, (select min(e.ord) from own e where e.owner = o.owner and e.ord < o.ord) same_owner_as, "
                    f"g.median_gap, g.tight_share, {columns} from own o, ({gap_facts(source)}) g where o.ord = {i}")
    head = sql("", "req", "reg").rstrip()
    return f"{head}, own as ({OWNED})\n" + "\nunion all ".join(rows)


@query("m20_anomaly_profile", facts_sql())
def anomalies(spark, sf):
    """Every number of the anomaly report; the sentence made of them is covered by a unit test."""
    tables = level_tables(spark, sf)
    return anomaly_facts(tables["request"], tables["user"]).drop("_order")


@query("e21_flagged_requests", sql(f"""select count(distinct request_id) n_flagged from req where
  {' or '.join(f"(username = (select owner from ({OWNED}) where ord = {i}) and {w})" for i, (_, w) in enumerate(SLICES, 1))}""", "req"))
def flagged(spark, sf):
    return flagged_requests(requests(spark, sf)).agg(F.count("*").alias("n_flagged"))


COVERED = {
    "anomaly_profile": None,
    "cache_hit_by_request_position": ("req", "turn_id is not null", "not usage_missing and prompt_tokens > 0"),
    "context_length_exceeded_profile": ("req", "true", HIT),
    "dataset_scale": ("req", "true", "true"),
    "model_consistency": ("req", "true", "model_returned is not null and response_model is not null"),
    "prompt_length_distribution": ("req", "true", "prompt_len > 0"),
    "reasoning_effort_distribution": ("req", "client_type = 'codex'", "reasoning_effort is not null"),
    "requests_by_account_type": ("usr", "true", "account_type is not null"),
    "requests_by_client_type": ("req", "true", "client_type is not null"),
    "requests_by_endpoint": ("req", "true", "endpoint is not null"),
    "requests_by_hour": ("req", "true", "hour_local is not null"),
    "requests_by_model_family": ("req", "true", "model_family is not null"),
    "status_and_errors": ("req", "true", "status_code is not null"),
    "thread_tool_message_ratio": ("thread", "true", "tool_message_ratio is not null"),
    "token_inflation_by_client_type": ("req", "true", "not usage_missing and prompt_tokens > coalesce(cached_tokens, 0)"),
    "tool_types_distribution": ("thread", "true", "tool_types_union is not null"),
    "turn_expansion_depth": ("turn", "true", "n_requests is not null"),
    "usage_missing_impact": ("req", "true", "usage_missing"),
    "users_by_degree_and_entry_year": ("usr", "account_type = 'student'", "degree is not null"),
}


def stored_levels(spark, sf):
    """The level tables and the rules, each written once: the metrics read them again and again."""
    built = level_tables(spark, sf)
    tables = {name: staged(built[name], name) for name in ("request", "registry")}
    tables |= {"turn": staged(build_turn(tables["request"]), "turn"), "thread": staged(build_thread(tables["request"]), "thread")}
    tables["user"] = staged(build_user(tables["request"], tables["registry"]), "user")
    return tables, staged(build_concentration(tables["request"], tables["registry"]), "rules")


@query("n03_metric_coverage", sql(
    "select name, n_total, n_covered, case when n_total > 0 then " + part("n_covered", "n_total") + " else 0 end coverage from ("
    + " union all ".join(
        f"select '{m}' name, count(*) filter (where {c[1]}) n_total, count(*) filter (where ({c[1]}) and ({c[2]})) n_covered from {c[0]}"
        for m, c in COVERED.items() if c
    ) + ")", "req", "turn", "thread", "usr"))
def coverage(spark, sf):
    tables, _ = stored_levels(spark, sf)
    rows = None
    for name in sorted(METRICS):
        if COVERED[name] is None:
            continue
        one = METRICS[name].fn(tables).coverage().select(F.lit(name).alias("name"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


SEGMENTS = """
seg as (select c_mktsegment, n_name, c_custkey, count(*) n, cast(sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)) as bigint) cents
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)"""


@query("n05_suppress", f"""
with {SEGMENTS}, per as (select n_name, c_custkey, sum(n) n from seg group by 1, 2),
g as (select n_name, count(*) n_users, cast(sum(n) as bigint) n_requests, cast(max(n) as double) / sum(n) top from per group by 1)
select n_name degree, n_users, n_requests,
  case when not (n_users < 50 or top > 0.04) then {part('n_requests', 'sum(n_requests) over ()')} end request_share,
  coalesce('degree: ' || nullif(concat_ws(', ', case when n_users < 50 then 'n_users ' || n_users || ' < 50' end,
    case when top > 0.04 then 'top user ' || cast(cast(floor(floor(top * 10000 + 0.5) / 10000 * 1000 + 0.5) as bigint) // 10 as varchar) || '.'
      || cast(cast(floor(floor(top * 10000 + 0.5) / 10000 * 1000 + 0.5) as bigint) % 10 as varchar) || '% > 4%' end), ''), '') suppression_reason
from g""")
def suppress_orders(spark, sf):
    """Suppression on other data: customers as users, nations as groups, with other thresholds."""
    shown, _ = _order_suppression(spark, sf)
    return shown


def _order_suppression(spark, sf):
    from catalog.views import table
    from usagelens.operators.concentration import concentration
    from usagelens.operators.counts import with_share

    orders = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("degree"))
    )
    rules = concentration(orders, ["degree"], "c_custkey", min_group=50, dominant=0.04)
    report = with_share(
        rules.select(F.col("group_value").alias("degree"), "n_users", "n_requests"), "n_requests", "request_share"
    )
    return suppress(report, ["degree"], None, rules, min_group=50, dominant=0.04)


@query("n08_suppressed_groups", f"""
with {SEGMENTS}, per as (select n_name, c_custkey, sum(n) n from seg group by 1, 2),
g as (select n_name, count(*) n_users, cast(sum(n) as bigint) n_requests, cast(max(n) as double) / sum(n) top from per group by 1)
select 'degree' dimension, n_name group_value, 'request_share' suppressed_columns,
  concat_ws(', ', case when n_users < 50 then 'n_users ' || n_users || ' < 50' end,
    case when top > 0.04 then 'top user ' || cast(cast(floor(floor(top * 10000 + 0.5) / 10000 * 1000 + 0.5) as bigint) // 10 as varchar) || '.'
      || cast(cast(floor(floor(top * 10000 + 0.5) / 10000 * 1000 + 0.5) as bigint) % 10 as varchar) || '% > 4%' end) reason
from g where n_users < 50 or top > 0.04""")
def suppressed_orders(spark, sf):
    _, listed = _order_suppression(spark, sf)
    return listed


def _listed(metric: str):
    def run(spark, sf):
        tables = level_tables(spark, sf)
        return run_metric(METRICS[metric], tables, tables["rules"]).suppressed

    return run


query("n06_suppression_reasons", sql("""
select 'degree' dimension, group_value, reason, 'user_share,request_share' suppressed_columns from flag
where dimension = 'degree' and group_value in (select degree from usr where account_type = 'student')
union all select 'entry_year', group_value, reason, 'user_share,request_share' from flag
where dimension = 'entry_year' and group_value in (select entry_year from usr where account_type = 'student')""", "usr", "flag"))(
    _listed("users_by_degree_and_entry_year")
)

query("n07_total_row_note", sql("""
select client_type, coalesce('client_type: ' || reason || '; the total row of this table is shown, so this row can be derived', '') suppression_reason
from (select distinct client_type from req where prompt_len > 0 union all select 'all') c
left join flag on dimension = 'client_type' and group_value = client_type""", "req", "flag"))(
    lambda spark, sf: _shown(spark, sf).select("client_type", "suppression_reason")
)


def _shown(spark, sf):
    tables = level_tables(spark, sf)
    return run_metric(METRICS["prompt_length_distribution"], tables, tables["rules"]).data


@query("n11_run_metrics")
def summary(spark, sf):
    """Runs every metric and writes it; the summary names the folder-independent outcome."""
    tables, rules = stored_levels(spark, sf)
    return run_metrics(tables, rules, scratch_dir(spark, "metrics"), "run-1")


@query("n11_run_summary", sql(
    "select name, n_total, n_covered, case when n_total > 0 then " + part("n_covered", "n_total") + " else 0 end coverage, 'success' status from ("
    + " union all ".join(
        f"select '{m}' name, count(*) filter (where {c[1]}) n_total, count(*) filter (where ({c[1]}) and ({c[2]})) n_covered from {c[0]}"
        for m, c in COVERED.items() if c
    ) + ") union all select 'stuck', null, null, null, 'failed'", "req", "turn", "thread", "usr"))
def isolated(spark, sf):
    """The stable columns of a run over stored levels in which one metric never ends and is cancelled alone."""
    tables, rules = stored_levels(spark, sf)

    def endless(t):
        never = spark.range(10**16).where(F.xxhash64("id") == 7)
        return MetricResult(never, t["request"].agg(F.count("*").alias("n_total"), F.count("*").alias("n_covered")))

    stuck = MetricSpec("stuck", "?", "request", "request", "-", endless)
    specs = {m: METRICS[m] for m, c in COVERED.items() if c}
    folder = scratch_dir(spark, "metrics")
    late = run_metrics(tables, rules, folder, "stuck", specs={"stuck": stuck}, limit=2.0)
    done = run_metrics(tables, rules, folder, "all", specs=specs)
    return done.unionByName(late).select("name", "n_total", "n_covered", "coverage", "status")


@query("e18_top1_share", sql("""
select endpoint, cast(sum(n) as bigint) n, count(*) n_users, arg_min(username, (-n, username)) top_user, max(n) top_n,
  cast(max(n) as double) / sum(n) top_share
from (select endpoint, username, count(*) n from req group by 1, 2) group by 1""", "req"))
def top1(spark, sf):
    return top1_share(requests(spark, sf), ["endpoint"], "username")
