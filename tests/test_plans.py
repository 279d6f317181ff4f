"""Contract, disclosure, metrics, audit and the chained run."""

import json

import pytest
from pyspark.sql import functions as F

from catalog.contract import FILLED
from catalog.documents import as_documents, flattened
from catalog.views import level_tables
from conftest import rows
from usagelens.contract import REQUEST_FIELDS, REQUEST_SCHEMA, source_map
from usagelens.functions.scalars import classify_account, percent1, share
from usagelens.operators.counts import head_with_annotations, with_share, with_share_exact
from usagelens.plans import audit, checks, pipeline
from usagelens.plans.disclosure import EXEMPT, policy_warnings, rule_warnings, suppress
from usagelens.plans.ingest import Places
from usagelens.plans.metrics import METRICS, MetricSpec, run_metric
from usagelens.plans.metrics.runner import run_metrics
from usagelens.sources import tables as T


@pytest.fixture(scope="module")
def tables(spark, sf):
    return level_tables(spark, sf)


def complete(df):
    """Flattened documents with the required columns filled in that they leave out."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in FILLED.items()}
    return df.withColumns(filled).select(*REQUEST_SCHEMA.names)


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """Complete requests as they are read back from a file: the contract is about what landed."""
    folder = str(tmp_path_factory.mktemp("landed"))
    complete(flattened(spark, sf)).write.mode("overwrite").parquet(folder)
    return spark.read.schema(REQUEST_SCHEMA).parquet(folder)


# Contract --------------------------------------------------------------------------------------


def test_contract_declares_89_columns_once():
    assert len(REQUEST_FIELDS) == len({f.name for f in REQUEST_FIELDS}) == 89
    kinds = [f.type for f in REQUEST_FIELDS]
    assert [kinds.count(k) for k in ("string", "long", "boolean", "double")] == [46, 31, 6, 1]
    assert {c for c, _ in source_map()} <= {f.name for f in REQUEST_FIELDS}


def test_clean_requests_pass_with_warnings(landed):
    found = checks.validate(landed)
    assert {(r.column, r.warning) for r in found.collect()} <= {("originator", "unseen value")}


def test_undeclared_missing_and_mistyped_columns(landed):
    df = landed.drop("worker").withColumn("extra", F.lit(1))
    df = df.withColumn("latency_ms", F.col("latency_ms").cast("double"))
    found = {(c, k) for c, k in checks.schema_violations(df)}
    assert found == {
        ("extra", "undeclared column"), ("worker", "missing column"),
        ("latency_ms", "type is double, expected bigint"),
    }
    with pytest.raises(checks.ContractError, match="worker: missing column"):
        checks.validate(df)


def test_violations_are_counted_with_samples(landed):
    df = landed.withColumn(
        "status_code", F.when(F.col("hour_local") == 5, 99).otherwise(F.col("status_code")).cast("bigint")
    )
    n = df.where("hour_local = 5").count()
    with pytest.raises(checks.ContractError, match=f"status_code: between 100 and 599: {n}, values 99, 99, 99, in logs/"):
        checks.validate(df)


# Disclosure ------------------------------------------------------------------------------------


RULES = "dimension string, group_value string, n_users bigint, top1_user_share double, below_min_group_size boolean, dominant boolean"


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(
        [("degree", "B", 5, 0.2, True, False), ("entry_year", "09", 50, 0.61, False, True),
         ("degree", "M", 5, 0.828, True, True), ("degree", "D", 90, 0.1, False, False)], RULES,
    )


def test_each_dimension_is_judged_alone(spark, rules):
    data = spark.createDataFrame(
        [("B", "09", 5, 0.5), ("M", "12", 6, 0.3), ("D", "12", 7, 0.2)], "degree string, entry_year string, n_users int, user_share double"
    )
    shown, listed = suppress(data, ["degree", "entry_year"], None, rules)
    got = {r.degree: (r.user_share, r.n_users, r.suppression_reason) for r in shown.collect()}
    assert got == {
        "B": (None, 5, "degree: n_users 5 < 10; entry_year: top user 61.0% > 30%"),
        "M": (None, 6, "degree: n_users 5 < 10, top user 82.8% > 30%"),
        "D": (0.2, 7, ""),
    }
    assert {(r.dimension, r.group_value, r.suppressed_columns) for r in listed.collect()} == {
        ("degree", "B", "user_share"), ("degree", "M", "user_share"), ("entry_year", "09", "user_share"),
    }


def test_exempt_dimensions_say_why(spark, rules):
    data = spark.createDataFrame([("/v1", 1, 0.4)], "endpoint string, n_users int, request_share double")
    shown, listed = suppress(data, ["endpoint"], None, rules)
    assert shown.first().suppression_reason == EXEMPT and shown.first().request_share == 0.4
    assert listed.count() == 0


def test_nothing_is_skipped_silently(rules):
    assert policy_warnings(["degree", "n"], ["degree"], None) == ["grouped, but no ratio column was found: nothing is suppressed"]
    assert policy_warnings(["degree", "n"], ["degree"], []) == []
    assert "not in the output" in policy_warnings(["a_share"], ["degree"], None)[0]
    assert "no n_users" in policy_warnings(["endpoint", "a_share"], ["endpoint"], None)[0]
    assert rule_warnings(None, ["degree"], ["degree"]) == ["dimension degree has no suppression rules: not suppressed"]
    assert rule_warnings(rules, ["degree"], ["degree"]) == []
    assert len(rule_warnings(rules, ["dept_code"], ["dept_code"])) == 1


def test_total_row_note_only_on_suppressed_rows(tables):
    got = run_metric(METRICS["prompt_length_distribution"], tables, tables["rules"]).data.collect()
    noted = [r for r in got if "can be derived" in r.suppression_reason]
    assert noted and all(r.p50 is None for r in noted)
    assert all(r.p50 is not None for r in got if r not in noted)


# Metrics ---------------------------------------------------------------------------------------


def test_there_are_19_metrics():
    assert len(METRICS) == 19
    assert sum(bool(s.group_by) for s in METRICS.values()) == 9


def test_metric_names_and_units_are_checked():
    with pytest.raises(ValueError, match="snake_case"):
        MetricSpec("Bad Name", "", "request", "request", "", lambda t: None)
    with pytest.raises(ValueError, match="unit"):
        MetricSpec("fine", "", "session", "request", "", lambda t: None)


def test_blocks_add_up(tables):
    def data(name):
        return rows(run_metric(METRICS[name], tables, tables["rules"]).data)

    total = tables["request"].count()
    status = data("status_and_errors")
    summary = {r["value"]: r["n_requests"] for r in status if r["category"] == "summary"}
    assert sum(summary.values()) == total
    assert sum(r["n_requests"] for r in status if r["category"] == "error_code") == summary["error_4xx_5xx"]
    assert sum(r["n_requests"] for r in status if r["category"] == "status_code") == total
    family = data("requests_by_model_family")
    assert sum(r["n_requests"] for r in family) == total
    assert sum(round((r["request_share"] or 0) * 10000) for r in family) == 10000
    assert family[-1]["model_family"] == "(unrecorded)" and family[-1]["request_share"] is None
    missing = data("usage_missing_impact")
    for category in ("endpoint", "status_code", "stream", "provider"):
        assert sum(r["n_requests"] for r in missing if r["category"] == category) == missing[0]["n_requests"]
    scale = {r["item"]: r for r in data("dataset_scale")}
    assert sum(r["value"] for i, r in scale.items() if i.startswith("requests_on_")) == total
    assert scale["n_columns"]["value"] == 89


def test_published_shares_follow_from_their_counts(spark):
    """Shares to four decimals from counts, as published for 9,937 requests."""
    counts = [("codex", 7115, 0.716), ("direct", 2822, 0.284)]
    df = spark.createDataFrame([c[:2] for c in counts], "k string, n bigint")
    got = {r.k: r.s for r in with_share(df, "n", "s").collect()}
    assert got == {k: s for k, _, s in counts}
    third = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n bigint")
    exact = {r.k: r.s for r in with_share_exact(third, "n", "k", "s").collect()}
    assert exact == {"a": 0.3334, "b": 0.3333, "c": 0.3333}
    [zero] = spark.range(1).select(share(F.lit(0), F.lit(0)).alias("s"), percent1(F.lit(0.61)).alias("p")).collect()
    assert (zero.s, zero.p) == (None, "61.0")


def test_anomalies_are_described_without_names(tables):
    got = rows(run_metric(METRICS["anomaly_profile"], tables, tables["rules"]).data)
    assert [r["anomaly"].split(" ")[0] for r in got] == ["context_length_exceeded", "legacy", "off-peak"]
    text = " ".join(r["description"] for r in got)
    assert "user0003" not in text and "None" not in text
    assert "80 of 89 requests with this error" in got[0]["description"]
    assert got[1]["description"].startswith("316 requests by 1 users, 100.0% by one user; the other 0 users have 0;")
    assert got[2]["description"].endswith("(same account as row 1)")
    assert "316" in str(got[2]["n_requests"]) and got[2]["n_users"] == 1


def test_no_anomaly_gives_an_empty_report(tables):
    calm = {**tables, "request": tables["request"].where("username <> 'user0003'"), "user": tables["user"]}
    result = METRICS["anomaly_profile"].fn(calm)
    assert rows(result.data) == []
    assert rows(result.counters)[0]["n_covered"] == 0


def test_one_failing_metric_does_not_stop_the_others(spark, tables, tmp_path):
    def broken(t):
        raise RuntimeError("no such thing")

    def late(t):
        from usagelens.plans.metrics.model import MetricResult

        bad = t["request"].select(F.raise_error(F.lit("only when it runs")).alias("x"))
        return MetricResult(bad, t["request"].agg(F.count("*").alias("n_total"), F.count("*").alias("n_covered")))

    specs = {
        "requests_by_hour": METRICS["requests_by_hour"],
        "broken": MetricSpec("broken", "?", "request", "request", "-", broken),
        "late": MetricSpec("late", "?", "request", "request", "-", late),
    }
    got = {r.name: r for r in run_metrics(tables, tables["rules"], str(tmp_path), "r1", specs=specs).collect()}
    assert {n: r.status for n, r in got.items()} == {"requests_by_hour": "success", "broken": "failed", "late": "failed"}
    assert "no such thing" in got["broken"].message and "only when it runs" in got["late"].message
    with pytest.raises(KeyError, match="requests_by_hour"):
        run_metrics(tables, None, str(tmp_path), "r2", ["unknown"])


def test_reports_are_the_same_on_every_run(tables):
    for name in ("requests_by_model_family", "tool_types_distribution", "status_and_errors"):
        first, second = (rows(METRICS[name].fn(tables).data) for _ in range(2))
        assert first == second


# Identity, counts ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "account, expected",
    [
        ("b1229XXX@x", ("student", "B", "12", "29")),
        ("D1327XXX@x", ("student", "D", "13", "27")),
        ("D000020XXX@x", ("staff", None, None, None)),
        ("link-7", ("service", None, None, None)),
        ("B122XXX@x", ("service", None, None, None)),
        ("", ("service", None, None, None)),
    ],
)
def test_accounts(spark, account, expected):
    got = spark.range(1).select(classify_account(F.lit(account)).alias("c")).select("c.*").first()
    assert tuple(got) == expected


def test_annotations_survive_the_cut(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("(none)", 9)], "k string, n int")
    got = head_with_annotations(df, 2, [F.desc("n")], F.col("k").startswith("("))
    assert {(r.k, r.row_number) for r in got.collect()} == {("a", 1), ("b", 2), ("(none)", None)}


# Audit -----------------------------------------------------------------------------------------


def test_audit_reports_both_directions(spark, tmp_path):
    docs = [
        {"request": {"request_id": "r1", "new": {"deep": 1}}, "usage_details": {}, "content": {"prompt": "private words"}},
        {"request": {"request_id": "r2"}, "content": {"prompt": "x" * 300, "other": None}, "note": "y" * 300},
    ]
    text = [(f"{i}.json", json.dumps(d)) for i, d in enumerate(docs)]
    raw = spark.createDataFrame(text, "source_path string, text string").withColumn("v", F.parse_json("text"))
    audit.run_audit(raw, str(tmp_path), write_all=True)
    unmapped = {r.path: r for r in spark.read.parquet(str(tmp_path / "unmapped_fields")).collect()}
    assert set(unmapped) == {"request.new.deep", "content.other", "note"}
    assert unmapped["note"].samples == "<300 characters, not shown>"
    assert unmapped["content.other"].types == "null:1"
    missing = {(r.column, r.path) for r in spark.read.parquet(str(tmp_path / "missing_sources")).collect()}
    assert ("username", "identity.username") in missing and ("request_id", "request.request_id") not in missing
    everything = {r.path: r for r in spark.read.parquet(str(tmp_path / "all_fields")).collect()}
    assert everything["content.prompt"].redacted and everything["content.prompt"].samples == ""
    assert everything["content.prompt"].mapped and not everything["note"].mapped


def test_audit_walks_to_any_depth_and_leaves_unreadable_files_out(spark, tmp_path):
    deep = {"leaf": 1}
    for i in range(19, 0, -1):
        deep = {f"k{i}": deep}
    text = [("a.json", json.dumps(deep)), ("b.json", "{cut"), ("c.json", "[1]")]
    raw = spark.createDataFrame(text, "source_path string, text string").withColumn("v", F.try_parse_json("text"))
    audit.run_audit(raw, str(tmp_path), write_all=True)
    [leaf] = spark.read.parquet(str(tmp_path / "all_fields")).collect()
    assert leaf.path == ".".join(f"k{i}" for i in range(1, 20)) + ".leaf" and leaf.share == 1.0
    assert {r.source_path for r in spark.read.parquet(str(tmp_path / "unreadable")).collect()} == {"b.json", "c.json"}
    assert spark.read.parquet(str(tmp_path / "paths")).where("is_container").count() == 19


@pytest.mark.parametrize("run_id", ["007", "1.10", "1e3", "2026-08-06T1430"])
def test_rules_are_found_whatever_the_run_id_looks_like(spark, tmp_path, rules, run_id):
    for other in ("000", run_id, "zzz"):
        T.write_run(rules.withColumn("of", F.lit(other)), str(tmp_path), other)
    runs = T.read_runs(spark, str(tmp_path))
    assert T.snapshot_id(runs, run_id) == run_id
    assert {r.of for r in T.latest_snapshot(runs, run_id).collect()} == {run_id}
    assert T.snapshot_id(runs, "") is None


def test_metrics_refuse_to_run_without_rules(spark, tmp_path, rules):
    T.write_run(rules, f"{tmp_path}/runs/concentration", "008")
    with pytest.raises(ValueError, match="no suppression rules up to run 007"):
        pipeline.metrics(spark, "requests", "levels", f"{tmp_path}/runs", "007")


# The whole chain -------------------------------------------------------------------------------


def test_run_all_from_files(spark, sf, tables, tmp_path):
    """Documents written as one file each come back as the same requests and the same reports."""
    places = Places(*[str(tmp_path / n) for n in ("raw", "requests", "manifest", "quarantine")])
    docs = as_documents(spark, sf).select("source_path", "text").limit(200).collect()
    extra = {f.sources[0]: FILLED[f.name] for f in REQUEST_FIELDS if f.name in FILLED and f.sources}
    for r in docs:
        path = tmp_path / "raw" / r.source_path
        path.parent.mkdir(parents=True, exist_ok=True)
        doc = json.loads(r.text)
        for where, value in extra.items():
            node = doc
            *heads, leaf = where.split(".")
            for h in heads:
                node = node.setdefault(h, {})
            node.setdefault(leaf, "a" if leaf in ("memory", "assistant_response") else value)
        path.write_text(json.dumps(doc))
    summary = pipeline.run_all(spark, places, str(tmp_path), "run1").collect()
    assert len(summary) == 19 and {r.status for r in summary} == {"success"}, [r for r in summary if r.status != "success"]
    ids = [r.source_path.split("/")[1][:-5] for r in docs]
    got = T.read_requests(spark, places.requests)
    expected = tables["request"].where(F.col("request_id").isin(ids))
    columns = ["request_id", "ts_local", "username", "client_type", "turn_id", "model_family", "cached_tokens",
               "usage_missing", "prompt_len", "message_count", "tool_types", "error_code"]
    assert rows(got.select(*columns), "request_id") == rows(expected.select(*columns), "request_id")
    hours = spark.read.parquet(f"{tmp_path}/runs/metrics/run_id=run1/metric=requests_by_hour")
    assert hours.agg(F.sum("n_requests")).first()[0] == len(ids)
    # A later run finds the rules of the earlier one.
    with pytest.warns(UserWarning, match="those of run run1 are used"):
        later = pipeline.metrics(spark, places.requests, f"{tmp_path}/levels", f"{tmp_path}/runs", "run2", ["requests_by_client_type"])
    assert later.first().status == "success" and "no suppression rules" not in later.first().message
