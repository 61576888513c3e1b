"""Limit states on small documents, each form and branch."""

import json
from datetime import datetime

import pytest

from loomline.operators import details
from loomline.sources import limit_states as limits

AT, NOW = datetime(2026, 1, 2), datetime(2026, 1, 3)


def files(spark, *docs):
    return spark.createDataFrame([(f"/f{i}", d if isinstance(d, str) or d is None else json.dumps(d), AT) for i, d in enumerate(docs)], "path string, value string, modified timestamp")


def window(w):
    return w and (w.used_percent, w.minutes, w.resets_at and w.resets_at.isoformat())


def shown(df):
    return [(r.path, r.limit_id, window(r.primary), window(r.secondary), r.reached) for r in df.orderBy("path", "limit_id").collect()]


def test_status_line(spark):
    docs = files(spark, {"rate_limits": {"five_hour": {"used_percentage": 42.5, "resets_at": 1774036800}, "seven_day": None}}, {"model": {}}, "not json", {"rate_limits": {}}, {"rate_limits": {"seven_day": {"used_percentage": 0}}}, None)
    got = limits.claude_status_limits(docs)
    assert shown(got) == [("/f0", "claude-code", (42.5, 300, "2026-03-20T20:00:00"), None, None), ("/f4", "claude-code", None, (0.0, 10080, None), None)]
    assert got.first().observed_at == AT and got.columns == [f.split(" ")[0] for f in limits.LIMITS.split(", ")]


def test_claude_subscription(spark):
    usage = {"five_hour": {"utilization": 130.0, "resets_at": "2026-01-01T00:00:00+01:00"}, "seven_day": {"utilization": 0.0, "resets_at": "soon"}, "seven_day_opus": {"utilization": 0, "resets_at": "2026-01-09T00:00:00Z"}, "seven_day_sonnet": {"utilization": None}}
    overage = {"monthly_limit": 2000, "used_credits": 500.0, "out_of_credits": True}
    docs = files(spark, {"observed_at": "2026-01-01T12:00:00Z", "usage": usage, "overage": overage}, usage, {"usage": {}, "overage": {"is_enabled": True, "monthly_credit_limit": 0}}, "[]", None)
    got = limits.claude_subscription_limits(docs)
    first, opus = (100.0, 300, "2025-12-31T23:00:00"), (0.0, 10080, "2026-01-09T00:00:00")
    assert shown(got) == [
        ("/f0", "claude-code", first, None, None), ("/f0", "extra_usage", (25.0, 43200, None), None, "out_of_credits"), ("/f0", "seven_day_opus", opus, None, None),
        ("/f1", "claude-code", first, None, None), ("/f1", "seven_day_opus", opus, None, None), ("/f2", "extra_usage", (0.0, 43200, None), None, None),
    ]
    by = {(r.path, r.limit_id): r for r in got.collect()}
    assert tuple(by["/f0", "extra_usage"].credits)[:3] == (True, False, 15.0) and tuple(by["/f2", "extra_usage"].credits)[:3] == (True, False, None)
    assert by["/f0", "claude-code"].observed_at.hour == 12 and by["/f1", "claude-code"].observed_at == AT and by["/f1", "seven_day_opus"].limit_name == "Opus"


def test_codex_subscription(spark):
    one = {"plan_type": "plus", "rate_limit": {"primary_window": {"used_percent": 17, "limit_window_seconds": 7200, "reset_after_seconds": 60}, "secondary_window": {"used_percent": 0, "reset_at": 1774036800}, "limit_reached": True}, "credits": {"has_credits": False, "balance": " 1.5 "}}
    docs = files(spark, {"usage": one}, {"rate_limit": {"primary_window": {"used_percent": 0.0, "reset_after_seconds": 0}}, "credits": {"has_credits": False}}, {"credits": {"unlimited": False, "balance": "x"}, "spend_control": {"reached": True}}, {"credits": {"balance": 2}}, "junk")
    got = limits.codex_subscription_limits(docs, NOW)
    assert shown(got) == [
        ("/f0", "codex", (17.0, 120, "2026-01-03T00:01:00"), (0.0, 10080, "2026-03-20T20:00:00"), "limit_reached"), ("/f0", "extra_usage", None, None, None), ("/f2", "extra_usage", None, None, "out_of_credits"), ("/f3", "extra_usage", None, None, None),
    ]
    assert [(r.plan_type, r.credits.balance) for r in got.where("limit_id = 'extra_usage'").orderBy("path").collect()] == [("plus", 1.5), (None, None), (None, 2.0)]


@pytest.fixture(scope="module")
def quotas(spark):
    placeholder = {"unlimited": True, "entitlement": 0}
    docs = files(
        spark,
        {"observed_at": "2026-06-02T00:00:00Z", "host": "github.com", "login": "me", "payload": {"access_type_sku": "monthly_subscriber_quota", "copilot_plan": "x", "quota_reset_date": "2026-07-01", "quota_snapshots": {"premium_interactions": {"entitlement": 300, "remaining": 75, "overage_permitted": True}, "chat": placeholder, "weekly-chat_x": {"percent_remaining": 140, "quota_remaining": 0, "remaining": 5}, "odd": {"remaining": 3}}}},
        {"copilot_plan": "individual_max", "quota_reset_date": "bad", "quota_reset_date_utc": "2026-07-01T00:00:00Z", "token_based_billing": {"enabled": False}, "quota_snapshots": {"premium_interactions": {"percent_remaining": 50, "timestamp_utc": "2026-08-01T00:00:00Z"}, "_": {"percent_remaining": 10}}},
        {"copilot_plan": "custom", "quota_snapshots": {"chat": placeholder, "completions": placeholder}}, {"quota_reset_date": "2026-07-01", "quota_snapshots": {"chat": placeholder}}, {"quota_snapshots": {}}, {"payload": {"copilot_plan": "free"}}, "junk", {"host": "ghe.example", "payload": {"token_based_billing": True, "quota_snapshots": {"premium_interactions": {"percent_remaining": 0, "unlimited": True, "entitlement": 5}}}},
    )
    return limits.copilot_quota_limits(docs)


def test_copilot_quotas(quotas):
    assert shown(quotas) == [
        ("/f0", "premium_interactions@github.com/me", (75.0, 43200, "2026-07-01T00:00:00"), None, None), ("/f0", "weekly-chat_x@github.com/me", (0.0, 10080, "2026-07-01T00:00:00"), None, "primary"),
        ("/f1", "_", (90.0, 43200, "2026-07-01T00:00:00"), None, None), ("/f1", "premium_interactions", (50.0, 43200, "2026-07-01T00:00:00"), None, None),
        ("/f2", "org_managed_credits", (0.0, 43200, None), None, None), ("/f7", "premium_interactions@ghe.example", (100.0, 43200, None), None, None),
    ]
    by = {(r.path, r.limit_id.split("@")[0]): r for r in quotas.collect()}
    one, other, managed = by["/f0", "premium_interactions"], by["/f1", "premium_interactions"], by["/f2", "org_managed_credits"]
    assert (one.limit_name, one.plan_type, tuple(one.credits)) == ("AI Credits · me", "copilot_pro", (True, False, 75.0, 300.0, True)) and by["/f0", "weekly-chat_x"].limit_name == "Weekly Chat X · me"
    assert (other.limit_name, other.plan_type, other.observed_at.month) == ("Premium Interactions", "copilot_pro_plus", 8) and by["/f1", "_"].limit_name == "Copilot"
    assert (managed.plan_type, tuple(managed.credits)[:2]) == ("custom", (False, True)) and by["/f7", "premium_interactions"].limit_name == "AI Credits · ghe.example"


def test_states_feed_the_limit_windows(spark, quotas):
    rows = quotas.selectExpr("tool", "limit_id", "0L AS seq", "cast(observed_at AS timestamp_ntz) AS observed_at", *[f"cast({w} AS struct<used_percent:double,minutes:bigint,resets_at:timestamp_ntz>) AS {w}" for w in ("primary", "secondary")])
    got = details.limit_windows(rows, datetime(2026, 6, 5)).where("limit_id like 'premium%me'").collect()
    assert [(r.kind, r.label, r.used, r.remaining, r.stale) for r in got] == [("primary", "monthly", 75, 25, False)]


def test_no_filter_reads_documents_again(spark):
    odd = files(spark, {"payload": {"quota_snapshots": {}}}, {}, "no json", None)
    for read in (limits.claude_subscription_limits, lambda f: limits.codex_subscription_limits(f, NOW), limits.copilot_quota_limits):
        found = read(odd)
        lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in lines if "Filter" in x and ("from_json" in x or "array_compact" in x or "filter(" in x or "transform(" in x)]
        assert found.count() == 0
