"""Limit states that tools and accounts leave as JSON documents (S43-S46), as rows of one schema.

files: (path, value, modified) with whole documents. Documents that can't be read, and windows
that are placeholders, give no row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "struct<used_percent:double,minutes:bigint,resets_at:timestamp>"
CREDITS = "struct<has_credits:boolean,unlimited:boolean,balance:double,total:double,additional_usage:boolean>"
LIMITS = f"tool string, limit_id string, limit_name string, plan_type string, observed_at timestamp, primary {WINDOW}, secondary {WINDOW}, credits {CREDITS}, reached string, path string"
FIVE_HOURS, WEEK, MONTH = 300, 10_080, 43_200
# Plans by what an account buys, and by name; when credits took the place of requests.
PLANS_BY_SKU = {
    "free_limited_copilot": "copilot_free", "free_educational_quota": "copilot_free", "monthly_subscriber_quota": "copilot_pro", "plus_monthly_subscriber_quota": "copilot_pro_plus", "copilot_standalone_seat_quota": "copilot_business",
    "copilot_business_seat": "copilot_business", "copilot_enterprise_seat_quota": "copilot_enterprise", "copilot_enterprise_seat": "copilot_enterprise",
}
PLANS = {"business": "copilot_business", "enterprise": "copilot_enterprise", "individual_max": "copilot_pro_plus", "individual_edu": "copilot_education"}
CREDITS_FROM = datetime(2026, 6, 1)


def _named(names: dict[str, str], name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[name]


def _window(used: Column, minutes: Column | int, resets: Column) -> Column:
    return F.struct(used.cast("double").alias("used_percent"), (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long").alias("minutes"), resets.cast("timestamp").alias("resets_at"))


def _credits(has: Column, unlimited: Column, balance: Column, total: Column | None = None, more: Column | None = None) -> Column:
    return F.struct(has.alias("has_credits"), unlimited.alias("unlimited"), balance.cast("double").alias("balance"), (F.lit(None) if total is None else total).cast("double").alias("total"), (F.lit(None) if more is None else more).cast("boolean").alias("additional_usage"))


def _percent(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def _zoned(text: Column) -> Column:
    """A time with a zone; others are none."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ].*([Zz]|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text))


def as_limits(rows: DataFrame) -> DataFrame:
    """rows with all columns of LIMITS, null where a source has none."""
    fields = [f.split(" ", 1) for f in LIMITS.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


def _each(rows: DataFrame, entries: Column | str, *columns: str) -> DataFrame:
    """columns with a row for each entry; null and empty arrays give none.

    The filter stands after the explosion: one before it, which a plain explode infers, would read every document again and make its entries several times.
    """
    return rows.select(*columns, F.explode_outer(entries).alias("x")).where(F.col("x").isNotNull()).select(*columns, "x.*")


def _documents(files: DataFrame, payload: str, schema: str, more: str = "") -> DataFrame:
    """Documents that are what payload names themselves, or wrap it with the time of their observation."""
    wrapped = F.from_json("value", f"struct<observed_at:string,{more}{payload}:{schema}>")
    rows = files.withColumn("w", wrapped).withColumn("bare", F.from_json("value", schema))
    return rows.select("path", "w", F.coalesce(F.col(f"w.{payload}"), F.col("bare")).alias("u"), F.when(F.col(f"w.{payload}").isNotNull(), F.coalesce(_zoned(F.col("w.observed_at")), F.col("modified"))).otherwise(F.col("modified")).alias("observed_at"))


def claude_status_limits(files: DataFrame) -> DataFrame:
    """The windows of five hours and seven days that a status line was given."""
    part = "struct<used_percentage:double,resets_at:bigint>"
    rows = files.withColumn("r", F.from_json("value", f"struct<rate_limits:struct<five_hour:{part},seven_day:{part}>>")["rate_limits"])
    window = lambda name, minutes: F.when(F.col(f"r.{name}.used_percentage").isNotNull(), _window(F.col(f"r.{name}.used_percentage"), minutes, F.timestamp_seconds(f"r.{name}.resets_at")))
    rows = rows.select("path", F.col("modified").alias("observed_at"), window("five_hour", FIVE_HOURS).alias("primary"), window("seven_day", WEEK).alias("secondary")).where("primary is not null or secondary is not null")
    return as_limits(rows.withColumns({"tool": F.lit("claude-code"), "limit_id": F.lit("claude-code")}))


def claude_subscription_limits(files: DataFrame) -> DataFrame:
    """An account's windows in one row, those of single models and extra usage in rows of their own."""
    part = "struct<utilization:double,resets_at:string>"
    usage = "struct<" + ",".join(f"{n}:{part}" for n in ("five_hour", "seven_day", "seven_day_opus", "seven_day_sonnet")) + ">"
    extra = "overage:struct<is_enabled:boolean,monthly_limit:bigint,monthly_credit_limit:bigint,used_credits:double,out_of_credits:boolean>,"
    rows = _documents(files, "usage", usage, extra)

    def window(name: str, minutes: int) -> Column:
        used, resets = F.coalesce(F.col(f"u.{name}.utilization"), F.lit(0.0)), _zoned(F.col(f"u.{name}.resets_at"))
        return F.when(F.col(f"u.{name}").isNotNull() & ((used != 0) | resets.isNotNull()), _window(_percent(used), minutes, resets))

    none_w, none_c, text = F.lit(None).cast(WINDOW), F.lit(None).cast(CREDITS), F.lit(None).cast("string")
    row = lambda i, name, first, second=none_w, credits=none_c, reached=text: F.struct(F.lit(i).alias("limit_id"), F.lit(name).cast("string").alias("limit_name"), first.alias("primary"), second.alias("secondary"), credits.alias("credits"), reached.alias("reached"))
    five, seven = window("five_hour", FIVE_HOURS), window("seven_day", WEEK)
    o = lambda n: F.col(f"w.overage.{n}")
    limit, used = F.coalesce(o("monthly_limit"), o("monthly_credit_limit")), F.coalesce(o("used_credits"), F.lit(0.0))
    balance = F.when(limit > 0, F.greatest(limit - used, F.lit(0.0)) / 100.0)
    extra_row = row("extra_usage", "Extra Usage", _window(F.when(limit > 0, _percent(used / limit * 100.0)).otherwise(0.0), MONTH, F.lit(None)), credits=_credits(F.coalesce(o("is_enabled"), limit > 0, F.lit(False)), F.lit(False), balance), reached=F.when(o("out_of_credits"), "out_of_credits"))
    every = F.array(
        F.when(five.isNotNull() | seven.isNotNull(), row("claude-code", None, five, seven)), *[F.when(window(f"seven_day_{m}", WEEK).isNotNull(), row(f"seven_day_{m}", m.capitalize(), window(f"seven_day_{m}", WEEK))) for m in ("opus", "sonnet")], F.when(F.col("w.overage").isNotNull() & F.col("w.usage").isNotNull(), extra_row)
    )
    return as_limits(_each(rows, F.array_compact(every), "path", "observed_at").withColumn("tool", F.lit("claude-code")))


def codex_subscription_limits(files: DataFrame, now: datetime) -> DataFrame:
    """An account's two windows in one row, and its credits, if there are any or they are used up. A reset that is so many seconds away counts from now."""
    part = "struct<used_percent:double,limit_window_seconds:bigint,reset_after_seconds:bigint,reset_at:bigint>"
    usage = f"struct<plan_type:string,rate_limit:struct<primary_window:{part},secondary_window:{part},limit_reached:boolean>,credits:struct<has_credits:boolean,unlimited:boolean,overage_limit_reached:boolean,balance:string>,spend_control:struct<reached:boolean>>"
    rows = _documents(files, "usage", usage)

    def window(name: str, minutes: int) -> Column:
        w = lambda n: F.col(f"u.rate_limit.{name}.{n}")
        later = F.when(w("reset_after_seconds") > 0, F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + w("reset_after_seconds")))
        used, resets = F.coalesce(w("used_percent"), F.lit(0.0)), F.coalesce(F.timestamp_seconds(w("reset_at")), later)
        length = F.when(w("limit_window_seconds") > 0, F.floor(w("limit_window_seconds") / 60)).otherwise(minutes)
        return F.when(F.col(f"u.rate_limit.{name}").isNotNull() & ((used != 0) | resets.isNotNull()), _window(_percent(used), length, resets))

    first, second = window("primary_window", FIVE_HOURS), window("secondary_window", WEEK)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    has, unlimited, balance = yes("u.credits.has_credits"), yes("u.credits.unlimited"), F.trim("u.credits.balance").try_cast("double")
    out = yes("u.credits.overage_limit_reached") | yes("u.spend_control.reached")
    none_w, none_c = F.lit(None).cast(WINDOW), F.lit(None).cast(CREDITS)
    row = lambda i, name, a, b, credits, reached: F.struct(F.lit(i).alias("limit_id"), F.lit(name).cast("string").alias("limit_name"), a.alias("primary"), b.alias("secondary"), credits.alias("credits"), reached.alias("reached"))
    every = F.array(
        F.when(first.isNotNull() | second.isNotNull(), row("codex", None, first, second, none_c, F.when(F.col("u.rate_limit.limit_reached"), "limit_reached"))),
        F.when(F.col("u.credits").isNotNull() & (has | unlimited | balance.isNotNull() | out), row("extra_usage", "Extra Usage", none_w, none_w, _credits(has, unlimited, balance), F.when(out, "out_of_credits"))),
    )
    return as_limits(_each(rows.withColumn("plan_type", F.col("u.plan_type")), F.array_compact(every), "path", "observed_at", "plan_type").withColumn("tool", F.lit("codex")))


def copilot_quota_limits(files: DataFrame) -> DataFrame:
    """A row for each quota by name; unlimited quotas without an entitlement are placeholders, and if there is nothing else and no reset, one row says that an organisation manages the seat."""
    quota = "struct<entitlement:double,percent_remaining:double,remaining:double,quota_remaining:double,unlimited:boolean,overage_permitted:boolean,timestamp_utc:string,token_based_billing:boolean>"
    usage = f"struct<copilot_plan:string,access_type_sku:string,quota_reset_date:string,quota_reset_date_utc:string,quota_snapshots:map<string,{quota}>,token_based_billing:string>"
    rows = _documents(files, "payload", usage, "host:string,login:string,")  # without quotas there are no entries
    day = lambda c: F.coalesce(_zoned(c), F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c)))
    billed = F.coalesce(F.col("u.token_based_billing").try_cast("boolean"), F.get_json_object("u.token_based_billing", "$.enabled").try_cast("boolean"))
    plan = F.coalesce(_named(PLANS_BY_SKU, F.coalesce("u.access_type_sku", F.lit(""))), _named(PLANS, F.coalesce("u.copilot_plan", F.lit(""))), F.col("u.copilot_plan"))
    rows = rows.select("path", "observed_at", F.col("w.host").alias("host"), F.col("w.login").alias("login"), plan.alias("plan_type"), F.coalesce(day(F.col("u.quota_reset_date")), day(F.col("u.quota_reset_date_utc"))).alias("resets_at"), billed.alias("billed"), F.sort_array(F.map_entries("u.quota_snapshots")).alias("all"))

    def of(entry: Column) -> Column:
        q = entry["value"]
        left = F.coalesce(q["quota_remaining"], q["remaining"])
        share = F.coalesce(q["percent_remaining"], F.when(q["entitlement"] > 0, _percent(left / q["entitlement"] * 100.0)))
        at = F.coalesce(_zoned(q["timestamp_utc"]), F.col("observed_at"))
        by_credits = F.coalesce(F.col("billed"), q["token_based_billing"], at >= F.lit(CREDITS_FROM).cast("timestamp"), F.lit(False))
        words = F.array_join(F.transform(F.filter(F.split(entry["key"], "[_-]"), lambda x: x != ""), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), " ")
        name = F.when(by_credits & (F.lower(entry["key"]) == "premium_interactions"), "AI Credits").when(words == "", "Copilot").otherwise(words)
        minutes = F.when(F.lower(entry["key"]).rlike("week|seven_day|7_day"), WEEK).otherwise(MONTH)
        has = q["entitlement"].isNotNull() | q["remaining"].isNotNull() | q["quota_remaining"].isNotNull()
        unlimited = F.coalesce(q["unlimited"], F.lit(False))
        placeholder = unlimited & (F.coalesce(q["entitlement"], F.lit(0.0)) <= 0)
        window = F.when(~placeholder & share.isNotNull(), _window(_percent(100.0 - share), minutes, F.col("resets_at")))
        return F.struct(placeholder.alias("placeholder"), entry["key"].alias("limit_id"), name.alias("limit_name"), at.alias("at"), window.alias("primary"), _credits(has, unlimited, left, q["entitlement"], q["overage_permitted"]).alias("credits"), F.when(left <= 0, "primary").alias("reached"))

    rows = rows.withColumn("all", F.transform("all", of))
    shown = F.filter("all", lambda r: r["primary"].isNotNull())
    managed = F.struct(F.lit(False).alias("placeholder"), F.lit("org_managed_credits").alias("limit_id"), F.lit("Org-managed credits").alias("limit_name"), F.col("observed_at").alias("at"), _window(F.lit(0.0), MONTH, F.lit(None)).alias("primary"), _credits(F.lit(False), F.lit(True), F.lit(None)).alias("credits"), F.lit(None).cast("string").alias("reached"))
    rows = rows.withColumn("shown", F.when((F.size(shown) == 0) & F.exists("all", lambda r: r["placeholder"]) & F.col("resets_at").isNull(), F.array(managed)).otherwise(shown))
    rows = _each(rows, "shown", "path", "host", "login", "plan_type")
    # accounts are told apart by their host and login
    account, label = F.concat_ws("/", "host", "login"), F.coalesce("login", "host")
    return as_limits(rows.withColumns({"limit_id": F.when(label.isNull(), F.col("limit_id")).otherwise(F.concat("limit_id", F.lit("@"), account)), "limit_name": F.when(label.isNull(), F.col("limit_name")).otherwise(F.concat("limit_name", F.lit(" · "), label)), "observed_at": F.col("at"), "tool": F.lit("copilot")}))
