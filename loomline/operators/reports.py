"""Report tables (P): redaction, a dictionary of tables and their files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import usage
from .shared import placed


def pseudonym(name: Column, salt: str) -> Column:
    """12 hexadecimal digits that stand for a name."""
    return F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 12)


def numbered(x: DataFrame, column: str, order: str, label: str) -> DataFrame:
    """(column, alias): distinct values numbered from 1 as they come first by order."""
    first = x.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
    return placed(first, f"{label}_names", "first", column).select(column, F.concat(F.lit(f"{label}-"), "place").alias("alias"))


def redacted(x: DataFrame) -> DataFrame:
    """Calls with projects and sessions numbered as they come first, and no prompt."""
    projects = numbered(x, "identity", "seq", "project").select("identity", F.col("alias").alias("project_alias"))
    sessions = numbered(x, "session_key", "seq", "session").select("session_key", F.col("alias").alias("session_alias"))
    out = x.join(projects, "identity", "left").join(sessions, "session_key", "left")
    out = out.withColumns({"identity": F.col("project_alias"), "project": F.col("project_alias"), "session_key": F.col("session_alias"), "session_id": F.coalesce("session_alias", F.lit(""))}).drop("project_alias", "session_alias")
    return out.withColumn("user_message", F.lit("[redacted]")) if "user_message" in x.columns else out


def report_tables(x: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report over enriched calls."""
    return {
        "summary": usage.dashboard_summary(x),
        "activity": usage.report_activity(x),
        "projects": usage.ranked(usage.by(x, "identity"), "identity"),
        "project_tools": usage.by(x, "identity", "tool"),
        "sessions": usage.session_report(x),
        "models": usage.by(x, "canonical", "tool"),
        "tools": usage.by(x, "tool"),
        "mcp_servers": usage.full_attribution(x, usage.mcp_servers(), "server"),
        "commands": usage.full_attribution(x, usage.command_heads(), "command"),
        "heat": usage.heat_levels(x),
    }


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv", report_id: str | None = None) -> str:
    """Each table in a folder of its own, under a folder named by one report id; form: csv, json or parquet."""
    report_id = report_id or uuid.uuid4().hex
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if form == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(form).save(f"{folder}/{report_id}/{name}")
    return f"{folder}/{report_id}"
