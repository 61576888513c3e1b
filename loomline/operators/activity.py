"""What projects, sessions and setups show: activity (C13), outputs (X35), setup findings (R29), pulse (V03) and the graph's lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import project_identity
from . import practice

# Whole minutes that end a block, shares that name days and dayparts, dayparts by their first hours.
BLOCK_MINUTES, WEEKENDS, WEEKDAYS, DAYPART = 15, 0.6, 0.2, 0.4
DAYPARTS = (("mornings", 5, 11), ("afternoons", 12, 16), ("evenings", 17, 21), ("late_nights", 22, 4))
# Tokens that a finding's unit costs, and how many units make a finding.
SERVER_TOKENS, READ_TOKENS, LINE_TOKENS, LONG_FILE, REREADS, JUNK_READS, LISTED = 5 * 400, 600, 13, 200, 5, 3, 6
# Folders not worth reading.
JUNK = ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".next", ".nuxt", ".output", "coverage", ".cache", ".venv", "venv")
# Edges that each lens shows.
LENSES = {"projects": ("project_tool", "project_model"), "tools": ("project_tool", "tool_model")}


def _skey() -> Column:
    return F.concat_ws("|", F.lit("all"), F.coalesce("session_key", F.concat_ws(":", "tool", "project")))


def _projects(t: DataFrame) -> DataFrame:
    """(skey, identity): a session belongs to its first turn's project."""
    return t.groupBy("skey").agg(project_identity(F.min_by("project", "turn")).alias("identity"))


def project_activity(x: DataFrame, t: DataFrame) -> DataFrame:
    """By project, turns, minutes of its sessions' blocks (1 at least each), what days and what daypart; x: calls, t: their practice_turns."""
    minute = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60)
    # a session's minutes, not its calls, are put in order
    minutes = x.where("timestamp_quality = 'exact' and timestamp is not null").select(_skey().alias("skey"), minute.alias("minute")).distinct()
    order = Window.partitionBy("skey").orderBy("minute")
    new = F.coalesce(F.col("minute") - F.lag("minute").over(order) > BLOCK_MINUTES, F.lit(True)).cast("long")
    blocks = minutes.withColumn("new", new).withColumn("block", F.sum("new").over(order)).groupBy("skey", "block").agg(F.greatest(F.max("minute") - F.min("minute"), F.lit(1)).alias("minutes"))
    active = blocks.groupBy("skey").agg(F.sum("minutes").alias("minutes"))
    hour, timed = F.hour("start_at"), F.col("start_at").isNotNull()
    part = lambda first, last: hour.between(first, last) if first < last else ~hour.between(last + 1, first - 1)
    of_session = t.groupBy("skey").agg(
        project_identity(F.min_by("project", "turn")).alias("identity"), F.count("*").alias("turns"), F.count_if(timed).alias("timed"), F.count_if(timed & (F.weekday("start_at") >= 5)).alias("weekend"), *[F.count_if(timed & part(a, b)).alias(n) for n, a, b in DAYPARTS]
    )
    sums = of_session.join(active, "skey", "left").groupBy("identity").agg(*[F.sum(c).alias(c) for c in ("turns", "timed", "weekend", *[n for n, _, _ in DAYPARTS])], F.coalesce(F.sum("minutes"), F.lit(0)).alias("active_minutes"))
    share = F.try_divide("weekend", "timed")
    days = F.when(F.col("timed") == 0, "").when(share >= WEEKENDS, "mostly_weekends").when(share <= WEEKDAYS, "mostly_weekdays").otherwise("mixed_days")
    # of equal dayparts the later one
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("n"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, _, _) in enumerate(DAYPARTS)]))
    time = F.when(F.coalesce(F.try_divide(best["n"], F.col("timed")), F.lit(0.0)) >= DAYPART, best["name"]).otherwise("")
    return sums.select("identity", "turns", "active_minutes", days.alias("days"), time.alias("time"))


def display_file(project: Column, file: Column) -> Column:
    """A path inside its project, or the last two parts of an absolute one, or the path as it is."""
    root = F.regexp_replace(project, "/+$", "")
    inside = F.when((root != "") & file.startswith(root), F.regexp_replace(F.substring(file, F.length(root) + 1, F.length(file)), "^/+", ""))
    return F.when(inside != "", inside).when(file.startswith("/"), F.regexp_extract(file, "([^/]*/)?[^/]*$", 0)).otherwise(file)


def project_outputs(x: DataFrame, t: DataFrame) -> DataFrame:
    """(identity, kind, name, amount, place): languages by lines of code and files by edits, most first."""
    rows = x.withColumn("skey", _skey()).select("skey", "project", "code_blocks", "edited_files")
    language = F.transform("code_blocks", lambda b: F.struct(F.lit("language").alias("kind"), b["language"].alias("name"), b["loc"].alias("amount")))
    file = F.transform("edited_files", lambda f: F.struct(F.lit("file").alias("kind"), display_file(F.col("project"), f).alias("name"), F.lit(1).cast("long").alias("amount")))
    made = rows.select("skey", F.explode(F.concat(language, file)).alias("o")).groupBy("skey", "o.kind", "o.name").agg(F.sum("o.amount").alias("amount"))
    sums = made.join(_projects(t), "skey").groupBy("identity", "kind", "name").agg(F.sum("amount").alias("amount"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("identity", "kind").orderBy(F.desc("amount"), "name")).cast("long"))


def session_outputs(t: DataFrame) -> DataFrame:
    """Lines of code and distinct tools by session."""
    return practice.sessions(t).select("skey", "loc", "distinct_tools")


def server_key(name: Column) -> Column:
    """X28."""
    return F.lower(F.replace(name, F.lit("-"), F.lit("_")))


def junk_part(path: Column) -> Column:
    """The first folder of JUNK in a path; null without."""
    return F.get(F.filter(F.split(path, "/"), lambda p: p.isin(*JUNK)), F.lit(0))


def _listed(names: Column) -> Column:
    """The first LISTED of sorted names."""
    return F.when(F.size(names) > LISTED, F.concat(F.array_join(F.slice(names, 1, LISTED), ", "), F.lit(", …"))).otherwise(F.array_join(names, ", "))


def setup_findings(x: DataFrame, servers: DataFrame, files: DataFrame) -> DataFrame:
    """(finding, count, detail, savings) of servers configured (name) but never called, long instruction files (path, lines), rereads and junk reads."""
    called = x.select(F.explode("tools").alias("tool")).where("startswith(tool, 'mcp__')").select(server_key(F.split("tool", "__")[1]).alias("key")).distinct()
    unused = servers.withColumn("key", server_key(F.col("name"))).join(called, "key", "left_anti").agg(F.count("*").alias("count"), _listed(F.sort_array(F.collect_list("name"))).alias("detail"))  # configured servers are few
    sessions = x.agg(F.greatest(F.count_distinct("session_key"), F.lit(1)).alias("sessions"))
    unused = unused.crossJoin(sessions).select(F.lit("unused-mcp-servers").alias("finding"), "count", "detail", (F.col("count") * SERVER_TOKENS * F.col("sessions")).alias("savings"))  # one row each
    long = files.where(F.col("lines") > LONG_FILE).agg(F.count("*").alias("count"), _listed(F.sort_array(F.collect_list(F.concat("path", F.lit(" ("), "lines", F.lit(")"))))).alias("detail"), F.coalesce(F.sum(F.col("lines") - LONG_FILE), F.lit(0)).alias("more"))
    long = long.select(F.lit("claude-md-bloat").alias("finding"), "count", "detail", (F.col("more") * LINE_TOKENS).alias("savings"))
    reads = x.select("session_key", F.explode("referenced_files").alias("file")).withColumn("junk", junk_part(F.col("file")))
    again = reads.where("junk is null and session_key is not null").groupBy("session_key", "file").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("count"))
    again = again.where(F.col("count") >= REREADS).select(F.lit("redundant-rereads").alias("finding"), "count", F.lit("").alias("detail"), (F.col("count") * READ_TOKENS).alias("savings"))
    junk = reads.where("junk is not null").agg(F.count("*").alias("count"), _listed(F.sort_array(F.collect_set("junk"))).alias("detail")).where(F.col("count") >= JUNK_READS)
    junk = junk.select(F.lit("junk-directory-reads").alias("finding"), "count", "detail", (F.col("count") * READ_TOKENS).alias("savings"))
    return unused.unionByName(long).unionByName(again).unionByName(junk).where(F.col("count") > 0)


def pulse(points: DataFrame, at: str = "day", value: str = "cost") -> DataFrame:
    """Calls of all points and most of one, the first highest point and the last point; points: a row for each time. No points, no row."""
    peak = F.max_by(F.struct(F.col(at).alias("at"), F.col(value).alias("value")), F.struct(F.col(value), -F.datediff(at, F.lit("1970-01-01"))))
    last = F.max_by(F.col(value), F.col(at))
    found = points.agg(F.count("*").alias("points"), F.sum("calls").alias("calls"), F.max("calls").alias("most"), peak.alias("peak"), F.max(at).alias("last_at"), last.alias("last_value"))
    return found.where("points > 0").select("calls", "most", F.col("peak.at").alias("peak_at"), F.col("peak.value").alias("peak_value"), "last_at", "last_value")


def lens(edges: DataFrame, view: str = "projects", metric: str = "cost", core: bool = True, mcp: bool = True) -> DataFrame:
    """The edges of a lens, strongest first, with their strength in percent of the strongest, 2 at least."""
    end = "project" if view == "projects" else "tool"
    shown = [*LENSES[view], *([f"{end}_core"] if core else []), *([f"{end}_mcp"] if mcp else [])]
    kept = edges.where(F.col("relation").isin(*shown))
    most = kept.agg(F.max(metric).alias("most"))
    rows = kept.crossJoin(F.broadcast(most)).withColumn("strength", F.greatest(F.lit(2.0), F.coalesce(F.try_divide(F.col(metric) * 100.0, F.col("most")), F.lit(0.0))))  # one row
    order = Window.partitionBy("relation", "source").orderBy(F.desc(metric), "target")
    return rows.select("relation", "source", "target", metric, F.round("strength", 6).alias("strength"), F.row_number().over(order).cast("long").alias("nth"))
