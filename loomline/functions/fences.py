"""Code fences, language names and epoch times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of languages.
LANGUAGE_NAMES = {
    "": "unknown", "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "md": "markdown", "mdx": "markdown", "yml": "yaml", "sh": "shell", "bash": "shell", "zsh": "shell", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "c++": "cpp", "h": "c", "cs": "csharp", "golang": "go",
}
FENCE = r"(?m)^[^\S\n]*```[^\n]*"
_JAVA_FENCE = FENCE.replace("(?m)", "(?dm)")  # lines end at \n only


def language_name(tag: Column) -> Column:
    """A tag or file ending as one name; null and empty are unknown."""
    key = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    names = F.create_map(*[F.lit(v) for pair in LANGUAGE_NAMES.items() for v in pair])
    return F.coalesce(names[key], key)


def file_language(path: Column) -> Column:
    """The language of a path by its ending."""
    return language_name(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def code_fences(text: Column) -> Column:
    """(language, loc) of each fenced block with a line, an open last one included; null text: none.

    Fences cut the text into parts that lie outside and inside by turns, so no line is looked at twice.
    """
    fences, parts = F.regexp_extract_all(text, F.lit(_JAVA_FENCE), F.lit(0)), F.split(text, _JAVA_FENCE + r"\n?", -1)
    inside = F.filter(parts, lambda _, i: i % 2 == 1)
    tags = F.filter(fences, lambda _, i: i % 2 == 0)
    lines = lambda p: (F.length(p) - F.length(F.replace(p, F.lit("\n"))) + F.when((p != "") & ~p.endswith("\n"), 1).otherwise(0)).cast("long")
    blocks = F.zip_with(tags, inside, lambda t, p: F.struct(language_name(F.regexp_extract(t, r"```\s*(\S*)", 1)).alias("language"), lines(p).alias("loc")))
    return F.coalesce(F.filter(blocks, lambda b: b["loc"] > 0), F.array().cast("array<struct<language:string,loc:bigint>>"))


def epoch_time(raw: Column) -> Column:
    """Seconds, milliseconds or nanoseconds since 1970, told apart by size."""
    # whole-number division: a double can't hold nanoseconds
    millis = F.when(raw > 1_000_000_000_000_000, (raw - raw % 1_000_000) / F.lit(1_000_000).cast("decimal(20,0)")).when(raw > 100_000_000_000, raw).otherwise(raw * 1000)
    return F.timestamp_millis(millis.cast("long"))
