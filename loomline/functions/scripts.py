"""Calls of tools inside a script, as a column function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings and templates (an open one runs to the end), comments, a call of a tool, the key of a command, brackets; the rest is passed over.
_TOKEN = re.compile(
    r"""(?P<string>'(?:\\[\s\S]|[^'\\])*(?:'|\\?$)|"(?:\\[\s\S]|[^"\\])*(?:"|\\?$)|`(?:\\[\s\S]|[^`\\])*(?:`|\\?$))"""
    r"""|(?P<comment>//[^\n]*\n?|/\*[\s\S]*?(?:\*/|$))|(?<![A-Za-z0-9_$])tools\.(?P<tool>[A-Za-z0-9_$]+)(?=(?P<called>[ \t\n\r\f]*\()?)"""
    r"""|(?<![A-Za-z0-9_$])(?P<key>cmd)(?![A-Za-z0-9_$])(?=(?P<colon>[ \t\n\r\f]*:[ \t\n\r\f]*))|(?P<open>\()|(?P<close>\))"""
)
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t"}


def _string(literal: str) -> str | None:
    """What a literal says; None for what is no whole literal."""
    if len(literal) < 2 or literal[0] not in "'\"`" or literal[-1] != literal[0]:
        return None
    if literal[0] == '"':
        try:
            return json.loads(literal)
        except ValueError:
            return None
    return re.sub(r"\\([\s\S])", lambda m: _ESCAPED.get(m[1], m[1]), literal[1:-1])


def nested_calls(script: str) -> list[tuple[str, str | None]]:
    """(name, command) of each call tools.name(...) that ends, in order; the command is the first cmd key's string among the call's arguments.

    The script is passed over once: calls that are still open stand on a stack.
    """
    calls: list[list] = []  # name, whether a cmd key was met, command, whether it ended
    waiting, stack = None, []
    for m in _TOKEN.finditer(script):
        if m["tool"] is not None and m["called"] is not None:
            waiting = [m["tool"], False, None, False]
            calls.append(waiting)
        elif m["key"] is not None and m["colon"] is not None:
            at = m.end() + len(m["colon"])
            value = _TOKEN.match(script, at)
            said = _string(value["string"]) if value and value["string"] is not None else None
            for call in (c for c in stack if c is not None):
                if not call[1]:
                    call[1:3] = True, said
        elif m["open"]:
            stack.append(waiting)
            waiting = None
        elif m["close"] and stack and (ended := stack.pop()):
            ended[3] = True
    return [(name, command) for name, _, command, ended in calls if ended]


def nested_calls_of(script: Column) -> Column:
    """array<struct<name, command>> of nested_calls; a null script has none. Scripts go to Python in Arrow batches."""

    @F.pandas_udf("string")
    def found(scripts: pd.Series) -> pd.Series:
        return scripts.map(lambda s: None if s is None else json.dumps([{"name": n, "command": c} for n, c in nested_calls(s)]))

    return F.coalesce(F.from_json(found(script), "array<struct<name:string,command:string>>"), F.array().cast("array<struct<name:string,command:string>>"))


def added_lines(diff: Column) -> Column:
    """Lines that a unified diff adds, its heads not counted; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(diff, r"\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))), F.lit(0)).cast("long")


def lines_of(text: Column) -> Column:
    """Lines of a text, a last open one included."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")
