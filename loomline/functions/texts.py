"""Text classifiers of prompts (X) as column expressions: phrase lists, shapes and categories."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists, matched without regard to case as whole words.
CONSTRAINTS = (
    "do not", "don't", "dont", "must not", "mustn't", "never", "without", "avoid", "only", "strictly", "limit to", "at most", "at least", "no more than",
    "require", "restrict", "exclude", "ensure", "must", "shall", "should not", "shouldn't",
)
FRUSTRATION = ("wtf", "come on", "why won't", "why wont", "this is broken", "doesn't work", "doesnt work")
LOOKUPS = (
    "what's ", "what is ", "what are ", "where's ", "where is ", "where are ", "how do i ", "how do you ", "explain ", "why does ", "why is ", "why are ",
    "when should ", "when do ", "which ", "tell me about ", "define ",
)
REFINEMENTS = ("change", "fix", "modify", "update", "refactor", "wrong", "instead", "actually", "revert", "redo", "try again")
SPEC_WORDS = ("requirement", "requirements", "spec", "acceptance criteria", "user story", "user stories", "given", "when", "then", "should", "must")
FILLERS = (
    "please", "kindly", "thanks", "thank you", "basically", "essentially", "definitely", "absolutely", "simply", "very", "quite", "somewhat", "certainly",
    "actually", "literally",
)
WORK_TYPES = (
    ("bug fix", ("bug", "fix", "error", "issue", "crash", "broken", "wrong", "fail", "debug")),
    ("refactor", ("refactor", "clean up", "cleanup", "rename", "restructure", "reorganize", "simplify")),
    ("test", ("test", "spec", "coverage", "assert", "expect", "mock", "stub")),
    ("documentation", ("doc", "readme", "comment", "jsdoc", "typedoc", "explain")),
    ("devops", ("deploy", "ci", "cd", "pipeline", "docker", "kubernetes", "helm", "terraform", "infra")),
    ("styling", ("style", "css", "layout", "design", "ui", "ux", "theme", "color", "font")),
    ("configuration", ("config", "setup", "install", "init", "bootstrap", "scaffold")),
    ("performance", ("perf", "optim", "optimize", "optimise", "speed", "cache", "memory", "benchmark")),
    ("security", ("security", "auth", "permission", "encrypt", "token", "oauth", "cors")),
    ("migration", ("migration", "migrate", "upgrade", "update", "version", "deprecate", "deprecated")),
)
#: A line that looks like part of a specification: a bullet, a heading or a numbered item.
SPEC_LINE = r"(^|\n)[ \t]*([-*] |#|[0-9]+[.)])"


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A pattern that finds any of the phrases between characters other than ASCII letters, digits, ' and _."""
    return "(^|[^a-z0-9'_])(" + "|".join(phrases) + ")([^a-z0-9'_]|$)"


def has_phrase(lowered: Column, phrases: Iterable[str]) -> Column:
    """What phrase_pattern finds in a lowered text.

    A phrase is sought as plain bytes before a pattern judges its neighbours, and that pattern begins with the phrase: phrase_pattern tries every character.
    """
    found = lambda p: lowered.contains(p) & lowered.rlike(f"{p}(?<![a-z0-9'_]{p})(?![a-z0-9'_])")
    return reduce(lambda a, b: a | b, map(found, phrases))


def phrase_hits(lowered: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur."""
    return sum((has_phrase(lowered, [p]).cast("long") for p in phrases), F.lit(0).cast("long"))


def has_constraint(lowered: Column) -> Column:
    """Over the first 500 characters, lowered."""
    return has_phrase(lowered, CONSTRAINTS)


def is_frustrated(text: Column, lowered: Column) -> Column:
    """X12."""
    return text.contains("!!!") | text.contains("???") | has_phrase(lowered, FRUSTRATION)


def is_lookup(lowered: Column) -> Column:
    """Opens like a question that looks something up."""
    return lowered.rlike(r"^\s*(" + "|".join(LOOKUPS) + ")")


def has_refinement(lowered: Column) -> Column:
    """X16."""
    return has_phrase(lowered, REFINEMENTS)


def looks_like_spec(text: Column, lowered: Column) -> Column:
    """A list, a heading, four lines or more, or words of a specification."""
    lines = F.regexp_count(F.regexp_replace(text, r"\n$", ""), F.lit(r"\n")) + 1
    return text.rlike(SPEC_LINE) | (lines >= 4) | has_phrase(lowered, SPEC_WORDS)


def work_type(lowered: Column) -> Column:
    """The first type with a phrase in the first 300 characters, lowered, else feature."""
    out = None
    for name, phrases in WORK_TYPES:
        hit = has_phrase(lowered, phrases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("feature")


def elapsed_ms(ts: Column, since: Column) -> Column:
    """Milliseconds between the two, null unless over 0 and under two hours."""
    gap = F.unix_millis(ts) - F.unix_millis(since)
    return F.when((gap > 0) & (gap < 7_200_000), gap)


def split_commands(command: Column) -> Column:
    """Parts between unquoted &&, ||, ; and |; a single & doesn't split, an unclosed quote runs on to the end."""
    text = F.regexp_replace(command, r"\s+$", "")
    piece = r"""(?:[^'"\\;&|]|\\[\s\S]?|'[^']*(?:'|$)|"(?:[^"\\]|\\[\s\S])*(?:"|$)|(?<!&)&(?!&))+"""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({piece})"), 1), lambda c: F.trim(c)), lambda c: c != "")


def clean(text: Column) -> Column:
    """Control characters and runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Cntrl}]+", " "))


def snippet(text: Column, n: int) -> Column:
    """Clean text of at most n characters, the last an ellipsis if cut."""
    short = clean(text)
    return F.when(F.length(short) > n, F.concat(F.left(short, F.lit(n - 1)), F.lit("…"))).otherwise(short)


def caps_word_ratio(text: Column, min_length: int = 3) -> Column:
    """X11: share of words without a small ASCII letter, and with a capital one, among the longer words of the first 2,000 characters."""
    head = F.left(text, F.lit(2000))
    words = F.regexp_count(head, F.lit(rf"\S{{{min_length},}}"))
    loud = F.regexp_count(head, F.lit(rf"(?<!\S)(?=\S*[A-Z])[^\sa-z]{{{min_length},}}(?!\S)"))
    # counted only in a text that has a capital letter
    return F.when(text.rlike("[A-Z]"), F.coalesce(F.try_divide(loud, words), F.lit(0.0))).otherwise(0.0)
