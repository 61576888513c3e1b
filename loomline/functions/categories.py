"""The task category of a call, as a column expression over its tools, commands and prompt."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order, tool names and phrases, the latter matched in lower case as whole words.
CATEGORIES = ("coding", "debugging", "feature", "refactoring", "testing", "exploration", "planning", "delegation", "git", "build_deploy", "brainstorming", "conversation", "general")
EDIT_TOOLS, READ_TOOLS, BASH_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "Delete"), ("Read", "Grep", "Glob", "LS"), ("Bash", "BashOutput", "Shell")
PLAN_TOOLS, AGENT_TOOLS, SEARCH_TOOLS = ("EnterPlanMode", "ExitPlanMode"), ("Agent", "Task"), ("WebSearch", "WebFetch", "ToolSearch")
TASK_TOOLS = ("TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskOutput", "TaskStop", "TodoWrite")
DEBUG = ("fix", "bug", "error", "broken", "failing", "fails", "crash", "debug", "issue", "wrong", "exception", "traceback", "regression", "404", "500", "401", "403")
FEATURE = ("add", "create", "implement", "new", "build", "feature", "support", "introduce")
REFACTOR = ("refactor", "rename", "simplify", "restructure", "clean up", "cleanup", "reorganize", "extract", "dedupe")
TEST = ("test", "tests", "testing", "unit test", "coverage")
RESEARCH = ("how does", "what is", "why does", "explain", "understand", "investigate", "research", "compare", "look at")
BRAINSTORM = ("brainstorm", "what if", "design", "idea", "ideas", "approach", "trade-off", "tradeoff", "options")
TEST_RUNNERS = ("pytest", "vitest", "jest", "rspec", "phpunit", "gotest", "tox", "cargo test", "npm test", "go test")
GIT = ("git commit", "git push", "git merge", "git rebase", "git pull", "git checkout", "git tag", "gh pr", "gh release")
BUILD = ("npm run build", "npm install", "pnpm install", "pip install", "brew install", "cargo build", "cargo install", "docker", "make", "deploy", "pm2")


def phrase_position(text: Column, phrases: Iterable[str]) -> Column:
    """Where the first of the phrases stands between characters that aren't letters or digits, from 1; 0 if nowhere."""
    return F.regexp_instr(text, F.lit(r"(?<![\p{L}\p{N}])(" + "|".join(phrases) + r")(?![\p{L}\p{N}])"))


def _starts(command: Column, phrases: Iterable[str]) -> Column:
    return F.lower(command).rlike("^(" + "|".join(phrases) + r")(?![\p{L}\p{N}])")


def category(tools: Column, commands: Column, message: Column) -> Column:
    """Tools come first, then what stands earliest in the prompt (of equals refactoring, feature, debugging)."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda names: F.exists(tools, lambda t: t.isin(*names))
    hit = lambda phrases: phrase_position(text, phrases)
    edits, reads, bash = has(EDIT_TOOLS), has(READ_TOOLS), has(BASH_TOOLS) | (F.size(commands) > 0)
    refactor, feature, debug = hit(REFACTOR), hit(FEATURE), hit(DEBUG)
    at = lambda p: F.when(p > 0, p).otherwise(F.lit(1 << 30))
    none = (refactor == 0) & (feature == 0) & (debug == 0)
    coding = F.when(none, "coding").when((at(refactor) <= at(feature)) & (at(refactor) <= at(debug)), "refactoring").when(at(feature) <= at(debug), "feature").otherwise("debugging")
    reading = F.when(hit(RESEARCH) > 0, "exploration").when(debug > 0, "debugging").otherwise("exploration")
    talk = (
        F.when(F.trim(text) == "", "conversation").when(hit(BRAINSTORM) > 0, "brainstorming").when(hit(RESEARCH) > 0, "exploration")
        .when((feature > 0) & (at(feature) <= at(debug)), "feature").when(debug > 0, "debugging").when(text.contains("http://") | text.contains("https://"), "exploration").otherwise("conversation")
    )
    runs = lambda phrases: F.exists(commands, lambda c: phrase_position(F.lower(c), phrases) > 0)
    opens = lambda phrases: F.exists(commands, lambda c: _starts(c, phrases))
    return (
        F.when((F.size(tools) == 0) & (F.size(commands) == 0), talk)
        .when(has(PLAN_TOOLS), "planning")
        .when(has(AGENT_TOOLS), "delegation")
        .when(bash & ~edits & (runs(TEST_RUNNERS) | (hit(TEST) > 0)), "testing")
        .when(bash & ~edits & opens(GIT), "git")
        .when(bash & ~edits & opens(BUILD), "build_deploy")
        .when(edits, coding)
        .when(bash & reads, "exploration")
        .when(bash, "coding")
        .when(has(SEARCH_TOOLS) | F.exists(tools, lambda t: t.startswith("mcp__")), "exploration")
        .when(reads, reading)
        .when(has(TASK_TOOLS), "planning")
        .otherwise("general")
    )
