"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record is a JSON object in one of several layouts. The known nested field paths
that it has, over all elements of its lists, are sorted, joined and hashed; the hash
selects a declarative mapping from that layout to canonical turns of (role, content).
Fields that no layout knows don't count. Turns are written as

    <|im_start|>role\\ntext<|im_end|>\\n

with control strings escaped: in texts and roles one backslash is put after the
"<" of each "<", backslashes, "|", so no text holds "<|", and taking one away
again restores it. A line break in a role becomes <|nl|>.

Defined results: null texts and roles are empty; a message without a role or a text
has an empty one; a record of an unknown layout keeps its row, with a null text and
its problem named; an array of no messages gives an empty text; columns of the input
named like an output are kept as input_<name>; turns with equal numbers are ordered by role, then text, null numbers first;
conversations are grouped by conv_id, null being one; no rows give an empty table
(or conversation -1 alone, in the query). Other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
_LISTS, _ROLES, _TEXTS = ("messages", "conversations"), ("role", "from"), ("content", "value")
_QUESTIONS, _ANSWERS = ("prompt", "instruction"), ("response", "completion", "output")
_SCALARS = ("system", *_QUESTIONS, "input", *_ANSWERS)
RECORD = ", ".join([f"{name} array<map<string,string>>" for name in _LISTS] + [f"{name} string" for name in _SCALARS])
#: The layouts without lists: their field paths, and the turns they map to as (role, fields joined by a blank line).
_PAIRS = {(*asked, answer): (("user", asked), ("assistant", (answer,))) for answer in _ANSWERS for asked in [("input",), *[(q, *more) for q in _QUESTIONS for more in ((), ("input",))]]}
LAYOUTS = _PAIRS | {("system", *paths): (("system", ("system",)), *turns) for paths, turns in _PAIRS.items()}
OUTPUTS = ("formatted", "loss_spans", "problem")


def field_paths(record: Column, parsed: Column) -> Column:
    """The known nested field paths of a JSON object, sorted and joined by commas; null if it is none."""
    top = F.json_object_keys(record)
    paths = [F.when(F.array_contains(top, k), F.lit(k)) for k in _SCALARS]
    nothing = F.array().cast("array<string>")
    for name in _LISTS:
        inner = F.array_distinct(F.flatten(F.transform(F.coalesce(parsed[name], F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(F.map_keys(m), nothing))))
        paths.append(F.when(F.array_contains(top, name), F.lit(f"{name}[]")))
        paths += [F.when(F.array_contains(inner, k), F.lit(f"{name}[].{k}")) for k in (*_ROLES, *_TEXTS)]
    return F.when(top.isNotNull(), F.array_join(F.array_sort(F.array_compact(F.array(*paths))), ","))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _turn(role: Column, content: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def _message(m: Column) -> Column:
    return _turn(F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in _ROLES]), F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in _TEXTS]))


def _list_layouts(name: str, system: bool) -> list[str]:
    """Field paths of a list of messages, whichever of the known fields they have."""
    fields = [f"{name}[].{k}" for k in (*_ROLES, *_TEXTS)]
    some = [[f for i, f in enumerate(fields) if bits >> i & 1] for bits in range(1 << len(fields))]
    return [",".join(sorted([f"{name}[]", *chosen, *(["system"] if system else [])])) for chosen in some]


def canonical_turns(paths: Column, parsed: Column) -> Column:
    """array<struct<role, content>> of a record, by the mapping that its fingerprint selects; null if none does."""
    mark = fingerprint(paths)
    system = _turn(F.lit("system"), parsed["system"])
    cases: list[tuple[list[str], Column]] = []
    for name in _LISTS:
        messages = F.transform(parsed[name], _message)
        cases += [(_list_layouts(name, False), messages), (_list_layouts(name, True), F.concat(F.array(system), messages))]
    for fields, mapped in LAYOUTS.items():
        made = [_turn(F.lit(role), F.array_join(F.filter(F.array(*[parsed[f] for f in own]), lambda x: x != ""), "\n\n")) for role, own in mapped]
        cases.append(([",".join(sorted(fields))], F.array(*made)))
    turns = F.when(F.lit(False), cases[0][1])
    for layouts, value in cases:
        turns = turns.when(mark.isin([F.xxhash64(F.lit(x)) for x in layouts]), value)
    return turns


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


SPANS = "array<struct<start:int,end:int,turn:int>>"


def _span_blocks(written: Column) -> Column:
    """array<struct<length, spans>>: the spans of square-root-sized blocks of turns, counted from the block's start.

    A fold copies the array that it grows, so one over all turns would take the square of their number.
    """
    n = F.size(written)
    size = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int")), lambda b: F.struct((b * size).alias("first"), F.slice(written, b * size + 1, size).alias("turns")))

    def step(done: Column, t: Column) -> Column:
        start = done["length"] + F.lit(len(START) + 1) + F.length(t["role"])
        end = start + F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), done["turn"].alias("turn")))
        return F.struct((end + F.lit(len(END) + 1)).alias("length"), (done["turn"] + F.lit(1)).alias("turn"), F.when(t["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def fold(block: Column) -> Column:
        return F.aggregate(block["turns"], F.struct(F.lit(0).alias("length"), block["first"].alias("turn"), F.array().cast(SPANS).alias("spans")), step)

    return F.when(n > 0, F.transform(blocks, fold)).when(n == 0, F.array().cast(f"array<struct<length:int,turn:int,spans:{SPANS}>>"))


def _running_sums(lengths: Column) -> Column:
    """What comes before each of the lengths."""
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda done, x: F.struct((done["at"] + x).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all")))["all"]


def _joined_spans(blocks: Column, starts: Column) -> Column:
    moved = F.transform(blocks, lambda b, i: F.transform(b["spans"], lambda s: F.struct((s["start"] + starts[i]).alias("start"), (s["end"] + starts[i]).alias("end"), s["turn"].alias("turn"))))
    return F.flatten(moved)


def format_chats(records: DataFrame, record_col: str = "record", loss_role: str = "assistant") -> DataFrame:
    """records with formatted, loss_spans and problem.

    A span has the code points that the loss covers in formatted, end exclusive, and in which turn they are.
    """
    records = records.withColumnsRenamed({c: free_name(records, f"input_{c}") for c in records.columns if c.lower() in OUTPUTS and c != record_col})
    parsed, paths, made, written, blocks, starts = (free_name(records, n) for n in ("_parsed", "_paths", "_turns", "_escaped", "_blocks", "_starts"))
    escaped = F.transform(made, lambda t: F.struct(F.regexp_replace(escape(t["role"]), "\n", BREAK).alias("role"), escape(t["content"]).alias("content"), (t["role"] == loss_role).alias("loss")))
    text = F.array_join(F.transform(written, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["content"], F.lit(END + "\n"))), "")

    problem = F.when(F.col(paths).isNull(), "not a JSON object").when(F.col(made).isNull(), F.concat(F.lit("unknown layout: "), F.col(paths)))
    out = records.withColumn(parsed, F.from_json(record_col, RECORD, {"maxStringLen": str(2**31 - 1)})).withColumn(paths, field_paths(F.col(record_col), F.col(parsed)))
    out = out.withColumn(made, canonical_turns(F.col(paths), F.col(parsed))).withColumn(written, escaped)
    out = out.withColumn(blocks, _span_blocks(F.col(written))).withColumn(starts, _running_sums(F.transform(F.col(blocks), lambda b: b["length"])))
    return out.withColumn("formatted", text).withColumn("loss_spans", _joined_spans(F.col(blocks), F.col(starts))).withColumn("problem", problem).drop(parsed, paths, made, written, blocks, starts)


def _pieces(formatted: Column) -> Column:
    """The formatted text of each turn after its start mark; the text before the first one comes first."""
    return F.split(formatted, r"<\|im_start\|>")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, content>> read back from a formatted text."""
    pieces = F.filter(_pieces(formatted), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_replace(F.substring_index(p, "\n", 1), r"<\|nl\|>", "\n")).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - len(END) - 2)).alias("content"),
        ),
    )


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Each span is read in its own turn, so the text is passed over once."""

    def text(pieces: Column) -> Column:
        def own(span: Column) -> Column:
            piece = F.element_at(pieces, span["turn"] + 2)
            return unescape(F.substring(piece, F.length(F.substring_index(piece, "\n", 1)) + 2, span["end"] - span["start"]))

        return F.array_join(F.transform(loss_spans, own), "")

    return F.element_at(F.transform(F.array(_pieces(formatted)), text), 1)


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows by turn, in the messages layout."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    ordered = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(ordered.alias("messages"))).alias("record"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op8_query(spark, sf_dir: str) -> DataFrame:
    records = conversation_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    control = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response"))).alias("record"))
    out = format_chats(records.unionByName(control)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss_text(F.col("formatted"), F.col("loss_spans")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
