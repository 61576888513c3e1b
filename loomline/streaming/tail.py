"""Session files followed as they grow.

The stream source session_tail reads whole lines that were added to each file since the
last batch. An offset holds, for each file, where its last whole line ends and a hash of
the 256 bytes before that place; an open last line waits for its end. A file whose bytes
before the offset have changed, or that became shorter, is read anew from its start.
Bounded parts of a file are read by tasks; the driver reads only the ends of files.

follow_claude parses such lines. What a file carries forward, its prompt, project and
last call, is kept in a table by file between batches, so a batch parses only its own lines.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import growing
from ..operators.archive import merge_calls
from ..operators.shared import written
from ..sources import session_logs

PROBE_BYTES, BLOCK, PART_BYTES, ROWS = 256, 1 << 16, 64 << 20, 10_000
SCHEMA = pa.schema([("path", pa.string()), ("resumed", pa.bool_()), ("line", pa.int64()), ("value", pa.string())])


@dataclass
class Part(InputPartition):
    """Lines of a file that start from first on and before last; end is where the batch's last line ends."""

    path: str
    resumed: bool
    begin: int
    first: int
    last: int
    end: int


class _Tail(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.pattern = pattern
        #: Size, time and offset of each file as last seen, which spares unchanged files.
        self.seen: dict[str, tuple[int, object, list]] = {}

    def _probe(self, file, offset: int) -> str:
        start = max(0, offset - PROBE_BYTES)
        return xxhash.xxh64_hexdigest(file.read_at(offset - start, start))

    def _whole_lines(self, file, size: int) -> int:
        """Where the last whole line ends."""
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        now = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            known = self.seen.get(info.path)
            if known and known[:2] == (info.size, info.mtime):
                now[info.path] = known
                continue
            with self.files.open_input_file(info.path) as file:
                offset = self._whole_lines(file, info.size)
                now[info.path] = (info.size, info.mtime, [offset, self._probe(file, offset)])
        self.seen = now
        return {"files": json.dumps({path: seen[2] for path, seen in sorted(now.items())})}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        old, parts = json.loads(start["files"]), []
        for path, (offset, probe) in json.loads(end["files"]).items():
            known = old.get(path)
            if not offset or known == [offset, probe]:
                continue
            begin = 0
            if known and 0 < known[0] <= offset:
                with self.files.open_input_file(path) as file:
                    begin = known[0] if file.size() >= known[0] and self._probe(file, known[0]) == known[1] else 0
            for first in range(begin, offset, PART_BYTES):
                parts.append(Part(path, begin > 0, begin, first, min(first + PART_BYTES, offset), offset))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        p, rows = partition, []
        with self.files.open_input_file(p.path) as file:
            # a part other than the first starts after the line that the one before it ends with
            at = p.first if p.first == p.begin else p.first - 1
            file.seek(at)
            open_line, skip = b"", p.first != p.begin
            while at < p.last and (block := file.read(min(BLOCK * 16, p.end - at - len(open_line)))):
                *lines, open_line = (open_line + block).split(b"\n")
                for line in lines:
                    if at >= p.last:
                        break
                    if not skip:
                        rows.append((p.path, p.resumed, at, line.rstrip(b"\r").decode("utf-8", "replace")))
                    at, skip = at + len(line) + 1, False
                while len(rows) >= ROWS:
                    yield self._batch(rows[:ROWS])
                    rows = rows[ROWS:]
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class SessionTail(DataSource):
    """Options: path, a folder that driver and executors share, and pathGlobFilter, of the file's name."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return "path string, resumed boolean, line bigint, value string"

    def streamReader(self, schema) -> _Tail:
        return _Tail(self.options["path"], self.options.get("pathglobfilter", "*.jsonl"))


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of (path, resumed, line, value): line is the byte where it starts; resumed is false where a file is read from its start."""
    spark.dataSource.register(SessionTail)
    return spark.readStream.format("session_tail").option("path", folder).option("pathGlobFilter", pattern).load()


def _prior_lines(state: DataFrame) -> DataFrame:
    """The prompt and project of a file's state as a line before its others."""
    said = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("prompt.text").alias("text"))).alias("content"))
    line = F.struct(F.lit("user").alias("type"), F.date_format("prompt.at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.col("project").alias("cwd"), F.when(F.col("prompt").isNotNull(), said).alias("message"))
    return state.select("path", F.lit(-1).cast("long").alias("line"), F.to_json(line).alias("value"))


def follow_claude(stream: DataFrame, folder: str, checkpoint: str, buckets: int = growing.BUCKETS, **trigger) -> StreamingQuery:
    """Calls of followed files in the growing archive folder/calls, with what files carry forward in folder/state."""

    def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new, "path", "left_anti").unionByName(new)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = written(batch, "tail")
        files = lines.groupBy("path").agg(F.min("resumed").alias("resumed"))
        known = growing.read(spark, f"{folder}/state")
        state = known.join(files.where("resumed"), "path", "left_semi") if known is not None else None
        every = lines.select("path", "line", "value")
        rows = session_logs.claude_rows(every if state is None else every.unionByName(_prior_lines(state)))
        calls = session_logs.claude_calls_of(rows).join(files.select("path", F.col("resumed").alias("merge_activity")), "path")
        if state is not None:
            # an interruption before any call of the batch cancels the one before the batch
            early = rows.where("interrupted and cancels is null").select("path").distinct()
            late = state.where("begun is not null").join(early, "path").select("path", F.lit("claude-code").alias("tool"), F.col("begun").alias("dedup_key"), F.lit(True).alias("is_canceled"))
            calls = calls.unionByName(session_logs.as_calls(late).withColumn("merge_activity", F.lit(True)).select(calls.columns))
        after = rows.groupBy("path").agg(*[F.max_by(c, "line").alias(c) for c in ("prompt", "project", "begun")])
        if state is not None:
            before = state.select("path", F.col("begun").alias("begun_before"))
            after = after.join(before, "path", "left").withColumn("begun", F.coalesce("begun", "begun_before")).drop("begun_before")
        calls = calls.withColumn("seq", F.col("line"))
        growing.upsert(spark, f"{folder}/calls", calls, batch_id, merge_calls, buckets=buckets)
        growing.upsert(spark, f"{folder}/state", after, batch_id, merge_state, key=("path",), buckets=buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
