"""Chat formatting from event logs: deltas, edits and regenerations are folded into final messages, which a template renders with a loss mask.

A log has the columns of ``LOG``.  An event belongs to the message (conv_id, turn, tie, entry) and acts in ascending order of seq: ``open`` starts it with a role and a text, ``delta``
appends, ``edit`` puts a text in place of ``length`` code points from ``start`` (of all, where start is null), ``regenerate`` empties it and voids every later message of the
conversation that was opened before.  Messages stand in the order of (turn, tie, entry).

The fold: the log is dealt into ranges of messages, so neither a long conversation nor a hot one has to fit a task, and sorted inside them; a task folds one message at a time.  What a
regeneration voids in later ranges is carried over by a table of two rows a range, and only chunks that it reaches are rendered again.  A conversation is one row of the output unless it
exceeds ``CHUNK`` characters or lies on a border; then further rows continue it, in the order of (piece, number).

The template puts marks around each turn; a text that holds a mark gets a backslash inside it, one more than it has, and loses it on reading.  The mask is the spans of the assistant's texts.

Edge cases: null texts and roles are empty; conversations without id are one, with the id null; events without turn come last; equal seqs act in the order of kind, then text; a delta to
a message that was never opened opens it with its own role; an unknown kind is an error; rows of a table that share a turn are turns of their own, in the order of a
hash of role and text; an empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, partitions_for, written

LOG = "conv_id long, turn long, tie long, entry long, seq long, kind string, role string, text string, start int, length int"
KEY = ("conv_id", "turn", "tie", "entry")
#: Characters of the deltas that a table's texts are cut into.
DELTA = 256
#: Characters after which a conversation goes on in another row.
CHUNK = 1 << 20
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")}
NAMED = ("[ROLE] ", " [SEP] ", " [/ROLE]")
_CONTROL = r"/?(?:s>|(?:INST|SYS|ANS|ROLE|SEP)\])"
_ESCAPED = re.compile(rf"([<\[]\\*)({_CONTROL})")
_GUARDED = re.compile(rf"([<\[]\\*)\\({_CONTROL})")
_BARE = re.compile(rf"[<\[]{_CONTROL}")
_OPENING = {opening.strip(): (role, len(opening), len(closing)) for role, (opening, closing) in MARKS.items()}


def escaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _GUARDED.sub(r"\1\2", text)


def rendered(role: str, text: str) -> tuple[str, int]:
    """(a turn between its marks, where its text begins)."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = f"{NAMED[0]}{escaped(role)}{NAMED[1]}", NAMED[2]
    return f"{opening}{escaped(text)}{closing}", len(opening)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a rendered text."""
    marks = [(m.group(), m.start(), m.end()) for m in _BARE.finditer(formatted)]
    at = 0
    while at < len(marks):
        mark, first, after = marks[at]
        if mark in _OPENING:
            role, before, behind = _OPENING[mark]
            _, close, _ = marks[at + 1]
            yield role, unescaped(formatted[first + before : close - (behind - len(MARKS[role][1].lstrip()))])
            at += 2
        else:
            (_, middle, behind), (_, close, _) = marks[at + 1], marks[at + 2]
            yield unescaped(formatted[after + 1 : middle - 1]), unescaped(formatted[behind + 1 : close - 1])
            at += 3


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of marks."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def log_of(conversations: DataFrame) -> DataFrame:
    """The log of a table (conv_id, turn, role, text): each row opens a message, and its text streams in deltas."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64("role", text).alias("tie"), F.monotonically_increasing_id().alias("entry"), F.coalesce("role", F.lit("")).alias("role"), pieces.alias("pieces"))
    events = rows.select(*KEY, "role", F.posexplode(F.concat(F.array(F.lit("")), "pieces")).alias("at", "text"))
    return events.select(*KEY, F.col("at").cast("long").alias("seq"), F.when(F.col("at") == 0, "open").otherwise("delta").alias("kind"), "role", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"))


class Message:
    """One message, event by event."""

    def __init__(self) -> None:
        self.role: str | None = None
        self.parts: list[str] = []
        self.opened: int | None = None
        self.cut: int | None = None  # seq of its latest regeneration

    def act(self, seq: int, kind: str, role: str | None, text: str | None, start: int | None, length: int | None) -> None:
        text = text or ""
        if kind == "open":
            self.role, self.parts, self.opened = role or "", [text], seq
        elif kind == "delta":
            if self.opened is None:
                self.role, self.opened = role or "", seq
            self.parts.append(text)
        elif kind == "edit":
            whole = "".join(self.parts)
            self.parts = [text if start is None else whole[:start] + text + whole[start + (length or 0) :]]
        elif kind == "regenerate":
            self.parts, self.cut = [], seq
        else:
            raise ValueError(f"no such event: {kind}")


class Chunk:
    """Rendered turns of a conversation."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.opened: list[int] = []

    def add(self, role: str, text: str, opened: int) -> None:
        turn, begins = rendered(role, text)
        if role == "assistant":
            self.starts.append(self.size + begins)
            self.ends.append(self.size + len(turn) - len(MARKS[role][1]))
        self.parts.append(turn)
        self.opened.append(opened)
        self.size += len(turn)

    def row(self) -> tuple[str, list[int], list[int], list[int]]:
        return "".join(self.parts), self.starts, self.ends, self.opened


FORM = pa.schema([("piece", pa.int32()), ("number", pa.int64()), ("conv_id", pa.int64()), ("alone", pa.bool_()), ("formatted", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("opened", pa.list_(pa.int64())), ("cut", pa.int64())])
FORM_DDL = "piece int, number long, conv_id long, alone boolean, formatted string, starts array<int>, ends array<int>, opened array<long>, cut long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Renderer:
    """Folds a range of a log into rows of the output, and a row without text for its first and its last conversation: the latest regeneration there."""

    def __init__(self, piece: int, chunk: int) -> None:
        self.piece, self.chunk, self.number = piece, chunk, 0
        self.conv: tuple | None = None
        self.convs = self.made = 0
        self.cut: int | None = None
        self.now = Chunk()
        self.rows: list[tuple] = []

    def _close(self, alone: bool) -> None:
        if self.now.parts:
            self.rows.append((self.piece, self.number, self.conv[0], alone, *self.now.row(), None))
            self.number, self.made, self.now = self.number + 1, self.made + 1, Chunk()

    def _end(self, last: bool) -> None:
        if self.conv is None:
            return
        self._close(self.convs > 1 and not last and self.made == 0)
        if self.convs == 1 or last:
            self.rows.append((self.piece, self.number, self.conv[0], None, None, None, None, None, self.cut))

    def message(self, conv: int | None, m: Message) -> None:
        if self.conv != (conv,):
            self._end(False)
            self.conv, self.convs, self.made, self.cut = (conv,), self.convs + 1, 0, None
        if m.opened is not None and (self.cut is None or m.opened > self.cut):
            if self.now.size > self.chunk:
                self._close(False)
            self.now.add(m.role or "", "".join(m.parts), m.opened)
        if m.cut is not None:
            self.cut = m.cut if self.cut is None else max(self.cut, m.cut)


def formatted(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """piece, number, conv_id, alone (the conversation is this row), formatted, starts and ends of the loss mask in code points; the output is written to the shared folder."""
    spark = log.sparkSession
    bounded(spark)
    order = [F.col(c).asc_nulls_last() for c in KEY]
    names = [c.split()[0] for c in LOG.split(", ")]
    dealt = log.select(*names).repartitionByRange(2 * partitions_for(spark), *order).sortWithinPartitions(*order, "seq", "kind", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, message = Renderer(TaskContext.get().partitionId(), chunk), None, Message()
        for batch in it:
            for conv, turn, tie, entry, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, turn, tie, entry):
                    if key:
                        out.message(key[0], message)
                    key, message = (conv, turn, tie, entry), Message()
                message.act(*event)
            yield _table(out.rows, FORM)
            out.rows = []
        if key:
            out.message(key[0], message)
            out._end(True)
            yield _table(out.rows, FORM)

    made = written(dealt.mapInArrow(run, FORM_DDL), "chat-chunks", "zstd")
    chunks = made.where(F.col("formatted").isNotNull()).drop("cut")
    # two rows a range; the running maximum crosses a border only where a conversation does
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    borders = written(made.where(F.col("formatted").isNull()).withColumn("carry", F.max("cut").over(earlier)).where(F.col("carry").isNotNull()).select("piece", F.col("conv_id").alias("conv"), "carry"), "chat-borders")
    if borders.isEmpty():
        return chunks
    on = (chunks["piece"] == borders["piece"]) & chunks["conv_id"].eqNullSafe(borders["conv"])
    small = borders.limit(100_001).count() <= 100_000
    joined = chunks.join(F.broadcast(borders) if small else borders, on, "left").select(*[chunks[c] for c in chunks.columns], "carry")
    reached = F.exists("opened", lambda o: o <= F.col("carry"))
    whole = joined.where(F.col("carry").isNull() | ~reached).drop("carry")

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                now = Chunk()
                for (role, text), opened in zip(turns_of(r["formatted"]), r["opened"], strict=True):
                    if opened > r["carry"]:
                        now.add(role, text, opened)
                if now.parts:
                    rows.append((r["piece"], r["number"], r["conv_id"], r["alone"], *now.row()))
            yield _table(rows, pa.schema(list(FORM)[:-1]))

    return whole.unionByName(joined.where(reached).mapInArrow(again, FORM_DDL.rpartition(",")[0]))


RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
RESULT_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """Running digests of a conversation, chunk by chunk."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.masked = self.size = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in turns_of(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for a, b in zip(starts, ends, strict=True):
            text = unescaped(formatted[a:b])
            self.loss.update(text.encode())
            self.masked += len(text)
        self.size += len(formatted)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.masked, self.loss.hexdigest(), self.size


def described(chunks: DataFrame) -> DataFrame:
    """A row a conversation, read from the output: turns, digests of turns and of what the loss mask covers, size.

    Conversations of one row are described where they lie; only the rows of others are gathered, in order, and digested as they pass.
    """
    columns = ["conv_id", "formatted", "starts", "ends"]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = Digest()
                d.add(text, starts, ends)
                rows.append(d.row(conv))
            yield _table(rows, RESULT)

    def running(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d = None, Digest()
        for batch in it:
            rows = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        rows.append(d.row(now[0]))
                    now, d = (conv,), Digest()
                d.add(text, starts, ends)
            yield _table(rows, RESULT)
        if now:
            yield _table([d.row(now[0])], RESULT)

    alone = chunks.where("alone").select(*columns).mapInArrow(each, RESULT_DDL)
    parts = partitions_for(chunks.sparkSession)
    others = chunks.where("not alone").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "piece", "number").select(*columns).mapInArrow(running, RESULT_DDL)
    return alone.unionByName(others)


_ESCAPE_SQL = "regexp_replace({0}, '([<\\[]\\\\*)(" + _CONTROL + ")', '\\1\\\\\\2', 'g')"
#: The same conversations in DuckDB's SQL.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)
), r AS (
  SELECT *, CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 22 + length({_ESCAPE_SQL.format("role")}) END + length({_ESCAPE_SQL.format("text")}) AS size FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
