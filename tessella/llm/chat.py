"""Chat formatting by schema fingerprints.

The fingerprint of a schema, or of one JSON record, is the SHA-256 of its nested field paths, sorted. It
selects a declarative mapping from prompt, instruction, message-list and turn-row layouts to canonical turns
(role, text). The template writes each turn as

    <turn>role, a line feed, text</turn>, a line feed

with backslash and < inside roles and texts escaped by a backslash (and line feeds in roles as \\n), so that control
strings inside a text can neither open nor close a turn and parse() gives back exactly what went in. The loss
mask covers the text of assistant turns.

Null role and null text count as empty. Rows of a turn-row table stand in order of turn (null first), role, text;
a null conversation id is one conversation. A conversation is one row, so its turns must fit a task, as its formatted text must. A layout without a mapping gives null turns, never an error. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: single fields with fixed roles, then a list of messages; or one row per turn."""

    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    names: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None  # id, order, role, text of a table with a row for each turn


_PEOPLE = (("human", "user"), ("gpt", "assistant"), ("model", "assistant"), ("bot", "assistant"))
#: Layouts by their field paths.
LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("prompt", "response"): Mapping((("prompt", "user"), ("response", "assistant"))),
    ("completion", "prompt"): Mapping((("prompt", "user"), ("completion", "assistant"))),
    ("prompt", "response", "system"): Mapping((("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    ("answer", "question"): Mapping((("question", "user"), ("answer", "assistant"))),
    ("instruction", "output"): Mapping((("instruction", "user"), ("output", "assistant"))),
    ("input", "instruction", "output"): Mapping((("instruction+input", "user"), ("output", "assistant"))),
    ("messages[].content", "messages[].role"): Mapping(messages="messages"),
    ("messages[].content", "messages[].role", "system"): Mapping((("system", "system"),), messages="messages"),
    ("conversations[].from", "conversations[].value"): Mapping(messages="conversations", role="from", text="value", names=_PEOPLE),
    ("data.messages[].role", "data.messages[].text"): Mapping(messages="data.messages", text="text"),
    ("conv_id", "role", "text", "turn"): Mapping(rows=("conv_id", "turn", "role", "text")),
}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


MAPPINGS = {fingerprint(paths): m for paths, m in LAYOUTS.items()}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The leaf paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def record_paths(value, at: str = "") -> list[str]:
    """The leaf paths of a parsed JSON value."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in record_paths(v, f"{at}[]")] or [f"{at}[]"]
    return [at]


def _dig(record: dict, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _turns(record: dict, m: Mapping) -> list[tuple[str, str]] | None:
    """The turns of a record in a layout; None if something else than text stands where text is due."""
    nested = lambda x: bool(x) and isinstance(x, (dict, list))
    turns = []
    for path, role in m.fields:
        values = [_dig(record, p) for p in path.split("+")]
        if any(map(nested, values)):
            return None
        parts = [str(x) for x in values if x not in (None, "")]
        if parts or "+" not in path:
            turns.append((role, "\n\n".join(parts)))
    names = dict(m.names)
    messages = _dig(record, m.messages) if m.messages else []
    if not isinstance(messages, list):
        return None
    for x in messages:
        if not isinstance(x, dict) or nested(x.get(m.role)) or nested(x.get(m.text)):
            return None
        role = str(x.get(m.role) or "")
        turns.append((names.get(role, role), str(x.get(m.text) or "")))
    return turns


def record_turns(record) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint of a record, and its turns; None if no mapping has it.

    Other fields may stand beside a mapping's. Of several mappings whose fields are all there, the one with the most fields is taken,
    then one with messages, then the first listed; an empty list of messages has all their fields, but none counts.
    """
    paths = record_paths(record)
    mark = fingerprint(paths)
    if not isinstance(record, dict):
        return mark, None
    there = set(paths)
    fit = []
    for i, (needed, m) in enumerate(LAYOUTS.items()):
        own = [p for p in needed if p in there]
        if not m.rows and all(p in there or m.messages and p.startswith(f"{m.messages}[]") and f"{m.messages}[]" in there for p in needed):
            fit.append((-len(own), not m.messages, i, m))
    for *_, m in sorted(fit, key=lambda x: x[:3]):
        turns = _turns(record, m)
        if turns is not None:
            return mark, turns
    return mark, None


TURNS = "array<struct<role:string,text:string>>"


def canonical_json(records: DataFrame, *, id: str, record: str) -> DataFrame:
    """id, fingerprint and turns of JSON records, each in a layout of its own. Null, text that is no JSON, and JSON nested too deeply have null turns."""
    ship(records.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, turns = [], []
            for x in b.column(1).to_pylist():
                try:
                    mark, found = record_turns(json.loads(x))
                except (TypeError, ValueError, RecursionError):  # no JSON, or nested beyond what can be read
                    mark, found = None, None
                marks.append(mark)
                turns.append(None if found is None else [{"role": r, "text": t} for r, t in found])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string()), pa.array(turns, kind)], [id, "fingerprint", "turns"])

    kind = records.schema[id].dataType.simpleString()
    return records.select(id, record).mapInArrow(read, f"`{id}` {kind}, fingerprint string, turns {TURNS}")


def canonical_rows(df: DataFrame) -> DataFrame:
    """id and turns of a table with a row for each turn; its schema's fingerprint selects the mapping. Other columns may stand beside the mapping's."""
    there = schema_paths(df.schema)
    fit = [m for paths, m in LAYOUTS.items() if m.rows and fingerprint(p for p in there if p in paths) == fingerprint(paths)]
    if not fit:
        raise ValueError("no turn-row mapping has these fields")
    m = fit[0]
    id, order, role, text = m.rows
    blank = F.lit("")
    turn = F.struct(F.col(order).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    return df.groupBy(id).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(id, F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(text: str, line: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\<")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.S)


_TURN = re.compile(r"<turn>([^\\<\n]*(?:\\.[^\\<\n]*)*)\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def formatted(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the spans of it under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn>{escape(role, True)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


def format_chat(turns: DataFrame, *, id: str) -> DataFrame:
    """id, formatted, loss_spans (code points) for rows of id and turns; null turns stay null."""
    ship(turns.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for x in b.column(1).to_pylist():
                t, s = (None, None) if x is None else formatted((y["role"] or "", y["text"] or "") for y in x)
                texts.append(t)
                spans.append(s and [{"start": a, "end": e} for a, e in s])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], [id, "formatted", "loss_spans"])

    kind = turns.schema[id].dataType.simpleString()
    return turns.select(id, "turns").mapInArrow(write, f"`{id}` {kind}, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(chats: DataFrame, *, id: str) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its loss spans alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is None:
                    rows.append((0, None, 0, None, 0))
                    continue
                found = parse(t)
                loss = "".join(unescape(t[s["start"] : s["end"]]) for s in spans or [])
                all_ = "".join(f"{r}\n{x}\n" for r, x in found)
                rows.append((len(found), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema[id].dataType.simpleString()
    return chats.select(id, "formatted", "loss_spans").mapInArrow(read, f"`{id}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: its texts hold control strings of common templates and of this one.
TRICKY = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the added conversation comes as a record of messages, the others as a row for each turn: two layouts, one canonical form
    record = json.dumps({"messages": [{"role": r, "content": TRICKY} for r in ("user", "assistant")]})
    extra = canonical_json(spark.createDataFrame([(-7, record)], "conv_id long, record string"), id="conv_id", record="record")
    turns = canonical_rows(rows).unionByName(extra.select("conv_id", "turns"))
    return read_back(format_chat(turns, id="conv_id"), id="conv_id")
