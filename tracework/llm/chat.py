"""Chat formatting by schema fingerprint (operator 5).

A record's layout is the set of its nested field paths (``messages[].role``).
The paths that any mapping mentions are sorted and hashed; the fingerprint
selects one of the declarative mappings, which say where turns, roles and
contents are; a mixture of layouts falls to the first that is complete.  Tables are fingerprinted by their schema and converted with
built-in expressions; columns of JSON records are fingerprinted record by
record, so that one column may mix layouts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .text import only

ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "instruction": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "tool": "tool", "function": "tool"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` is the path of a list of messages with ``role`` and ``content`` under
    it; or ``fields`` names (role, path) of single texts in order; or ``rows`` names
    (conversation, position) of a table with one turn on each row.
    """

    name: str
    turns: str = ""
    role: str = ""
    content: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str] = ("", "")
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.fields:
            return {p for _, p in self.fields}
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.content}"}
        return {*self.rows, self.role, self.content}


MAPPINGS = (
    Mapping("turn rows", role="role", content="text", rows=("conv_id", "turn")),
    Mapping("message rows", role="role", content="content", rows=("conv_id", "turn")),
    Mapping("messages", "messages", "role", "content"),
    Mapping("from and value", "conversations", "from", "value"),
    Mapping("conversation", "conversation", "role", "content"),
    Mapping("dialog", "dialog", "speaker", "text"),
    Mapping("prompt and completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("question and answer", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)

_KNOWN = {p for m in MAPPINGS for p in m.paths()}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the field paths that some mapping mentions; other fields leave it as it is."""
    return hashlib.blake2b("\n".join(sorted(set(paths) & _KNOWN)).encode(), digest_size=8).hexdigest()


def _table() -> dict[str, Mapping]:
    found: dict[str, Mapping] = {}
    for m in MAPPINGS:
        for mask in range(1 << len(m.optional)):
            left_out = {p for i, p in enumerate(m.optional) if mask >> i & 1}
            found.setdefault(fingerprint(m.paths() - left_out), m)
    return found


BY_FINGERPRINT = _table()


def mapping_for(paths: set[str]) -> Mapping | None:
    """The mapping that the fingerprint selects; where fields of several layouts are mixed, the first whose needed fields are all there."""
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    return exact or next((m for m in MAPPINGS if m.paths() - set(m.optional) <= paths), None)


def schema_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Nested leaf paths of a Spark type; ``[]`` marks a list."""
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in schema.fields)) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    return {prefix}


def value_paths(value: object, prefix: str = "") -> set[str]:
    """Nested leaf paths of a parsed JSON value; a null field counts as absent."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, prefix + "[]") for v in value)) if value else set()
    return set() if value is None else {prefix}


def canonical(turns: Iterable[tuple[object, object]]) -> list[tuple[str, str]]:
    """Turns with known roles and stripped texts: empty ones are left out, neighbours of one role are joined by a line break."""
    out: list[tuple[str, str]] = []
    for role, text in turns:
        role = ROLES.get(str(role).strip().lower(), "user") if role is not None else "user"
        text = text.strip(" \t\r\n") if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)
        if not text:
            continue
        if out and out[-1][0] == role:
            out[-1] = role, f"{out[-1][1]}\n{text}"
        else:
            out.append((role, text))
    return out


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def record_turns(record: object) -> tuple[str, str | None, list[tuple[str, str]]]:
    """Fingerprint, layout and canonical turns of one record; no layout gives no turns."""
    paths = value_paths(record)
    print_, m = fingerprint(paths), mapping_for(paths)
    if m is None or not isinstance(record, dict) or m.rows[0]:
        return print_, None, []
    if m.fields:
        return print_, m.name, canonical((role, _get(record, path)) for role, path in m.fields)
    messages = _get(record, m.turns)
    return print_, m.name, canonical((_get(x, m.role), _get(x, m.content)) for x in messages if isinstance(x, dict)) if isinstance(messages, list) else []


def format_records(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(id, layout, fingerprint, turn, role, content) for each turn of a column of JSON records of any layouts.

    A record without a known layout, or that is no JSON (null or empty too),
    gives one row with a null layout, turn, role and content; one with a layout
    but no text gives none.  Null and repeated ids are answered row by row; very
    long records are taken whole.  An empty table gives no rows, and other columns
    are not read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                print_, layout, turns = record_turns(record)
                rows += [(key, layout, print_, i, r, t) for i, (r, t) in enumerate(turns)]
                if layout is None:
                    rows.append((key, None, print_, None, None, None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "layout", "fingerprint", "turn", "role", "content"])

    kind = only(df, id_column).schema[0].dataType.simpleString()
    return only(df, id_column, json_column).mapInArrow(convert, f"id {kind}, layout string, fingerprint string, turn int, role string, content string")


def _role(column: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.trim(column.cast("string")))), F.lit("user"))


def format_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content): canonical turns of a table with one turn on each row, its layout found by the schema's fingerprint.

    Turns are ordered by position, then role and text; a null position comes
    first.  Texts are stripped, null and empty ones left out, neighbours of one
    role joined by a line break, an unknown or null role counts as ``user``.
    Rows that repeat another count again.  Rows with a null conversation form
    one conversation.  Very long texts are taken whole.  An empty table gives no
    rows.  A table of another layout is an error; other columns are not read.
    Turns are told apart by windows over a conversation, in one shuffle.
    """
    m = mapping_for(schema_paths(df.schema))
    if m is None or not m.rows[0]:
        raise ValueError(f"no row layout has the fields of {sorted(schema_paths(df.schema))}")
    key, place = m.rows
    said = only(df, key, place, m.role, m.content).select(F.col(key).alias("conv_id"), F.col(place).alias("at"), _role(F.col(m.role)).alias("role"), F.regexp_replace(F.col(m.content).cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+\z", "").alias("content"))
    order = Window.partitionBy("conv_id").orderBy("at", "role", "content")
    fresh = F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1)
    said = said.where("content <> ''").withColumn("_fresh", fresh)
    said = said.withColumn("turn", (F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    said = said.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("at", "content"))).alias("t"))
    return said.select("conv_id", "turn", "role", F.array_join(F.col("t.content"), "\n").alias("content"))


def query(spark, sf_dir: str) -> DataFrame:
    return format_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH said AS (
  SELECT conv_id, turn AS place,
         CASE lower(trim(role)) WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role,
         trim(text, E' \\t\\r\\n') AS content
  FROM conversations
), marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY place, role, content) THEN 0 ELSE 1 END AS fresh
  FROM said WHERE content <> ''
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY place, role, content ROWS UNBOUNDED PRECEDING) AS g FROM marked
)
SELECT conv_id, CAST(g - 1 AS INTEGER) AS turn, any_value(role) AS role, string_agg(content, E'\\n' ORDER BY place, role, content) AS content
FROM numbered GROUP BY conv_id, g
"""
