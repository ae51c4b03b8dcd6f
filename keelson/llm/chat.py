"""Chat formatting: a role automaton checks turn order and a declarative template emits flagged segments.

The operator returns one row per turn with its text segments and their loss flags, in conversation order;
a conversation's formatted text is the concatenation of its segments, so that no conversation, however
long, has to fit into one row. Turn order is checked by a finite-state machine over roles whose table is
part of the template. Control strings inside texts are broken by a backslash after their first character
(and backslashes are doubled), which `read_back` undoes.

Defined cases: null text is empty text; a null role is the role ""; unknown roles use the template's
other-role pieces and break the turn order; a null conv_id is a conversation of its own; turns are ordered
by (turn, role, text), nulls first, so repeated rows and ties have one order; an empty table gives no row;
extra columns are ignored. Turn order never drops a row: it is reported in `state` and `in_order`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, small_batches, table


@dataclass(frozen=True)
class ChatTemplate:
    """pieces: by role, (before, after, loss); the text stands between. other: before, between role and text, after."""

    pieces: tuple[tuple[str, str, str, bool], ...]
    other: tuple[str, str, str]
    moves: tuple[tuple[str, str, str], ...]
    final: tuple[str, ...]

    def controls(self) -> list[str]:
        found = {x for _, before, after, _ in self.pieces for x in (before, after)} | set(self.other)
        return sorted(found, key=lambda x: (-len(x), x))


INSTRUCT = ChatTemplate(
    pieces=(
        ("system", "<<SYS>>", "<</SYS>>", False),
        ("user", "[INST]", "[/INST]", False),
        ("assistant", "<s>", "</s>", True),
    ),
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    moves=(
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    ),
    final=("assistant",),
)


class Codec:
    """Writes and reads turns of a template."""

    def __init__(self, template: ChatTemplate) -> None:
        self.by_role = {role: (before, after, loss) for role, before, after, loss in template.pieces}
        self.other = template.other
        self.moves = {(state, role): to for state, role, to in template.moves}
        self.final = set(template.final)
        self.breaks = re.compile("|".join([r"\\", *map(re.escape, template.controls())]))
        self.joins = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.breaks.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.joins.sub(r"\1", text)

    def step(self, state: str, role: str) -> str:
        return self.moves.get((state, role), "broken")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.by_role:
            before, after, loss = self.by_role[role]
            return [(before, False), (self.escape(text), loss), (after, False)]
        before, between, after = self.other
        return [(before + self.escape(role) + between, False), (self.escape(text), False), (after, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn. Texts hold no control string, so the next closing string ends a turn."""
        at = 0
        while at < len(formatted):
            for role, (before, after, _) in self.by_role.items():
                if formatted.startswith(before, at):
                    begin = at + len(before)
                    break
            else:
                before, between, after = self.other
                if not formatted.startswith(before, at):
                    raise ValueError(f"no turn begins at {at}")
                middle = formatted.index(between, at + len(before))
                role, begin = self.unescape(formatted[at + len(before) : middle]), middle + len(between)
            end = formatted.index(after, begin)
            yield role, self.unescape(formatted[begin:end])
            at = end + len(after)


TURNS = "conv_id long, turn long, role string, state string, in_order boolean, segments array<struct<text:string,loss:boolean>>"


def format_turns(conversations: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """One row per turn, in order within its conversation and partition. One shuffle; turns stream through, so
    memory doesn't grow with the length of a conversation."""
    small_batches(conversations.sparkSession)
    schema = arrow_schema(conversations.sparkSession, TURNS)
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, conv, state = Codec(template), object(), "start"
        for batch in batches:
            out: list[dict] = []
            for x in batch.to_pylist():
                if x["conv_id"] != conv:
                    conv, state = x["conv_id"], "start"
                state = codec.step(state, x["role"])
                pieces = [{"text": text, "loss": loss} for text, loss in codec.segments(x["role"], x["text"])]
                out.append({"conv_id": conv, "turn": x["turn"], "role": x["role"], "state": state, "in_order": state != "broken", "segments": pieces})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """Per conversation, what its formatted text holds: turns parsed and unescaped, and the text under the loss mask.
    Takes the rows of format_turns in their order and streams them."""
    schema = arrow_schema(turns.sparkSession, DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now = Codec(template), None

        def closed(x: dict) -> dict:
            return {"conv_id": x["conv"], "n_turns": x["turns"], "turns_sha256": x["all"].hexdigest(), "loss_chars": x["chars"], "loss_sha256": x["loss"].hexdigest(), "formatted_chars": x["size"], "valid": x["state"] in codec.final}

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if now is None or now["conv"] != x["conv_id"]:
                    if now is not None:
                        out.append(closed(now))
                    now = {"conv": x["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "state": ""}
                formatted = "".join(s["text"] for s in x["segments"])
                now["size"] += len(formatted)
                now["state"] = x["state"]
                for role, text in codec.read(formatted):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{text}\n".encode())
                for s in x["segments"]:
                    if s["loss"]:
                        learnt = codec.unescape(s["text"])
                        now["chars"] += len(learnt)
                        now["loss"].update(learnt.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed(now)], schema=schema)

    return turns.mapInArrow(run, DIGESTS)


#: A conversation whose texts hold control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(probe)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS prior,
    len(text) + len(regexp_extract_all(text, '\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[TEXT\]|</s>|<s>'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
        ELSE 19 + len(role) + len(regexp_extract_all(role, '\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[TEXT\]|</s>|<s>')) END AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), checked AS (
  SELECT *, CASE role WHEN 'system' THEN prior IS NULL WHEN 'user' THEN prior IS NULL OR prior IN ('system', 'assistant')
    WHEN 'assistant' THEN prior IS NOT NULL AND prior = 'user' ELSE false END AS fits
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and(fits) AND arg_max(role, k) = 'assistant' AS valid
FROM checked GROUP BY conv_id
"""
