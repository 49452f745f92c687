"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn: text is kept, an image, audio or document becomes a
placeholder ``<|kind:i|>`` (i counts the conversation's attachments), its reference and its expanded
token count are recorded. The template marks turns; control strings inside texts and roles are
escaped reversibly, so no text can open or close a turn.

A part of an unknown type becomes a placeholder ``<|other:i|>``, so that nothing is lost silently.

Turns are ordered by turn number, then role, then text, nulls first; a null text is empty, a null
role too. Rows are formatted one by one as they stream past in order, so a conversation of any
length needs no more memory than one turn: ``format_turns`` gives one row per turn, whose
concatenation in order is the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What one attachment takes in the model's context unless the part states it.
EXPANDED = {"image": 576, "audio": 750, "document": 1024, "other": 0}
_CONTROL = re.compile(r"<(?=/?s>|\|)|\[(?=/?INST\]|/?TURN)|\\")
_CODES = {"<": r"\l", "[": r"\b", "\\": r"\\"}
_BACK = {r"\l": "<", r"\b": "[", r"\\": "\\"}
_TURN = re.compile(r"<s>\[TURN ([^\]]*)\]( \[INST\] )?(.*?)(?(2) \[/INST\])</s>", re.S)


def escape(s: str) -> str:
    """Control strings' first characters and backslashes become two-character codes."""
    return _CONTROL.sub(lambda m: _CODES[m[0]], s)


def unescape(s: str) -> str:
    return re.sub(r"\\[lb\\]", lambda m: _BACK[m[0]], s)


def escape_role(s: str) -> str:
    return escape(s).replace("]", r"\r")


def unescape_role(s: str) -> str:
    return re.sub(r"\\[lbr\\]", lambda m: (_BACK | {r"\r": "]"})[m[0]], s)


@dataclass
class Flattener:
    """Visits the parts of a conversation's turns in order."""

    attachments: int = 0
    seen: list[dict] = field(default_factory=list)

    def visit(self, part) -> str:
        if part is None:
            return ""
        if isinstance(part, str):
            return escape(part)
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part) -> str:
        return escape(part.get("text") or "")

    def attach(self, part, kind: str) -> str:
        tokens = part.get("tokens")
        self.seen.append({"index": self.attachments, "kind": kind, "ref": part.get("ref"), "tokens": int(EXPANDED[kind] if tokens is None else tokens)})
        self.attachments += 1
        return f"<|{kind}:{self.attachments - 1}|>"

    def visit_image(self, part) -> str:
        return self.attach(part, "image")

    def visit_audio(self, part) -> str:
        return self.attach(part, "audio")

    def visit_document(self, part) -> str:
        return self.attach(part, "document")

    def visit_other(self, part) -> str:
        return self.attach(part, "other")

    def content(self, content) -> str:
        return "".join(map(self.visit, content)) if isinstance(content, list) else self.visit(content)


def template(role: str, body: str) -> tuple[str, int, int]:
    """A turn, and where its text under the loss mask starts and ends (the assistant's text; else nothing)."""
    head = f"<s>[TURN {escape_role(role)}]"
    if role == "assistant":
        return f"{head}{body}</s>", len(head), len(head) + len(body)
    return f"{head} [INST] {body} [/INST]</s>", 0, 0


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation (or of a part of it that starts with a turn)."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        at = m.end()
        yield unescape_role(m[1]), unescape(m[3])
    if at != len(formatted):
        raise ValueError("text outside turns")


ATTACHMENT = pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
TURNS = "conv_id bigint, turn_no bigint, formatted string, loss_start bigint, loss_end bigint, attachments array<struct<index:bigint,kind:string,ref:string,tokens:bigint>>, expanded_tokens bigint"


def _ordered(df: DataFrame, content_col: str) -> DataFrame:
    tie = F.to_json(content_col) if isinstance(df.schema[content_col].dataType, T.ArrayType) else F.col(content_col)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col(content_col).alias("content"), tie.alias("tie"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.col("tie").asc_nulls_first()).drop("tie")


def format_turns(df: DataFrame, content_col: str = "text") -> DataFrame:
    """One row per turn: its number in the conversation, formatted text, loss mask and attachments.

    df has conv_id, turn, role and content_col: a string, or an array of parts
    struct<type, text, ref, tokens>. Rows of a conversation come in order within one partition.
    """

    def run(batches):
        conv, n, flat = object(), 0, Flattener()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                out = {k: [] for k in ("conv_id", "turn_no", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")}
                for r in batch.slice(lo, 1000).to_pylist():
                    if r["conv_id"] != conv:
                        conv, n, flat = r["conv_id"], 0, Flattener()
                    flat.seen = []
                    text, s, e = template(r["role"], flat.content(r["content"]))
                    for k, v in zip(out, (conv, n, text, s, e, flat.seen, sum(a["tokens"] for a in flat.seen)), strict=True):
                        out[k].append(v)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["turn_no"], pa.int64()), pa.array(out["formatted"], pa.string()), pa.array(out["loss_start"], pa.int64()), pa.array(out["loss_end"], pa.int64()), pa.array(out["attachments"], pa.list_(ATTACHMENT)), pa.array(out["expanded_tokens"], pa.int64())], list(out))

    return _ordered(df, content_col).mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what reading its formatted turns gives back; turns must still be in order."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, expanded_tokens bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        state = None

        def done():
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]]

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv_id"]:
                    if state:
                        rows.append(done())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(r["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                masked = unescape(r["formatted"][r["loss_start"] : r["loss_end"]])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(r["formatted"])
                state[6] += len(r["attachments"])
                state[7] += r["expanded_tokens"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(done(), types, strict=True)], names)

    return turns.mapInArrow(run, schema)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return digests(format_turns(rows.unionByName(more)))
