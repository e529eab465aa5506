"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them into one string with
ordered placeholders, and records for each attachment where it stands, what it refers to and how many
tokens it will expand to. Messages become turns of one template; control strings inside texts, and the sign
that escapes them, are escaped, so the template's own marks are the only ones and the output can be parsed back.

Rows are formatted before they are shuffled; a conversation is put together in order of its turns, one turn after another,
so it may have any length: its digests are taken as the turns pass.

Defined results: null texts and null parts are empty; a null role is an empty one; equal turns of one
conversation go by role and text, and repeated rows are turns of their own; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, tasks, tidy

#: Fixed values of the template. A turn: BOT role EOR text EOT.
BOT, EOR, EOT = "<s>[INST] ", " [/INST]\n", "</s>\n"
#: Strings that a text can't hold as they are; each gets ESCAPE after its first character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|image|>", "<|audio|>", "<|document|>")
ESCAPE = "\\"
#: Turns that a task puts together, conversations being dealt whole.
TASK_TURNS = 100_000
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_OPENING = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|\|(?:image|audio|document)\|>)")
_ESCAPED = re.compile(r"([<\[])(\\+)(?=/?s>|/?INST\]|\|(?:image|audio|document)\|>)")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    """One more escape sign after the first character of each control string, escaped already or not."""
    return _OPENING.sub(lambda m: m[1] + m[2] + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][:-1], text)


@dataclass
class Attachment:
    kind: str
    ref: str
    position: int
    tokens: int


@dataclass
class Flattener:
    """The visitor: one method per kind of part."""

    patch: int = 14
    per_second: float = 25.0
    per_page: int = 256
    text: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    size: int = 0

    def visit(self, part: dict) -> "Flattener":
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown kind of part: {kind}")
        method(part)
        return self

    def _add(self, s: str) -> None:
        self.text.append(s)
        self.size += len(s)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append(Attachment(kind, part.get("ref") or "", self.size, tokens))
        self._add(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.per_page)


def flatten(parts: list[dict] | None, **sizes) -> Flattener:
    out = Flattener(**sizes)
    for p in parts or []:
        if p is not None:
            out.visit(p)
    return out


def turn(role: str, body: str) -> str:
    return BOT + escape(role) + EOR + body + EOT


def read_turns(formatted: str) -> list[tuple[str, str, int]]:
    """Role, unescaped text and place of the text of each turn."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in _TURN.finditer(formatted)]


def format_turns(rows: DataFrame, parts: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """Per row: conv_id, turn, role, formatted (the turn in the template), loss (whether it is trained on), attachments and their expanded tokens; no shuffle."""
    prepare(rows.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [flatten(p) for p in b.column(3).to_pylist()]
            roles = b.column(2).to_pylist()
            lead = [len(BOT + escape(r) + EOR) for r in roles]
            attached = [[{"kind": a.kind, "ref": a.ref, "position": n + a.position, "tokens": a.tokens} for a in f.attachments] for n, f in zip(lead, flat)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([turn(r, "".join(f.text)) for r, f in zip(roles, flat)], pa.string()), pa.array([r == "assistant" for r in roles]), pa.array(attached, kind), pa.array([sum(a.tokens for a in f.attachments) for f in flat], pa.int64())], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "attached_tokens"])

    given = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.cast(PARTS).alias("parts"))
    return given.mapInArrow(tidy(run), "conv_id long, turn long, role string, formatted string, loss boolean, attachments array<struct<kind:string,ref:string,position:long,tokens:long>>, attached_tokens long")


def conversations(turns: DataFrame) -> DataFrame:
    """Formatted turns put together: conv_id, formatted, loss_spans, attachments (places in the whole), attached_tokens. For conversations that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted", "loss", "attachments", "attached_tokens")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t"))
    step = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("loss"), F.expr("CAST(array() AS array<struct<kind:string,ref:string,position:bigint,tokens:bigint>>)").alias("attached")),
        lambda s, x: F.struct(
            (s.at + F.length(x.formatted)).alias("at"),
            F.when(x.loss, F.array_append(s.loss, F.struct((s.at + F.length(F.lit(BOT + EOR)) + F.length(x.role)).alias("start"), (s.at + F.length(x.formatted) - F.length(F.lit(EOT))).alias("end")))).otherwise(s.loss).alias("loss"),
            F.concat(s.attached, F.transform(x.attachments, lambda a: F.struct(a.kind.alias("kind"), a.ref.alias("ref"), (a.position + s.at).alias("position"), a.tokens.alias("tokens")))).alias("attached"),
        ),
    )
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x.formatted), "").alias("formatted"), step.alias("s"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x.attached_tokens).alias("attached_tokens")).select("conv_id", "formatted", F.col("s.loss").alias("loss_spans"), F.col("s.attached").alias("attachments"), "attached_tokens")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, formatted, attachments, attached_tokens) sorted by conversation and turn to the digests of what is read back of each."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attached_tokens", "attachments_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    now, state, out = object(), None, []

    def done() -> None:
        if state:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:7], state[7].hexdigest()))

    for b in batches:
        for conv, formatted, attached, tokens in zip(*(b.column(k).to_pylist() for k in range(4))):
            if conv != now:
                done()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256()]
            for a in attached:
                state[7].update(f"{a['kind']} {state[4] + a['position']} {a['tokens']} {a['ref']}\n".encode())
            state[5] += len(attached)
            state[6] += tokens
            state[4] += len(formatted)
            for role, text, _ in read_turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out = []
    done()
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def text_parts(text_col: str = "text") -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def chat_report(rows: DataFrame, parts: Column | None = None) -> DataFrame:
    """Per conversation, read back from its formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; and of
    its attachments: how many, their expanded tokens, and the digest of a line for each (kind, place in the whole, tokens, reference)."""
    spark = rows.sparkSession
    turns = format_turns(rows, text_parts() if parts is None else parts)
    n = tasks(spark, rows.count(), TASK_TURNS)
    dealt = turns.select("conv_id", "turn", "role", "formatted", "attachments", "attached_tokens").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted", "attachments")
    return dealt.select("conv_id", "formatted", "attachments", "attached_tokens").mapInArrow(tidy(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long, attachments_sha256 string")


def sample_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns that look like a template."""
    return spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
