"""Chat formatting with typed content parts.

A turn is written as ``<s>role\\ncontent</s>``.  A visitor walks the turn's parts
in order: text is escaped, every image, audio or document becomes a numbered
placeholder, its reference is recorded, and its size is turned into the number
of tokens it will expand to.  Escaping puts a backslash behind every ``<``, ``[``
and backslash, so that no control string of this or another bracket template can
stand in a text, and is undone by ``unescape``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

OPEN, CLOSE = "<s>", "</s>"
#: A line end inside a role.
LINE_END = "[n]"
#: Tokens per unit of size: image tiles, audio seconds, document pages.
EXPANSION = {"image": 256.0, "audio": 25.0, "document": 640.0}
TRAINED_ROLES = ("assistant",)

_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"([\\<\[])\\")
_PLACEHOLDER = re.compile(r"<(image|audio|document):\d+>")
_TURN = re.compile(r"<s>(.*?)\n(.*)</s>", re.S)

TURNS_SCHEMA = (
    "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<kind:string,ref:string,tokens:bigint>>, expanded_tokens long"
)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn."""

    def __init__(self, expansion: dict[str, float]):
        self.expansion, self.pieces, self.attachments = expansion, [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        """An unknown kind keeps its text and is otherwise ignored."""
        self.visit_text(part)

    def _attach(self, kind: str, part: dict) -> None:
        size = part.get("size")
        size = float(size) if size is not None and math.isfinite(size) and size > 0 else 1.0
        self.pieces.append(f"<{kind}:{len(self.attachments)}>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": math.ceil(size * self.expansion[kind])})


def format_turn(role: str | None, parts: list[dict], expansion: dict[str, float] = EXPANSION) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its content, attachments)."""
    visitor = PartVisitor(expansion)
    for part in parts:
        visitor.visit(part)
    head = OPEN + escape(role or "").replace("\n", LINE_END) + "\n"
    body = "".join(visitor.pieces)
    return head + body + CLOSE, len(head), len(head) + len(body), visitor.attachments


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) back from a formatted turn; placeholders are left out."""
    role, body = _TURN.fullmatch(formatted).groups()
    return unescape(role.replace(LINE_END, "\n")), unescape(_PLACEHOLDER.sub("", body))


def format_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, expansion: dict[str, float] | None = None, trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """One formatted row per turn, with the span of its content under the loss.

    ``parts`` names a column of array<struct<type,text,ref,size>>; without it the
    text column is the only part.  Null texts, null parts and null lists are
    empty; a null role is empty; a missing or non-positive size counts as one unit.  Roles outside ``trained`` have null
    spans.  Other columns are left behind, whatever their names.
    """
    rates = dict(EXPANSION) | (expansion or {})
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text")))
    rows = df.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("r"), content.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, [x or {} for x in p or []], rates) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            roles = batch.column(2).to_pylist()
            under = [r in trained for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if u else None for m, u in zip(made, under, strict=True)], pa.int32()),
                    pa.array([m[2] if u else None for m, u in zip(made, under, strict=True)], pa.int32()),
                    pa.array([m[3] for m in made], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                    pa.array([sum(a["tokens"] for a in m[3]) for m in made], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return common.arrow_map(rows, run, TURNS_SCHEMA)


class _Reader:
    """Reads the formatted turns of one conversation back, one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        role, text = parse_turn(formatted)
        self.turns += 1
        self.formatted_chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if start is not None:
            under = unescape(_PLACEHOLDER.sub("", formatted[start:end]))
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its formatted turns hold.

    Conversations meet by one shuffle and are read as a stream in the order of
    turn, role and text, so a long one is never held in memory.  Rows with a null
    ``conv_id`` form one conversation of their own.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Reader | None = None
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Reader(conv)
                current.add(text, start, end)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(current.row(), kinds, strict=True)], names=names)

    ordered = turns.select("conv_id", "formatted", "loss_start", "loss_end", "turn", "role").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return common.arrow_map(ordered.drop("turn", "role"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
