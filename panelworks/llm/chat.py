"""Chat formatting with typed content parts.

A turn's content is an array of parts. A visitor flattens them in order: text is escaped, every other
part becomes a numbered placeholder, and an attachment record keeps its reference and how many tokens
it expands to. Turns render one by one, so formatting is a map over rows; a conversation is the
rendered turns in order, and its parts of any length never have to meet in one row.

Template: ``<|turn|>role<|says|>text<|end|>`` and a line feed. In texts and roles a backslash is
doubled, and one is put behind the first character of every control string, so none can occur;
``unescape`` drops them again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
# The template's own marks and those of common chat templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL_AHEAD = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*)" + re.escape(END), re.S)

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<index: int, type: string, ref: string, tokens: long, start: long>"
RENDERED = f"piece string, body_start long, body_chars long, in_loss boolean, attachments array<{ATTACHMENT}>, media_tokens long"

#: Patch edge of an image in pixels, audio tokens in a second, tokens of a document's page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: str) -> str:
    return _CONTROL_AHEAD.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Visitor:
    """Flattens the parts of one turn, in order."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def _add(self, said: str) -> None:
        self.out.append(said)
        self.size += len(said)

    def _attach(self, part: dict, tokens: int) -> None:
        kind = part["type"]
        at = {"index": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": tokens, "start": self.size}
        self.attachments.append(at)
        self._add(f"<|{kind}:{at['index']}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = [math.ceil(max(0, part.get(edge) or 0) / IMAGE_PATCH) for edge in ("width", "height")]
        self._attach(part, tiles[0] * tiles[1])

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil(max(0.0, part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(0, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        """An unknown type keeps its place and its reference, and expands to nothing."""
        self._attach(part | {"type": re.sub(r"[^a-z0-9_]", "_", part["type"].lower())}, 0)


def render(role: str | None, parts: list[dict] | None, loss_roles: tuple[str, ...]) -> dict:
    """One turn: its text in the conversation, where its body lies, and its attachments."""
    visitor = Visitor()
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    head = f"{TURN}{escape(role or '')}{SAYS}"
    for a in visitor.attachments:
        a["start"] += len(head)
    return {
        "piece": head + "".join(visitor.out) + END,
        "body_start": len(head),
        "body_chars": visitor.size,
        "in_loss": role in loss_roles,
        "attachments": visitor.attachments,
        "media_tokens": sum(a["tokens"] for a in visitor.attachments),
    }


def read_back(piece: str) -> tuple[str, str]:
    """(role, text) of a rendered turn of text parts."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


def text_part(text: Column) -> Column:
    """One text part of a plain text column; null is an empty text."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
            null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, piece, body_start, body_chars, in_loss, attachments, media_tokens).

    ``turns`` has conv_id, turn, role and parts (array of PART); other columns are ignored. Null
    roles, parts and texts count as empty; null and repeated (conv_id, turn) rows are rendered like
    any other; an empty table gives no rows. Offsets are code points within ``piece``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r, p, loss_roles) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            attached = pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("start", pa.int64())]))
            kinds = {"piece": pa.string(), "body_start": pa.int64(), "body_chars": pa.int64(), "in_loss": pa.bool_(), "attachments": attached, "media_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([d[k] for d in done], t) for k, t in kinds.items())],
                names=["conv_id", "turn", "role", *kinds],
            )

    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "parts")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, turn long, role string, {RENDERED}")


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.media = conv_id, 0, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, size: int, in_loss: bool, media_tokens: int) -> None:
        role, text = read_back(piece)
        self.turns, self.chars, self.media = self.turns + 1, self.chars + len(piece), self.media + media_tokens
        self.said.update(f"{role}\n{text}\n".encode())
        if in_loss:
            learned = unescape(piece[start : start + size])
            self.loss_chars += len(learned)
            self.learned.update(learned.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.media


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "media_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """Digests of what is read back from ``format_turns``, one row for each conversation.

    A conversation's turns reach one task sorted (by turn, then role and text) and stream through its
    hashes, so its length does not matter for memory. Turns with a null conv_id make one conversation,
    which is read in order by one task as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(*turn)
            yield _digest_batch(done, kind)
        if now:
            yield _digest_batch([now.row()], kind)

    kind = rendered.schema["conv_id"].dataType.simpleString()
    return (
        rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
        .select("conv_id", "piece", "body_start", "body_chars", "in_loss", "media_tokens")
        .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, media_tokens long")
    )
