"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document.  A visitor flattens them in order; a part that is not
text becomes a numbered placeholder, its reference goes to the turn's attachment list, and the tokens that
the model will put in its place are counted.  The template marks a turn as

    <turn role>\n ... </turn>\n

Inside texts, roles and references the characters of these marks are escaped with a backslash, so no text can
forge a mark and the formatted conversation can be read back exactly.  The loss mask covers the body of the
assistant's turns.

One row of the output is a turn; a conversation is their concatenation in order.  Rows of a conversation are
streamed in order through one task and never gathered, however many it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TEXT, IMAGE, AUDIO, DOCUMENT = "text", "image", "audio", "document"
#: Tokens in place of an attachment without a size of its own.
DEFAULT_TOKENS = {IMAGE: 256, AUDIO: 150, DOCUMENT: 512}
PART_SCHEMA = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
FORMATTED_SCHEMA = "conv_id long, place long, formatted string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,tokens:int>>, expanded_tokens long"
ASSISTANT = "assistant"
_OPEN, _CLOSE = "<turn {}>\n", "</turn>\n"
_ESCAPED = re.compile(r"[\\<>\[\]]")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"\\.|<(?:image|audio|document) \d+>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.expanded_tokens = 0

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or TEXT
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part kind {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, part: dict) -> None:
        kind = part["kind"]
        tokens = part.get("tokens") if part.get("tokens") is not None else DEFAULT_TOKENS[kind]
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})
        self.expanded_tokens += int(tokens)
        self.out.append(f"<{kind} {len(self.attachments)}>")

    visit_image = visit_audio = visit_document = _attach


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict], int]:
    """Formatted turn, start and end of the loss mask in it (equal outside the assistant's turns), attachments, tokens."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    head, body = _OPEN.format(escape(role or "")), "".join(visitor.out)
    loss = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
    return head + body + _CLOSE, *loss, visitor.attachments, visitor.expanded_tokens


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; attachments leave nothing in the text."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(_PLACEHOLDER.sub(lambda x: x[0] if x[0][0] == "\\" else "", m[2]))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``FORMATTED_SCHEMA``: one row per turn of ``turns`` (conv_id, turn, role, and text or parts).

    ``parts`` (``PART_SCHEMA``), where the column exists and is not null, stands for the text.  A null text is empty, a
    null role is an empty role.  Turns with equal numbers are ordered by role, then text; a null turn comes
    first.  Rows of a null conv_id form one conversation.  An empty table gives no rows; an unknown kind of part raises.
    """
    bounded_batches(turns.sparkSession)
    plain = F.array(F.struct(F.lit(TEXT).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    parts = F.coalesce(F.col("parts").cast(PART_SCHEMA), plain) if "parts" in turns.columns else plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place = (), 0
        for batch in batches:
            rows = {k: [] for k in ("conv_id", "place", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")}
            for own, role, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                conv, place = own, (place + 1 if own == conv else 0)
                for name, value in zip(rows, (own, place, *format_turn(role, content)), strict=True):
                    rows[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, kinds, strict=True)], names=list(rows))

    ordered = _in_order(turns.select("conv_id", "turn", "role", "text", parts.alias("content")), "turn", "role", "text")
    return ordered.select("conv_id", "role", "content").mapInArrow(run, FORMATTED_SCHEMA)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of the conversations, read from the formatted turns alone.

    ``in_order``: the rows are those of ``format_conversations`` as it hands them on, so they need no shuffle; rows that were
    written and read again do.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  Hashes and counts are carried
    from row to row; no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = (), None

        def row(conv, s) -> tuple:
            return conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

        for batch in batches:
            done = []
            for own, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        done.append(row(conv, state))
                    conv, state = own, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                role, said = parse_turn(text)
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["n"] += 1
                state["chars"] += len(text)
                if end > start:
                    learned = unescape(_PLACEHOLDER.sub(lambda x: x[0] if x[0][0] == "\\" else "", text[start:end]))
                    state["loss_chars"] += len(learned)
                    state["loss"].update(learned.encode())
            yield _digests(done)
        if state is not None:
            yield _digests([row(conv, state)])

    rows = formatted.select("conv_id", "place", "formatted", "loss_start", "loss_end")
    return (rows if in_order else _in_order(rows, "place")).select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
