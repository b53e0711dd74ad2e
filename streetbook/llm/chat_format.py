"""Chat formatting of messages with typed content parts.

A message has a role and a list of parts, each a text or an attachment (image, audio or document). A visitor walks the parts
in order: texts are escaped, attachments become a placeholder of their kind, and each attachment is recorded with its place,
reference and the number of tokens that its placeholder will be expanded to. A conversation is written turn by turn::

    <|im_start|>role
    content<|im_end|>

Control strings inside roles and texts are escaped, and so cannot be taken for markup: a backslash follows the first character of
each, and one more where backslashes stand there already. ``unescape`` takes exactly that back, so any text is read again
as it was. The loss mask covers the content of assistant turns, in code points of the formatted conversation.

Every turn is flattened and escaped by itself, before any shuffle. Turns are then sorted into conversations and written in
one pass over each task's rows: a task holds one turn and a running digest for ``digests``, or one conversation for ``assemble``.

Rows go by turn, null turns first; equal turns by role and content. A null role is empty, null parts are left out, a null
list or text is empty, an unknown size counts as one token, an unknown kind of part is an error that names it. A null conversation is one of its own. Empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from streetbook.llm.shared import tasks

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that may not stand in a text as they are: those of this template and of other common ones.
CONTROL = (START, END, *PLACEHOLDERS.values(), "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
#: Tokens that one attachment takes at most, whatever its size says.
MOST = 2**40
ATTACHED = "attachments array<struct<kind:string,ref:string,start:long,tokens:long>>"
PARTS = "array<struct<type:string,text:string,ref:string,size:array<double>>>"

_control = "|".join(f"(?:{re.escape(c[0])})(?={{}}{re.escape(c[1:])})" for c in CONTROL)
_escape = re.compile(_control.replace("{}", r"\\*")).sub
_unescape = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL)).sub
_turn = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    return _escape(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _unescape(lambda m: m[0][0], text)


def known(size: list[float | None] | None, parts: int) -> bool:
    """Whether the first ``parts`` numbers of a size are there, finite and above zero."""
    return bool(size) and len(size) >= parts and all(x is not None and math.isfinite(x) and x > 0 for x in size[:parts])


def tokens_of(count: int) -> int:
    """A token count between 1 and ``MOST``, so that the sum over a conversation stays a long."""
    return max(1, min(count, MOST))


@dataclass
class Sizes:
    """How many tokens an attachment takes: by patches, by time and by pages.

    A size that is missing, null, not finite or not above zero is unknown: the attachment takes one token.
    """

    patch: float = 14.0
    audio_per_second: float = 25.0
    document_per_page: float = 256.0

    def image(self, size: list[float]) -> int:
        """``size``: width and height in pixels."""
        if not known(size, 2):
            return 1
        return tokens_of(math.ceil(size[0] / self.patch) * math.ceil(size[1] / self.patch))

    def audio(self, size: list[float]) -> int:
        """``size``: seconds."""
        return tokens_of(math.ceil(min(size[0] * self.audio_per_second, MOST))) if known(size, 1) else 1

    def document(self, size: list[float]) -> int:
        """``size``: pages."""
        return tokens_of(math.ceil(min(size[0] * self.document_per_page, MOST))) if known(size, 1) else 1


@dataclass
class Flat:
    """A message after the visit: its content and what stands at its placeholders."""

    content: str = ""
    attachments: list[dict] = field(default_factory=list)


class PartVisitor:
    """Flattens the parts of one message; one method for each kind of part."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes

    def flatten(self, parts: list[dict] | None) -> Flat:
        out = Flat()
        pieces: list[str] = []
        at = 0
        # neighbouring texts are escaped as one, or a control string cut in two would pass
        texts: list[str] = []
        for part in [p for p in parts or () if p is not None] + [{"type": "text", "text": ""}]:
            kind = part["type"]
            visit: Callable | None = getattr(self, f"visit_{kind}", None) if kind in ("text", *PLACEHOLDERS) else None
            if visit is None:
                raise ValueError(f"unknown content part: {kind!r}")
            if kind == "text":
                texts.append(visit(part))
                continue
            pieces.append(escape("".join(texts)))
            at += len(pieces[-1])
            texts = []
            mark, tokens = visit(part)
            out.attachments.append({"kind": kind, "ref": part.get("ref"), "start": at, "tokens": tokens})
            pieces.append(mark)
            at += len(mark)
        out.content = "".join(pieces) + escape("".join(texts))
        return out

    def visit_text(self, part: dict) -> str:
        return part["text"] or ""

    def visit_image(self, part: dict) -> tuple[str, int]:
        return PLACEHOLDERS["image"], self.sizes.image(part.get("size") or [])

    def visit_audio(self, part: dict) -> tuple[str, int]:
        return PLACEHOLDERS["audio"], self.sizes.audio(part.get("size") or [])

    def visit_document(self, part: dict) -> tuple[str, int]:
        return PLACEHOLDERS["document"], self.sizes.document(part.get("size") or [])


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    nothing = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.alias("ref"), F.lit(None).cast("array<double>").alias("size"))
    return F.array(part).cast(PARTS)


def segment(role: str, content: str) -> str:
    """A turn as it stands in the formatted conversation. A role is one line."""
    return f"{START}{escape(role).replace('%', '%25').replace(chr(10), '%0A')}\n{content}{END}\n"


def format_turns(messages: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Messages ``(conv_id, turn, role, parts)``, each with its ``segment`` of the conversation, one row each.

    ``loss`` is the part of the segment under the loss mask (null: none), ``attachments`` what stands at its placeholders.
    """
    visitor = PartVisitor(sizes or Sizes())
    schema = "conv_id long, turn long, role string, segment string, loss struct<start:long,end:long>, " + ATTACHED
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    listed = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            flat = [visitor.flatten(p) for p in batch.column(3).to_pylist()]
            heads = [len(segment(r, "")) - len(END) - 1 for r in roles]
            attached = [[a | {"start": a["start"] + h} for a in f.attachments] for f, h in zip(flat, heads)]
            masks = [{"start": h, "end": h + len(f.content)} if r == ASSISTANT else None for r, f, h in zip(roles, flat, heads)]
            columns = [batch.column(0), batch.column(1), pa.array(roles, pa.string())]
            columns += [pa.array([segment(r, f.content) for r, f in zip(roles, flat)], pa.string())]
            columns += [pa.array(masks, span), pa.array(attached, listed)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "segment", "loss", "attachments"])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(PARTS))
    return rows.mapInArrow(flatten, schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and contents of a formatted conversation or turn; contents are unescaped, placeholders stay."""
    return [(unescape(r.replace("%0A", "\n").replace("%25", "%")), unescape(c)) for r, c in _turn.findall(formatted)]


def _in_order(turns: DataFrame) -> DataFrame:
    rows = turns.repartition(tasks(turns.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "segment")


def assemble(turns: DataFrame) -> DataFrame:
    """One row for each conversation: formatted text, spans of the loss mask, attachments, expanded token count.

    Spans and the starts of attachments count code points of ``formatted``. One conversation has to fit into a row; where it
    may not, ``format_turns`` gives the same text in turns, and ``digests`` reads these in a stream.
    """
    schema = f"""conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>,
        {ATTACHED}, attachment_tokens long"""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, texts, spans, found, at = None, [], [], [], 0

        def done():
            row = {"conv_id": conv, "n_turns": len(texts), "formatted": "".join(texts), "loss_spans": spans}
            row |= {"attachments": found, "attachment_tokens": sum(a["tokens"] for a in found)}
            return pa.RecordBatch.from_pylist([row], schema=out)

        for batch in batches:
            for row in batch.to_pylist():
                if texts and row["conv_id"] != conv:
                    yield done()
                    texts, spans, found, at = [], [], [], 0
                conv = row["conv_id"]
                if row["loss"]:
                    spans.append({k: v + at for k, v in row["loss"].items()})
                found += [a | {"start": a["start"] + at} for a in row["attachments"]]
                texts.append(row["segment"])
                at += len(row["segment"])
        if texts:
            yield done()

    return _in_order(turns).mapInArrow(write, schema)


def digests(turns: DataFrame) -> DataFrame:
    """What a reader gets from the formatted conversations: counts and SHA-256 digests of all turns and of the loss mask."""
    schema = """conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,
        n_attachments long, attachment_tokens long"""
    names = [part.split()[0] for part in schema.replace("\n", " ").split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, out = None, 0, []
        every, loss, loss_chars, chars, attached, expanded = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

        def done():
            return (conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, expanded)

        def made(rows):
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if n and row["conv_id"] != conv:
                    out.append(done())
                    n, every, loss, loss_chars, chars, attached, expanded = 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                conv = row["conv_id"]
                for role, text in read_back(row["segment"]):
                    every.update(f"{role}\n{text}\n".encode())
                if row["loss"]:
                    text = unescape(row["segment"][row["loss"]["start"] : row["loss"]["end"]])
                    loss.update(text.encode())
                    loss_chars += len(text)
                n += 1
                chars += len(row["segment"])
                attached += len(row["attachments"])
                expanded += sum(a["tokens"] for a in row["attachments"])
            yield made(out)
            out = []
        if n:
            yield made([done()])

    return _in_order(turns).mapInArrow(read, schema)
