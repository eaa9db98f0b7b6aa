"""Chat formatting of turns whose content is a list of typed parts.

A turn becomes ``<|im_start|>role``, a line end, its content, ``<|im_end|>`` and a line end. Text, image, audio
and document parts are visited in order: runs of text are written with their control strings escaped,
every other part is a placeholder, its reference recorded with the number of tokens it will take once it
is expanded. The loss mask holds the text runs of assistant turns as spans of the turn's formatted text.

Escaping puts a backslash into every ``<|``, behind those that are there already, so no escaped text has
a control string and the way back takes out exactly one. Adjacent text parts are escaped as one run, or a
control string could form where they meet.

Turns are formatted where they lie, one by one, and a conversation is its turns in order, so no row holds
more than a turn. Only what is asked of whole conversations sorts them; a conversation is then read turn by
turn, and what is kept of it is the state of two digests, however long it is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
# What ``content`` holds: a part has what its kind needs, the rest is null.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
NEW = "formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<nth:int,at:int,kind:string,ref:string,tokens:long>>, text_tokens long, expanded_tokens long"


@dataclass(frozen=True)
class Expansion:
    """Tokens that placeholders take: one per square patch of an image, per part of a second, per page."""

    patch: int = 28
    image: int = 256  # an image of unknown size
    audio_per_second: float = 25.0
    audio: int = 750  # a sound of unknown length
    page: int = 1024


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Flattener) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str | None
    width: int | None = None
    height: int | None = None

    def accept(self, visitor: Flattener) -> None:
        visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str | None
    seconds: float | None = None

    def accept(self, visitor: Flattener) -> None:
        visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str | None
    pages: int | None = None

    def accept(self, visitor: Flattener) -> None:
        visitor.document(self)


Part = Text | Image | Audio | Document


def part_of(row: dict | None) -> Part:
    """The part that a struct of ``PARTS`` says. No part and no kind are text; an unknown kind is a document."""
    row = row or {}
    match row.get("kind"):
        case None | "text":
            return Text(row.get("text") or "")
        case "image":
            return Image(row.get("ref"), row.get("width"), row.get("height"))
        case "audio":
            return Audio(row.get("ref"), row.get("seconds"))
        case _:
            return Document(row.get("ref"), row.get("pages"))


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}


def _role(role: str) -> str:
    """On one line and without bars."""
    return re.sub(r"[\\\n|]", lambda m: _ROLE[m[0]], role)


def _role_back(role: str) -> str:
    back = {v: k for k, v in _ROLE.items()}
    return re.sub(r"\\.", lambda m: back[m[0]], role)


@dataclass
class Flattener:
    """Visits the parts of one turn, in order, and writes its content from code point ``at`` on."""

    expansion: Expansion
    at: int
    pieces: list[str] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    _open: list[str] = field(default_factory=list)

    def text(self, part: Text) -> None:
        self._open.append(part.text)

    def image(self, part: Image) -> None:
        known, patch = part.width and part.height, self.expansion.patch
        tokens = math.ceil(part.width / patch) * math.ceil(part.height / patch) if known else self.expansion.image
        self._placed("image", part.ref, tokens)

    def audio(self, part: Audio) -> None:
        known = part.seconds is not None and math.isfinite(part.seconds)
        self._placed("audio", part.ref, math.ceil(part.seconds * self.expansion.audio_per_second) if known else self.expansion.audio)

    def document(self, part: Document) -> None:
        self._placed("document", part.ref, self.expansion.page * (1 if part.pages is None else part.pages))

    def _placed(self, kind: str, ref: str | None, tokens: int) -> None:
        self.closed()
        self.attachments.append({"nth": len(self.attachments), "at": self.at, "kind": kind, "ref": ref, "tokens": max(tokens, 1)})
        self._write(f"<|{kind}|>")

    def _write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def closed(self) -> Flattener:
        """The run of text so far is written."""
        if run := escaped("".join(self._open)):
            self.runs.append((self.at, self.at + len(run)))
            self._write(run)
        self._open = []
        return self


@dataclass(frozen=True)
class Formatted:
    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]
    runs: list[str]


def format_turn(role: str, parts: Sequence[Part], trained: Sequence[str] = TRAINED, expansion: Expansion = Expansion()) -> Formatted:
    head = f"{BEGIN}{_role(role)}\n"
    visitor = Flattener(expansion, len(head))
    for part in parts:
        part.accept(visitor)
    content = "".join(visitor.closed().pieces)
    text = f"{head}{content}{END}\n"
    return Formatted(text, visitor.runs if role in trained else [], visitor.attachments, [text[a:b] for a, b in visitor.runs])


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_PLACED = re.compile(r"<\|(image|audio|document)\|>")


def read_turns(formatted: str, refs: Sequence[str | None] = ()) -> list[tuple[str, list[tuple[str, str | None]]]]:
    """Role and parts, ``("text", text)`` or ``(kind, ref)``, of each turn of a formatted text."""
    found, at, refs = [], 0, iter(refs)
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        at, parts = turn.end(), []
        for i, piece in enumerate(_PLACED.split(turn[2])):
            if i % 2:
                parts.append((piece, next(refs, None)))
            elif piece:
                parts.append(("text", unescaped(piece)))
        found.append((_role_back(turn[1]), parts))
    return found


def text_part(text: Column) -> Column:
    """Content of one text part; null text is empty."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[null.alias(c) for c in ("ref", "width", "height", "seconds", "pages")])
    return F.array(part).cast(PARTS)


def _counter(tokenizer: str | None) -> Callable[[list[str]], list[int]] | None:
    if tokenizer is None:
        return None
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer)
    return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]


def format_turns(
    turns: DataFrame,
    role_col: str = "role",
    content_col: str = "content",
    trained: Sequence[str] = TRAINED,
    expansion: Expansion = Expansion(),
    tokenizer_path: str | None = None,
) -> DataFrame:
    """All columns of ``turns`` but its content, plus those of ``NEW``.

    ``content_col`` is of type ``PARTS``. ``loss`` and ``at`` count code points of ``formatted``.
    ``text_tokens`` counts the text runs by the tokenizers file at ``tokenizer_path``, null without one;
    ``expanded_tokens`` adds the placeholders' tokens and the two control strings. A null role is an empty
    one; null content has no parts. Columns with the names of the new ones are replaced.
    """
    new = T._parse_datatype_string(NEW)
    rest = [c for c in turns.columns if c != content_col and c not in new.names]
    # A tokenizers file is a few megabytes, whatever the data.
    tokenizer = turns.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read()) if tokenizer_path else None
    shape = turns.select(*rest, F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.col(content_col).cast(PARTS).alias("_content"))
    out = T.StructType([*[shape.schema[c] for c in rest], *new.fields])
    kinds = [
        pa.string(),
        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        pa.list_(pa.struct([("nth", pa.int32()), ("at", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
        pa.int64(),
        pa.int64(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer.value if tokenizer else None)
        for batch in batches:
            names = batch.schema.names
            roles, contents = (batch.column(names.index(c)).to_pylist() for c in ("_role", "_content"))
            made = [format_turn(r, [part_of(p) for p in c or []], trained, expansion) for r, c in zip(roles, contents)]
            text_tokens = [None] * len(made)
            if count:
                lengths = iter(count([run for m in made for run in m.runs]))
                text_tokens = [sum(next(lengths) for _ in m.runs) for m in made]
            columns = [
                [m.text for m in made],
                [[{"start": a, "end": b} for a, b in m.loss] for m in made],
                [m.attachments for m in made],
                text_tokens,
                [(t or 0) + sum(a["tokens"] for a in m.attachments) + 2 for t, m in zip(text_tokens, made)],
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in rest] + [pa.array(c, k) for c, k in zip(columns, kinds)], [*rest, *new.names]
            )

    return shape.mapInArrow(run, out)


def read_back(formatted: DataFrame) -> DataFrame:
    """All columns of ``format_turns``' rows plus ``read_role`` and ``read_parts``, array<struct<kind,value>>, read from
    ``formatted``; ``value`` is the text, or the reference of the attachment."""
    parts = "array<struct<kind:string,value:string>>"
    out = T.StructType([*formatted.schema.fields, *T._parse_datatype_string(f"read_role string, read_parts {parts}").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, roles, found = batch.schema.names, [], []
            for text, attached in zip(batch.column(names.index("formatted")).to_pylist(), batch.column(names.index("attachments")).to_pylist()):
                ((role, read),) = read_turns(text, [a["ref"] for a in attached])
                roles.append(role)
                found.append([{"kind": k, "value": v} for k, v in read])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roles, pa.string()), pa.array(found, kind)], [*names, "read_role", "read_parts"])

    return formatted.mapInArrow(run, out)


class _Digest:
    """What is kept of a conversation while it is read."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.tokens = self.attachments = 0

    def read(self, formatted: str, loss: list[dict], attached: list[dict], tokens: int) -> None:
        for role, parts in read_turns(formatted, [a["ref"] for a in attached]):
            text = "".join(v for k, v in parts if k == "text")
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescaped(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)
        self.attachments += len(attached)
        self.tokens += tokens

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.attachments, self.tokens)


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A row for each conversation, read from ``formatted``, ``loss`` and ``attachments`` of its turns in order.

    ``turns_sha256`` is of each turn's role, a line end, its text and a line end; ``loss_sha256`` and
    ``loss_chars`` are of the text under the loss mask. Turns of the same number follow each other by their
    formatted text, null turns come first, and rows without an id are one conversation. A conversation is
    read by one task, since its digest is a chain, a batch at a time.
    """
    read = formatted.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), "formatted", "loss", "attachments", "expanded_tokens")
    ordered = read.repartition("_id").sortWithinPartitions("_id", "_turn", "formatted").drop("_turn")
    new = T._parse_datatype_string(_DIGEST)
    out = T.StructType([T.StructField(id_col, read.schema["_id"].dataType), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([d[0] for d in done], id_type)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([d[i + 1] for d in done]) for i in range(len(new))]], [id_col, *new.names])

        for batch in batches:
            done, id_type = [], batch.schema.field("_id").type
            for key, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or key != last:
                    if state is not None:
                        done.append((last, *state.row()))
                    last, state = key, _Digest()
                state.read(*turn)
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([(last, *state.row())])

    return ordered.mapInArrow(run, out)
