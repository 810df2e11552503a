"""Chat formatting with typed content parts.

A visitor walks over the parts of a turn. Text is escaped; an image, a sound or a document becomes a
numbered placeholder, and the visitor records what the placeholder stands for and into how many tokens
a model expands it. One segment comes out per turn; the segments of a conversation, in order of turn,
are its formatted text. Turns are formatted where they lie, so only finished segments are shuffled.

Control strings start with ``<|``. In texts, ``<``, any number of backslashes and ``|`` get one more
backslash, so no text can hold a control string, and taking the backslash out again restores the text.

Defined results: a null text, role or part list is empty; a part of unknown type is an error; null
sizes of attachments count as 0, and every attachment has at least one token. Turns sort by number (null
first), then role, then segment, so ties and repeated rows have one order. All rows whose conv_id is null form
one conversation. Other columns of the input are not used. An empty table gives an empty result.
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

PART = "type string, text string, uri string, width int, height int, seconds double, pages int"
SEGMENTS = (
    "conv_id bigint, turn bigint, role string, segment string, loss array<struct<start: int, end: int>>, "
    "attachments array<struct<place: int, type: string, uri: string, tokens: bigint>>, expanded_tokens bigint"
)
_TO_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document):\d+\|>")


@dataclass(frozen=True)
class Rates:
    """Tokens of an attachment: one per image patch, a rate per second of sound and per document page."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 768


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on a line of its own, so line ends are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class PartVisitor:
    """Collects the body of one turn; ``visit`` picks the method by the part's type."""

    rates: Rates
    body: list[str] = field(default_factory=list)
    length: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.unknown)(part)

    def unknown(self, part: dict) -> None:
        raise ValueError(f"content part of unknown type {part['type']!r}")

    def visit_text(self, part: dict) -> None:
        start = self.length
        self._put(escape(part["text"] or ""))
        self.texts.append((start, self.length))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part[k] or 0) / self.rates.patch) for k in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * self.rates.per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * self.rates.per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments) + 1
        self._put(f"<|{part['type']}:{place}|>")
        self.attachments.append({"place": place, "type": part["type"], "uri": part["uri"], "tokens": max(1, tokens)})

    def _put(self, piece: str) -> None:
        self.body.append(piece)
        self.length += len(piece)


def text_part(text: Column) -> Column:
    """Plain text as a list of one text part."""
    nothing = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *rest))


def format_turns(turns: DataFrame, rates: Rates = Rates(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment per row of ``turns`` (conv_id, turn, role, parts: array of ``PART``).

    ``loss`` has the spans of the segment, in code points, whose text is trained on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("segment", "loss", "attachments", "expanded_tokens")}
            for role, parts in zip(batch["role"], batch["parts"]):
                role = role.as_py() or ""
                visitor = PartVisitor(rates)
                for part in parts.as_py() or []:
                    visitor.visit(part)
                head = f"<|im_start|>{escape_role(role)}\n"
                spans = visitor.texts if role in loss_roles else []
                out["segment"].append(f"{head}{''.join(visitor.body)}<|im_end|>\n")
                out["loss"].append([{"start": len(head) + a, "end": len(head) + b} for a, b in spans])
                out["attachments"].append(visitor.attachments)
                out["expanded_tokens"].append(sum(x["tokens"] for x in visitor.attachments))
            place = pa.struct([("place", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["conv_id"],
                    batch["turn"],
                    batch["role"],
                    pa.array(out["segment"], pa.string()),
                    pa.array(out["loss"], pa.list_(span)),
                    pa.array(out["attachments"], pa.list_(place)),
                    pa.array(out["expanded_tokens"], pa.int64()),
                ],
                ["conv_id", "turn", "role", "segment", "loss", "attachments", "expanded_tokens"],
            )

    # Columns are named once more so that extra or differently ordered ones do no harm.
    plain = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "parts")
    return plain.mapInArrow(run, SEGMENTS)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_attachments bigint, expanded_tokens bigint"
)


class _Digest:
    """What one conversation says, read back from its segments; memory does not grow with its turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = self.places = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict], places: int, tokens: int) -> None:
        found = _SEGMENT.fullmatch(segment)
        if not found:
            raise ValueError("not a formatted turn")
        role, text = unescape_role(found[1]), unescape(_PLACE.sub("", found[2]))
        self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            part = unescape(segment[span["start"] : span["end"]])
            self.loss_chars += len(part)
            self.loss.update(part.encode())
        self.turns += 1
        self.chars += len(segment)
        self.places += places
        self.tokens += tokens

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.chars, self.places, self.tokens,
        )


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, digests of the turns and of the text under the loss mask, parsed from the segments.

    A digest needs a conversation's turns in one order, so a conversation is read by one task; it streams
    through and holds one turn at a time.
    """
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        now = None
        for batch in batches:
            done = []
            each = zip(*(batch[c] for c in ("conv_id", "segment", "loss", "n_places", "expanded_tokens")))
            for conv_id, segment, loss, places, tokens in each:
                key = conv_id.as_py()
                if now is None or now.conv_id != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                now.add(segment.as_py(), loss.as_py(), places.as_py(), tokens.as_py())
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now.row()])

    ordered = (
        segments.select("conv_id", "turn", "role", "segment", "loss", F.size("attachments").alias("n_places"), "expanded_tokens")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
    )
    return ordered.mapInArrow(run, DIGESTS)
