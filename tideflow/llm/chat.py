"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens it into one text: text parts are
escaped, image, audio and document parts become ordered placeholders, and the attachment each
placeholder stands for is recorded with the number of tokens that it expands to. The template
puts markers round every turn; the loss mask covers the assistant's content. Formatting is a
function of one turn, so a conversation of any length is formatted without gathering it.

Escaping is reversible: ``\\`` becomes ``\\\\``, and the first character of a control string inside
a text becomes ``\\l`` (for ``<``) or ``\\b`` (for ``[``), so that no control string remains.

Defined results: a null text or role is the empty text; turns with the same number are ordered
by role, then text; a null conversation id is a conversation of its own; a conversation without
an assistant turn has an empty loss text; an empty table gives an empty result. Extra columns are
ignored.
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

from tideflow.llm.common import extended, shuffle_width

# The control strings of this template and of common public chat templates.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
OPENERS = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
BACK = {code[1]: plain for plain, code in OPENERS.items()}
SPECIAL = re.compile(r"\\|[<\[](?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS})) + ")")
ESCAPED = re.compile(r"\\([lb\\])")
TURN = re.compile(r"<\|start\|>(.*?)<\|message\|>(.*?)<\|end\|>", re.S)
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: OPENERS[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[1]], text)


@dataclass
class Flattener:
    """Visits the parts of one turn in order. Sizes that are missing count as one tile, second or page."""

    tile: int = 512
    tokens_a_tile: int = 170
    tokens_a_second: float = 25.0
    tokens_a_page: int = 800
    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.content.append(escape(text))
        self.tokens += len(text.split())

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part.get(k) or 1) / self.tile)) for k in ("width", "height"))
        self.attach(part, across * down * self.tokens_a_tile)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part.get("seconds") or 1) * self.tokens_a_second)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, part.get("pages") or 1) * self.tokens_a_page)

    def visit_unknown(self, part: dict) -> None:
        """A part of another type is kept as an attachment that expands to its marker alone."""
        self.attach(part, 1)

    def attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        kind = re.sub(r"\W", "", part.get("type") or "unknown")
        self.content.append(f"<|{kind}:{place}|>")
        self.attachments.append({"place": place, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens


def format_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    """One row a turn: (conv_id, turn, role, formatted, loss_start, loss_chars, attachments, expanded_tokens).

    ``content`` names a string column (one text part a turn) or a column of type PARTS. The loss
    span counts code points of ``formatted``; it is empty for roles other than assistant.
    """
    simple = dict(turns.dtypes)[content] == "string"
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col(content).alias("text"))) if simple else F.col(content)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("__parts"))

    def make():
        def work(part: pa.RecordBatch):
            out = [[], [], [], [], []]
            for role, pieces in zip(part.column("role").to_pylist(), part.column("__parts").to_pylist()):
                flat = Flattener()
                for piece in pieces or ():
                    if piece:
                        flat.visit(piece)
                text, head = "".join(flat.content), f"{START}{escape(role)}{MESSAGE}"
                for column, value in zip(out, (head + text + END, len(head), len(text) if role == "assistant" else 0, flat.attachments, flat.tokens)):
                    column.append(value)
            return out

        return work

    return extended(rows, "formatted string, loss_start int, loss_chars int, attachments array<struct<place:int,type:string,ref:string,tokens:int>>, expanded_tokens long", make, ("__parts",))


def said(formatted: Column, loss_start: Column) -> Column:
    """What a formatted turn says, unescaped: pairs of backslashes divide it into parts whose other codes stand alone."""
    content = formatted.substr(loss_start + 1, F.char_length(formatted) - loss_start - len(END))
    parts = F.transform(F.split(content, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(parts, "\\")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the formatted turns of each conversation back, in order, and hash what they say.

    Conversations are hash-partitioned and sorted by turn; each task streams over its rows and
    keeps only running hashes, so its memory does not depend on a conversation's length.
    """
    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_chars", F.size("attachments").cast("long").alias("attached"), "expanded_tokens")
    dealt = rows.repartition(shuffle_width(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", said(F.col("formatted"), F.col("loss_start")))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, done = None, None, []

        def ended() -> None:
            if state is not None:
                done.append([own, state["turns"], state["all"].hexdigest(), state["loss"], state["lost"].hexdigest(), state["chars"], state["attached"], state["tokens"]])

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * len(names)
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            for conv, text, start, length, attached, tokens in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_chars", "attached", "expanded_tokens"))):
                if state is None or conv != own:
                    ended()
                    own, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "lost": hashlib.sha256(), "chars": 0, "attached": 0, "tokens": 0}
                for role, said in TURN.findall(text):
                    state["turns"] += 1
                    state["all"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                if length:
                    plain = unescape(text[start : start + length])
                    state["loss"] += len(plain)
                    state["lost"].update(plain.encode())
                state["chars"] += len(text)
                state["attached"] += attached
                state["tokens"] += tokens
            if len(done) > 1000:
                yield flushed()
        ended()
        yield flushed()

    return dealt.mapInArrow(run, schema)
