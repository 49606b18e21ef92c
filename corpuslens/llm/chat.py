r"""Operator 6: chat formatting with a grammar round trip.

A conversation's text is its turns, one after the other::

    conversation := turn*
    turn         := "### " name ":\n" body "\n</turn>\n"
    name         := System | User | Assistant | "=" percent-encoded role
    body         := characters in which every control string ("### ", "</turn>") has a
                    backslash before it; the parser takes one backslash off there

A turn is rendered as it is and parsed again with the deterministic parser; if the recovered role
and text differ from the source (the text holds a control string, escaped or not), the conflicting
places are escaped with one backslash more and the turn is parsed again, until it is identical.
A backslash that no control string follows is never touched.

Turns are rendered, checked and parsed one by one in a narrow pass: no conversation is gathered.
:func:`digests` then streams the rows of a conversation in order through running hashes, so memory
does not grow with a conversation; one conversation's turns meet in one task in sorted order.

The loss mask marks, in code points of the turn's rendered text, the body of assistant turns.

Defined cases: null text is empty, null role is the role ''; null conversation ids form one
conversation; rows are ordered by turn (nulls first), ties by role and text; repeated rows are
repeated turns; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
CONTROL = re.compile(r"### |</turn>")
ESCAPED = re.compile(r"\\(?=\\*(?:### |</turn>))")
CONFLICT = re.compile(r"(?=(?:### |</turn>))")
HEAD = re.compile(r"### (System|User|Assistant|=[A-Za-z0-9_.~%-]*):\n")
CLOSE = "\n</turn>\n"


class GrammarError(ValueError):
    pass


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, body unescaped, where the body begins and ends, where the turn ends) of the turn at a position."""
    head = HEAD.match(text, at)
    if not head:
        raise GrammarError(f"no turn at {at}")
    role = ROLES.get(head[1]) if head[1] in ROLES else unquote(head[1][1:])
    for m in CONTROL.finditer(text, head.end()):
        if text[m.start() - 1] == "\\":
            continue
        if m[0] != "</turn>" or text[m.start() - 1] != "\n" or m.start() - 1 < head.end() or text[m.end() : m.end() + 1] != "\n":
            raise GrammarError(f"control string at {m.start()}")
        begin, end = head.end(), m.start() - 1
        return role, unescape(text[begin:end]), begin, end, m.end() + 1
    raise GrammarError("turn without an end")


def parse(text: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(text):
        role, body, _, _, at = parse_turn(text, at)
        turns.append((role, body))
    return turns


def unescape(body: str) -> str:
    return re.sub(r"\\(### |</turn>)", r"\1", body)


def escape(body: str) -> str:
    return CONFLICT.sub(r"\\", body)


def render_turn(role: str, text: str) -> str:
    name = NAMES.get(role) or "=" + quote(role, safe="", errors="surrogatepass")
    body = text
    while True:
        out = f"### {name}:\n{body}{CLOSE}"
        try:
            got = parse_turn(out)
            if got[:2] == (role, text) and got[4] == len(out):
                return out
        except GrammarError:
            pass
        if body != text:
            raise GrammarError("an escaped turn does not parse back")  # the grammar rules this out
        body = escape(text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, rendered, loss_begin and loss_end (code points within rendered;
    null unless the turn is the assistant's).  A conversation's text is its rendered turns in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("loss_begin", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = ([x or "" for x in b.column(k).to_pylist()] for k in ("role", "text"))
            made = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            span = [parse_turn(m)[2:4] if r == "assistant" else (None, None) for m, r in zip(made, roles, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(made, pa.string()), pa.array([s[0] for s in span], pa.int64()), pa.array([s[1] for s in span], pa.int64())], schema=schema)

    columns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return columns.mapInArrow(trimmed(run), "conv_id long, turn long, role string, text string, rendered string, loss_begin long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations, one row a conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = object(), None, []

        def close() -> None:
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, rendered, lo, hi in zip(*(b.column(k).to_pylist() for k in ("conv_id", "rendered", "loss_begin", "loss_end")), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    learned = unescape(rendered[lo:hi])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered", "loss_begin", "loss_end")
    return ordered.mapInArrow(trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
