"""Chat formatting from an event log.

Events are folded per message, messages are rendered per conversation. Both
steps run over sorted partitions and hold one message, or one segment of about
``segment_chars``, whatever a conversation's length. Folding spreads a long
conversation over tasks by message, rendering by ranges of messages, reading
back by segment; only the digest of a conversation runs over its segments in
order.

Events of a message, by ``seq``: ``message`` begins one with a role and text,
``delta`` appends, ``edit`` replaces the text, ``regenerate`` empties it for
the deltas that follow, ``delete`` removes it.

Turns are marked ``[SYS] .. [/SYS]``, ``[INST] .. [/INST]``, ``<s>..</s>`` or
``[ROLE:name]..[/ROLE]``, a line end after each. In texts a backslash is
doubled and one stands before every mark, so that no text can form a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import lean, sliced, written

MARKS = ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]", "<s>", "</s>")
_MARK = re.compile("|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s>"}
CLOSE = {"system": " [/SYS]\n", "user": " [/INST]\n", "assistant": "</s>\n"}
ROLE_CLOSE = "[/ROLE]\n"
EVENT_KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    return _MARK.sub(r"\\\g<0>", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's characters, and where its escaped text begins and ends in them."""
    # "]" would end the name of a role; "%5D" and "%25" stand for it and for "%".
    begin = OPEN.get(role) or f"[ROLE:{escape(role.replace('%', '%25').replace(']', '%5D'))}]"
    body = escape(text)
    return begin + body + CLOSE.get(role, ROLE_CLOSE), len(begin), len(begin) + len(body)


def _end_of(formatted: str, close: str, at: int) -> int:
    """Where the next unescaped ``close`` begins."""
    while True:
        found = formatted.index(close, at)
        before = found
        while before > at and formatted[before - 1] == "\\":
            before -= 1
        if (found - before) % 2 == 0 or close[0] == " ":
            return found
        at = found + 1


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of formatted text: role, text, and where the escaped text begins and ends."""
    at = 0
    while at < len(formatted):
        for role, mark in OPEN.items():
            if formatted.startswith(mark, at):
                begin = at + len(mark)
                break
        else:
            begin = formatted.index("]", at) + 1
            role = unescape(formatted[at + len("[ROLE:") : begin - 1]).replace("%5D", "]").replace("%25", "%")
        close = CLOSE.get(role, ROLE_CLOSE)
        end = _end_of(formatted, close, begin)
        yield role, unescape(formatted[begin:end]), begin, end
        at = end + len(close)


def fold(events: Iterable[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """Final (role, text) messages of one message's events (kind, role, text), in order."""
    role, parts, open_ = "", [], False
    for kind, who, text in events:
        if kind == "message":
            if open_:
                yield role, "".join(parts)
            role, parts, open_ = who, [text], True
        elif kind == "delta":
            role, open_ = role if open_ else who, True
            parts.append(text)
        elif kind in ("edit", "regenerate"):
            role, parts, open_ = role if open_ else who, [text] if kind == "edit" else [], True
        elif kind == "delete":
            parts, open_ = [], False
        else:
            raise ValueError(f"no such kind of event: {kind}")
    if open_:
        yield role, "".join(parts)


def _rows(batches) -> Iterator[tuple]:
    for batch in sliced(batches, 1024):
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 500, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or size >= chars:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (``conv_id, message, part, role, text``) of events (``conv_id, message, seq, kind, role, text``).

    Null roles and texts are empty. Events that tie in ``seq`` go by kind,
    role and text. ``part`` numbers messages that share a place.
    """
    known = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = known.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        def messages():
            rows = _rows(batches)
            row = next(rows, None)
            while row is not None:
                key = row[:2]

                def own():
                    nonlocal row
                    while row is not None and row[:2] == key:  # noqa: B023
                        yield row[3:]
                        row = next(rows, None)

                for part, (role, text) in enumerate(fold(own())):
                    yield (*key, part, role, text)

        yield from _batches(messages(), schema)

    return keyed.mapInArrow(lean(run), "conv_id long, message long, part long, role string, text string")


def render(messages: DataFrame, segment_chars: int = 1 << 20, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations: ``conv_id, segment, formatted, loss_starts, loss_ends``.

    A conversation is one segment, or several of whole turns if it is long or
    lies in two ranges of messages; ``segment`` rises in order. The loss mask is
    given as ranges of code points in a segment. A NULL conversation is one
    like any other; messages without a place come first.
    """
    ordered = messages.repartitionByRange("conv_id", "message", "part").sortWithinPartitions("conv_id", "message", "part")
    spans = pa.list_(pa.int64())
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss_starts", spans), ("loss_ends", spans)])

    def run(batches):
        def segments():
            conv, segment, turns, size, starts, ends = None, TaskContext.get().partitionId() << 32, [], 0, [], []
            for key, _, _, role, text in _rows(batches):
                if turns and (key != conv or size >= segment_chars):
                    yield conv, segment, "".join(turns), starts, ends
                    segment, turns, size, starts, ends = segment + 1, [], 0, [], []
                conv = key
                turn, begin, end = render_turn(role, text)
                if role in trained_roles:
                    starts.append(size + begin)
                    ends.append(size + end)
                turns.append(turn)
                size += len(turn)
            if turns:
                yield conv, segment, "".join(turns), starts, ends

        yield from _batches(segments(), schema)

    return ordered.mapInArrow(lean(run), "conv_id long, segment long, formatted string, loss_starts array<long>, loss_ends array<long>")


def format_chats(conversations: DataFrame, segment_chars: int = 1 << 20) -> DataFrame:
    """Format a table of turns (``conv_id, turn, role, text``), written to the shared folder.

    Null texts and roles are empty. Turns that tie go by role and text, and
    rows that repeat are turns each. Rows without a conversation are one
    conversation, those without a turn its first turns. Other columns play no
    part; an empty table gives no rows.
    """
    events = conversations.select("conv_id", F.col("turn").alias("message"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
    return written(render(fold_events(events), segment_chars), "chats")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns by parsing, trained text by the loss mask.

    Segments are parsed wherever they lie; what the digests run over then goes
    to one task per conversation, which holds one segment at a time.
    """
    read = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turns", pa.int64()), ("said", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("chars", pa.int64())])

    def parsed(batches):
        def segments():
            for conv, segment, text, starts, ends in _rows(batches):
                said = [f"{role}\n{x}\n" for role, x, _, _ in parse(text)]
                loss = "".join([unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)])
                yield conv, segment, len(said), "".join(said).encode("utf-8", "surrogatepass"), len(loss), loss.encode("utf-8", "surrogatepass"), len(text)

        yield from _batches(segments(), read)

    own = formatted.mapInArrow(lean(parsed), "conv_id long, segment long, turns long, said binary, loss_chars long, loss binary, chars long")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def digests():
            conv, held = None, None
            for key, _, turns, said, loss_chars, loss, chars in _rows(batches):
                if held is not None and key != conv:
                    yield conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]
                    held = None
                if held is None:
                    conv, held = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += turns
                held[1].update(said)
                held[2] += loss_chars
                held[3].update(loss)
                held[4] += chars
            if held is not None:
                yield conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]

        yield from _batches(digests(), schema)

    return ordered.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED_SQL = r"regexp_replace(replace(coalesce(text, ''), '\', '\\'), '(\[/?INST\]|\[/?SYS\]|\[ROLE:|\[/ROLE\]|</?s>)', '\\\1', 'g')"
ORACLE = rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED_SQL} AS body FROM (
            SELECT conv_id, turn, role, text FROM conversations UNION ALL
            VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    marked AS (
        SELECT *, length(body) + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8
            ELSE 15 + length(role) END AS chars FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id"""
