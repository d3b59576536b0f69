"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Each prefix
of a conversation is rendered; the difference between two consecutive outputs is
the last turn's span. A template whose output for a prefix does not begin with
its output for the shorter one rewrites history, and is reported.

Rendering every prefix takes time in the square of the turns. Beyond the first
``EXACT`` turns the prefixes are therefore those of the last ``WINDOW`` turns, and
what they add is put together; at every doubling and at the end the whole prefix
is rendered and must be the same. A template for which it is not has all its
prefixes rendered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches

Template = Callable[[list[tuple[str, str]]], str]

#: Turns whose whole prefixes are rendered, and turns before a later one that are rendered with it.
EXACT, WINDOW = 32, 8
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>((?:[^<\\\n]|\\.|<(?!\|))*)\n((?:[^<\\]|\\.|<(?!\|))*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked_turns(messages: list[tuple[str, str]]) -> str:
    """The template of this module: every turn between its marks, control strings escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in messages)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of ``marked_turns``."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


Spans = list[tuple[int, int, int, int]]


def _text_place(head: list[tuple[str, str]], role: str, now: str, template: Template) -> tuple[int, int]:
    """(start, length) of the last turn's text in ``now``: two probes differ where it begins, an empty text leaves what is around it."""
    start = _common(template([*head, (role, "a")]), template([*head, (role, "b")]))
    return start, len(now) - len(template([*head, (role, "")]))


def _by_prefixes(messages: list[tuple[str, str]], template: Template) -> tuple[str, Spans, int | None]:
    before, spans, rewrites = template([]), [], None
    for i, (role, _) in enumerate(messages):
        now = template(messages[: i + 1])
        if not now.startswith(before):
            rewrites = i if rewrites is None else rewrites
            spans = [(0, 0, 0, 0)] * (i + 1)
        else:
            start, size = _text_place(messages[:i], role, now, template)
            spans.append((len(before), len(now), start, start + size))
        before = now
    return before, spans, rewrites


def _by_windows(messages: list[tuple[str, str]], template: Template) -> tuple[str, Spans, int | None] | None:
    """The same from the last turns only; None where what they add is not what the whole prefixes show."""
    whole, spans, rewrites = _by_prefixes(messages[:EXACT], template)
    if rewrites is not None:
        return None
    parts, at, check = [whole], len(whole), 2 * EXACT
    for i in range(EXACT, len(messages)):
        head, role = messages[i - WINDOW : i], messages[i][0]
        before, now = template(head), template([*head, messages[i]])
        start, size = _text_place(head, role, now, template)
        if not now.startswith(before) or start < len(before):
            return None
        parts.append(now[len(before) :])
        spans.append((at, at + len(parts[-1]), at + start - len(before), at + start - len(before) + size))
        at = spans[-1][1]
        if i + 1 in (check, len(messages)):
            check *= 2
            parts = ["".join(parts)]
            if template(messages[: i + 1]) != parts[0]:
                return None
    return parts[0], spans, None


def turn_spans(messages: list[tuple[str, str]], template: Template) -> tuple[str, Spans, int | None]:
    """(output, spans, first rewriting turn or None) of one conversation.

    A span is (start, end, text start, text end) in the output. Where the template
    rewrites history at some turn, that turn and those before it have no spans:
    their places in earlier outputs mean nothing in the last one. Time is in
    proportion to the output where a turn's rendering depends on few turns before
    it, else to the turns times the output.
    """
    return (_by_windows(messages, template) if len(messages) > EXACT else None) or _by_prefixes(messages, template)


def format_conversations(turns: DataFrame, template: Template = marked_turns, trained: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, spans, rewrites_at) of every conversation.

    ``spans`` has (role, start, end, text_start, text_end, trained) of each turn, in
    code points of ``formatted``. Rows go by turn (null first), then role and text;
    repeated rows are turns of their own. Null texts and roles are empty; rows of a
    null id are one conversation. Other columns take no part, no rows give none.
    The rows of a conversation pass through one task one after another, sorted by
    Spark; a conversation is one string and has to fit there.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, messages, started = None, [], False
        out: list[tuple] = []

        def close():
            formatted, spans, rewrites = turn_spans(messages, template)
            marks = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "trained": r in trained} for (r, _), (a, b, c, d) in zip(messages, spans)]
            out.append((held, formatted, marks, rewrites))

        def flush():
            kinds = (pa.int64(), pa.string(), mark, pa.int32())
            batch = pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["conv_id", "formatted", "spans", "rewrites_at"])
            out.clear()
            return batch

        mark = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end")), ("trained", pa.bool_())]))
        for batch in batches:
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if started and c != held:
                    close()
                    messages = []
                held, started = c, True
                messages.append((r, x))
            yield flush()
        if started:
            close()
            yield flush()

    schema = "conv_id long, formatted string, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,trained:boolean>>, rewrites_at int"
    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(render, schema)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What ``formatted`` holds, read back from its texts and spans: counts and digests of each conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = read_turns(text)
                whole = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["trained"])
                out.append((c, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
