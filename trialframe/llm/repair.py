"""Repair of the turn structure of conversations at least cost, by Four-Russians block tables.

A repaired conversation is empty or has an optional system turn and then pairs of
user and assistant. Every row is a symbol (its role's initial, whether it must go,
whether it is cut off); what remains to be paid after a row is a vector over the four
states of that grammar. Less its least entry there are few such vectors, so the
step from one to the next over every block of ``BLOCK`` symbols is a table made once.
Conversations are read from the end, a block a look-up, and only the vectors
between blocks are kept; then from the front, each block is expanded backward from
the vector behind it, and of the edits that are among the cheapest the one whose
initial comes first is taken, which makes ties safe.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches

#: Costs of the edits, and of a cut-off turn that is not deleted.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Symbols in a block.
BLOCK = 4
#: What the faults are called; a row's first one counts.
FAULTS = ("", "blank", "duplicate", "truncated")
_WHITE = " \t\n\x0b\x0c\r"

# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may be the end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after the one turn that may be inserted, or made of any row, and that turn's role.
_MADE = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_FAR = 1 << 30

#: Symbols: a row that must go, then each initial (other ones are alike) whole and cut off.
GONE, _INITIALS = 0, "sua"
SYMBOLS = 9


def symbol(fault: str, role: str) -> int:
    if fault in ("blank", "duplicate"):
        return GONE
    return 1 + 2 * ((_INITIALS.find(role[:1]) + 4) % 4 if role else 3) + (fault == "truncated")


def _options(s: int, state: int, after: tuple[int, ...]) -> dict[str, int]:
    """What is still to be paid, by the edit that takes a row of symbol ``s`` in ``state``; ``after`` is the vector behind the row."""
    out = {"D": DELETE + after[state]}
    if s != GONE:
        initial, more = (*_INITIALS, "?")[(s - 1) // 2], CUT_OFF * ((s - 1) % 2)
        if (state, initial) in _NEXT:
            out["K"] = more + after[_NEXT[state, initial]]
        out["R"] = REROLE + more + after[_MADE[state]]
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs once turns may be inserted before: two of them reach every state that more do."""
    return tuple(min(costs[q], INSERT + costs[_MADE[q]], 2 * INSERT + costs[_MADE[_MADE[q]]]) for q in range(4))


#: What is to be paid at the end of a conversation.
_END = _with_inserts([0, _FAR, _FAR, 0])


class Tables:
    """Normalised cost vectors and the steps between them.

    ``vectors[v]`` is a cost vector less its least entry; ``step[v, s]`` and
    ``paid[v, s]`` are the vector before a row of symbol s and what was taken off;
    ``block`` and ``block_paid`` are the same for ``BLOCK`` symbols, the last row's
    in the highest place; ``edit[v, s, q]`` is the edit to make in state q.
    """

    def __init__(self, size: int = BLOCK) -> None:
        low = min(_END)
        self.size, self.end_paid = size, low
        self.vectors, number = [tuple(x - low for x in _END)], {}
        number[self.vectors[0]] = 0
        step, paid, edit = [], [], []
        for after in self.vectors:  # grows until no symbol leads to a new vector
            to, cost, edits = [], [], []
            for s in range(SYMBOLS):
                own = [min(_options(s, q, after).values()) for q in range(4)]
                before = _with_inserts(own)
                low = min(before)
                normal = tuple(x - low for x in before)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                to.append(number[normal])
                cost.append(low)
                edits.append([min(e for e, c in (_options(s, q, after) | {"I": INSERT + before[_MADE[q]]}).items() if c == before[q]) for q in range(4)])
            step.append(to)
            paid.append(cost)
            edit.append(edits)
        self.step, self.paid, self.edit = step, paid, edit
        one, cost = np.asarray(step), np.asarray(paid)
        block, block_paid = one, cost
        for _ in range(size - 1):  # one more row before the block
            block_paid = (block_paid[:, None, :] + cost[block].transpose(0, 2, 1)).reshape(len(one), -1)
            block = one[block].transpose(0, 2, 1).reshape(len(one), -1)
        self.block, self.block_paid = block.tolist(), block_paid.tolist()


@functools.cache
def tables(size: int = BLOCK) -> Tables:
    return Tables(size)


def _boundaries(groups: np.ndarray, symbols: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """For rows that come last first: (vector behind the row's block, what is paid behind it, row's place from the end) and what the next batch goes on with.

    ``groups`` is true on the first row of a conversation. Whole blocks are one look-up each.
    """
    t = tables()
    rows = len(symbols)
    vector, paid, place = np.empty(rows, np.int32), np.empty(rows, np.int64), np.empty(rows, np.int64)
    v, cost, code, n = held
    weight = [SYMBOLS**k for k in range(t.size)]
    for i, (new, s) in enumerate(zip(groups.tolist(), symbols.tolist())):
        if new:
            v, cost, code, n = 0, t.end_paid, 0, 0
        vector[i], paid[i], place[i] = v, cost, n
        code += s * weight[n % t.size]
        n += 1
        if n % t.size == 0:
            cost += t.block_paid[v][code]
            v, code = t.block[v][code], 0
    return vector, paid, place, (v, cost, code, n)


def _expand(symbols: list[int], vector: int, paid: int) -> tuple[list[int], list[int]]:
    """(vector behind each row of a block, what is paid from the block's end on before each row), made backward from the block's end."""
    t = tables()
    behind, before = [], []
    for s in reversed(symbols):
        behind.append(vector)
        paid += t.paid[vector][s]
        vector = t.step[vector][s]
        before.append(paid)
    return behind[::-1], before[::-1]


def _trace(symbols: list[int], vector: int, paid: int, state: int) -> tuple[list[tuple[str, int, str, int]], int]:
    """Edits (initial, row of the block or -1, role given or '', what this edit and all later ones cost) and the state behind the block."""
    t = tables()
    out = []
    behind, before = _expand(symbols, vector, paid)
    for i, s in enumerate(symbols):
        v = t.step[behind[i]][s]
        while True:
            edit = t.edit[behind[i]][s][state]
            left = before[i] + t.vectors[v][state]
            role = _ROLE[state] if edit in "IR" else ""
            out.append((edit, -1 if edit == "I" else i, role, left))
            if edit == "I":
                state = _MADE[state]
                continue
            if edit == "R":
                state = _MADE[state]
            elif edit == "K":
                state = _NEXT[state, _INITIALS[(s - 1) // 2]]
            break
    return out, state


def _closing(state: int) -> list[tuple[str, int, str, int]]:
    """The turns inserted at the end."""
    out = []
    while state in (1, 2):
        out.append(("I", -1, _ROLE[state], _END[state]))
        state = _MADE[state]
    return out


def least_edits(symbols: list[int]) -> tuple[int, str]:
    """(cost, edits' initials) of one conversation's symbols."""
    t = tables()
    rows = np.asarray(symbols[::-1], np.int64)
    vector, paid, place, _ = _boundaries(np.arange(len(rows)) == 0, rows, (0, 0, 0, 0))
    audit, state, at, cost = [], 0, 0, None
    while at < len(symbols):
        last = len(symbols) - 1 - at  # the row's place from the end
        size = int(place[last]) % t.size + 1
        edits, state = _trace(symbols[at : at + size], int(vector[last]), int(paid[last]), state)
        cost = edits[0][3] if cost is None else cost
        audit += edits
        at += size
    audit += _closing(state)
    return cost or 0, "".join(e[0] for e in audit)


_FIELDS = "conv_id {kind}, place long, edit string, fault string, turn {turn}, old_role string, role string, text string, cost_to_go long"


def repair_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation in order: (conv_id, place, edit, fault, turn, old_role, role, text, cost_to_go).

    An edit is Keep, Rerole, Delete or Insert, by its initial. ``role`` and ``text`` are
    those of the repaired turn (null where the row is deleted), ``old_role`` and ``turn``
    those of the row (null where one is inserted), ``fault`` is the row's first fault or
    empty, ``cost_to_go`` what this edit and those after it cost. Rows go by turn (null
    first), then role and text; of equal rows the later ones are duplicates. Null roles
    and texts are one space, so such texts are blank; rows of a null id are one
    conversation; a conversation without rows gives none, as does an empty table. Other
    columns take no part, whatever their names.

    Sorted by Spark, the rows of a conversation pass through one task in order, twice
    on the same partitions, and are neither gathered nor shortened: a task holds one
    batch, a block and a cost vector, whatever the length of conversations or texts.
    """
    return _edits(turns, conv_id, turn, role, text)


def _edits(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The same; within a partition a conversation's rows follow one another in order."""
    bounded_batches(turns.sparkSession)
    kind, when = (turns.schema[c].dataType.simpleString() for c in (conv_id, turn))
    rows = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit(" ")).alias("r"), F.coalesce(text, F.lit(" ")).alias("x"))
    same = F.sha2(F.concat_ws(":", F.char_length("r").cast("string"), "r", "x"), 256)
    own = Window.partitionBy("c", "d").orderBy(F.col("t").asc_nulls_first())
    rows = rows.repartition("c").withColumn("d", same).withColumn("again", F.row_number().over(own) > 1).drop("d")
    end = F.rtrim("x", F.lit(_WHITE))
    fault = F.when(end == "", 1).when(F.col("again"), 2).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.position(F.substring("r", 1, 1), F.lit(_INITIALS))
    symbol_ = F.when(fault.isin(1, 2), GONE).otherwise(F.lit(1) + F.when((F.col("r") != "") & (initial > 0), 2 * (initial - 1)).otherwise(6) + F.when(fault == 3, 1).otherwise(0))
    rows = rows.withColumns({"f": fault, "s": symbol_}).select("c", "t", "r", "x", "f", "s", "again")
    order = ("t", "r", "x", "again")

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, begun = (0, 0, 0, 0), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last, begun = _first_rows(batch.column("c"), last, begun)
            symbols = batch.column("s").to_numpy(zero_copy_only=False)
            vector, paid, place, held = _boundaries(new, symbols, held)
            yield pa.record_batch([*batch.columns, pa.array(vector), pa.array(paid), pa.array(place)], [*batch.schema.names, "v", "g", "p"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, begun, state, n, held = None, False, 0, 0, []

        def close():
            nonlocal n
            for edit, _, made, cost in _closing(state):
                out.append((last, n, edit, "", None, None, made, "", cost))
                n += 1

        def flush():
            batch = pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return batch

        names, kinds = [f.split()[0] for f in _FIELDS.split(", ")], None
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field("c").type, pa.int64(), pa.string(), pa.string(), batch.schema.field("t").type, pa.string(), pa.string(), pa.string(), pa.int64()]
            new = _first_rows(batch.column("c"), last, begun)[0] if batch.num_rows else []
            for first, c, t, r, x, f, s, v, g, p in zip(new, *(batch.column(k).to_pylist() for k in ("c", "t", "r", "x", "f", "s", "v", "g", "p"))):
                if first:
                    if begun:
                        close()
                    state, n = 0, 0
                last, begun = c, True
                held.append((t, r, x, f, s))
                if p % BLOCK:  # more rows of the block follow
                    continue
                edits, state = _trace([h[4] for h in held], v, g, state)
                for edit, i, made, cost in edits:
                    t, r, x, f, _ = held[i] if i >= 0 else (None, None, "", 0, 0)
                    gone = edit == "D"
                    out.append((c, n, edit, FAULTS[f], t, r, None if gone else made or r, None if gone else x, cost))
                    n += 1
                held = []
            if kinds and out:
                yield flush()
        if begun:
            close()
            if out:
                yield flush()

    fields = rows.schema.simpleString()[7:-1].replace(":", " ")
    marked = rows.sortWithinPartitions("c", *[F.col(k).desc_nulls_last() for k in order]).mapInArrow(backward, f"{fields}, v int, g long, p long")
    return marked.sortWithinPartitions("c", F.desc("p")).mapInArrow(forward, _FIELDS.format(kind=kind, turn=when))


def _first_rows(ids: pa.Array, last, begun: bool) -> tuple[np.ndarray, object, bool]:
    """Which rows begin a conversation, given the last id of the batch before; also this batch's last id."""
    values = ids.to_pylist()
    before = [last, *values[:-1]]
    return np.asarray([not begun and i == 0 or a != b for i, (a, b) in enumerate(zip(values, before))]), values[-1], True


def repair_digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation that has rows: counts, cost, edits' initials and the SHA-256 of the repaired turns.

    ``gaps`` counts the turns that are missing between the least and the greatest (null
    turns aside), ``illegal`` the adjacent rows whose roles' initials are not su, ua or au.
    Both, the faults and the digest are taken from the edits as they pass.
    """
    edits = _edits(turns, conv_id, turn, role, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, out = None, False, []

        def row():
            gaps = high - low + 1 - distinct if distinct else 0
            return (held, gaps, *counts, illegal, cost, "".join(audit), digest.hexdigest())

        def flush():
            batch = pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate((kind, *[pa.int64()] * 6, pa.string(), pa.string()))], names)
            out.clear()
            return batch

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, edit, fault, t, old, r, x, left in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "edit", "fault", "turn", "old_role", "role", "text", "cost_to_go"))):
                if not begun or c != held:
                    if begun:
                        out.append(row())
                    held, begun, cost, audit, digest, parts = c, True, left, [], hashlib.sha256(), 0
                    counts, illegal, before, low, high, distinct = [0, 0, 0], 0, None, None, None, 0
                audit.append(edit)
                if fault:
                    counts[FAULTS.index(fault) - 1] += 1
                if old is not None:
                    illegal += before is not None and before + old[:1] not in ("su", "ua", "au")
                    before = old[:1]
                if t is not None and t != high:  # rows come by turn
                    low, high, distinct = t if low is None else low, t, distinct + 1
                if edit != "D":
                    digest.update(("\n" * (parts > 0) + f"{r}:{x}").encode("utf-8", "surrogatepass"))
                    parts += 1
            if out:
                yield flush()
        if begun:
            out.append(row())
            yield flush()

    schema = f"conv_id {turns.schema[conv_id].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return edits.mapInArrow(read, schema)
