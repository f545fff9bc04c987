r"""Conversation structure repair (operator 11): the cheapest edits that give every conversation its legal form.

A conversation is legal when the first letters of its roles are ``(s?(ua)+)?``: nothing, or perhaps a system row and
then pairs of user and assistant. Its rows are taken by turn (nulls first), then role and text. Every row is kept (K, 0),
gets the role user or assistant (R, 1) or is deleted (D, 2); empty user or assistant rows may be inserted anywhere
(I, 5). The first fault of a row counts: ``blank`` has no character but white space, ``duplicate`` repeats role and text
of an earlier row, ``truncated`` does not end in ``.``, ``!`` or ``?``. Blank and duplicate rows must be deleted; a
truncated row that stays costs 5 more. Of equally cheap edits the one whose letters come first in ASCII order is taken.

Secondary-sorted streaming: rows are shuffled once, by conversation, and sorted inside their partition. A first
``mapInArrow`` reads every conversation from its last row to its first and carries the cost of finishing from each of
four states; beside each row it writes one byte, two bits for each state, that says what to do there. Spark's sorter
turns the order round and spills these bytes with their rows where a conversation is larger than memory; a second
``mapInArrow`` follows them from the first row on. Both hold one state, however long the conversation is, and pass it
from batch to batch. The states of the first pass, less their smallest cost, are few, so their steps are remembered.

Null roles and texts count as one space, so such a text is blank and such a role, like an empty one, must change or go.
Rows with a null conversation are one conversation. Repeated rows are duplicates. An empty table gives none. Very long
texts pass through as they are. Extra columns do not come along; columns are found by the names given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import released

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row costs that is not deleted.
TRUNCATED_COST = 5
FAULTS = ("blank", "duplicate", "truncated")

# States: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that a user or assistant row of free choice leads to.
_FREE = (_USER, _USER, _ASSISTANT, _USER)
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_END = (0, 2 * COST[INSERT], COST[INSERT], 0)
_LETTERS = DELETE + INSERT + KEEP + REROLE  # in ASCII order; a step's two bits are its place here


def _step(ahead: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """The costs of finishing before a row from the costs ``ahead`` behind it, and what to do in each state."""
    cost, letter = [], []
    for state in range(4):
        ways = [(COST[DELETE] + ahead[state], DELETE)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED_COST * (fault == "truncated")
            if (state, initial) in _KEPT:
                ways.append((more + ahead[_KEPT[state, initial]], KEEP))
            ways.append((COST[REROLE] + more + ahead[_FREE[state]], REROLE))
        best = min(ways)
        cost.append(best[0])
        letter.append(best[1])
    plain = list(cost)
    for state in (_USER, _ASSISTANT, _START, _SYSTEM):
        # An insertion from user leads to assistant and back; two in a row from there never pay.
        after = (plain if state in (_USER, _ASSISTANT) else cost)[_FREE[state]] + COST[INSERT]
        if (after, INSERT) < (cost[state], letter[state]):
            cost[state], letter[state] = after, INSERT
    return tuple(cost), sum(_LETTERS.index(x) << 2 * i for i, x in enumerate(letter))


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from each conversation's last to its first, with ``step``."""
    known: dict[tuple, tuple] = {}
    conv, ahead = object(), _END
    for batch in batches:
        steps = []
        for c, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("conv", "initial", "fault")), strict=True):
            if c != conv:
                conv, ahead = c, _END
            key = (ahead, initial if initial in ("s", "u", "a") else "", fault)
            if key not in known:
                cost, step = _step(*key)
                known[key] = tuple(x - min(cost) for x in cost), step
            ahead, step = known[key]
            steps.append(step)
        yield batch.append_column("step", pa.array(steps, pa.int16()))


_EDITS = ["conv", "place", "edit", "role", "text", "turn", "was", "fault"]


def _repaired(conv_type: pa.DataType, turn_type: pa.DataType):
    kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), turn_type, pa.string(), pa.string()]
    name = {_USER: "user", _ASSISTANT: "assistant"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place, begun = None, _START, 0, False
        out: list[tuple] = []

        def insert() -> None:
            nonlocal state, place
            state = _FREE[state]
            out.append((conv, place, INSERT, name[state], "", None, None, None))
            place += 1

        def finish() -> None:
            while state in (_SYSTEM, _USER):
                insert()

        def told() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _EDITS)

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "initial", "fault", "step"))
            for c, turn, role, text, initial, fault, step in zip(*columns, strict=True):
                if not begun or c != conv:
                    finish()
                    conv, state, place, begun = c, _START, 0, True
                while (edit := _LETTERS[step >> 2 * state & 3]) == INSERT:
                    insert()
                now = role
                if edit == KEEP:
                    state = _KEPT[state, initial]
                elif edit == REROLE:
                    state = _FREE[state]
                    now = name[state]
                out.append((conv, place, edit, now, text, turn, role, fault))
                place += 1
            yield told()
        finish()
        yield told()

    return rows


def _has_words(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every row of ``rows`` and every inserted one: ``conv``, place (from 0), edit, role, text, turn, was
    (the role before) and fault.

    The repaired conversation is its rows without those of edit D, in order of place. Rows of a conversation come
    together and in order.
    """
    schema = rows.select(conv, turn).schema
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    # Of rows that are equal in all of these the first is not "again".
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("again")]
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~_has_words(F.col("text")), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    told = told.repartition("conv").withColumn("again", again).withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    back = told.sortWithinPartitions(F.desc("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("again"))
    kinds = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    planned = back.mapInArrow(released(_planned), ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", step smallint")
    ahead = planned.sortWithinPartitions(F.asc("conv"), *order)
    types = [pa.field("x", t) for t in _arrow_types(schema)]
    ddl = f"conv {kinds['conv']}, place long, edit string, role string, text string, turn {kinds['turn']}, was string, fault string"
    return ahead.mapInArrow(released(_repaired(*[t.type for t in types])), ddl).withColumnRenamed("conv", conv)


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Fold:
    """The figures of one conversation, row by row."""

    def __init__(self) -> None:
        self.low = self.high = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.audit, self.hash, self.written = bytearray(), hashlib.sha256(), False

    def add(self, edit, role, text, turn, was, fault) -> None:
        self.audit += edit.encode()
        self.cost += COST[edit] + TRUNCATED_COST * (fault == "truncated" and edit != DELETE)
        if edit != INSERT:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.last
                self.high = self.last = turn
            if fault:
                self.faults[fault] += 1
            self.illegal += self.before is not None and (self.before, was[:1]) not in _LEGAL
            self.before = was[:1]
        if edit != DELETE:
            self.hash.update(("\n" * self.written + role + ":" + text).encode())
            self.written = True

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def repair_report(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``repair_conversations``'s result: missing turns (gaps), rows of each fault,
    neighbours of illegal roles before the repair, cost, the edits' letters (audit) and the digest of the repaired rows.

    Reads its input as it comes, so ``edits`` must be that result itself; it is not shuffled again.
    """
    kind = edits.schema[conv].dataType.simpleString()
    conv_type = _arrow_types(edits.select(conv).schema)[0]
    kinds = [conv_type, *[pa.int64()] * len(_FIGURES), pa.string(), pa.string()]
    names = ["conv", *_FIGURES, "audit", "repaired_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, fold = None, None
        for batch in batches:
            done = []
            for c, *rest in zip(*(batch.column(n).to_pylist() for n in ("conv", "edit", "role", "text", "turn", "was", "fault")), strict=True):
                if fold is None or c != conv_now:
                    done += [fold.row(conv_now)] if fold else []
                    conv_now, fold = c, _Fold()
                fold.add(*rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)
        if fold:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(fold.row(conv_now), kinds, strict=True)], names)

    ddl = f"conv {kind}, " + ", ".join(f"{n} long" for n in _FIGURES) + ", audit string, repaired_sha256 string"
    return edits.withColumnRenamed(conv, "conv").mapInArrow(released(rows), ddl).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of a table of conversations, damaged by their number: what the repair is tried on.

    By crc32("conv_id:turn") % 20 (a null is one space): 0 drops a row, 1 empties its text, 2 takes its sentence ends,
    3 repeats it, 4 makes it a user's; the rest stays.
    """
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")
