"""Conversation structure repair by Knuth's lightest derivation.

A conversation may have a leading system turn, then user and assistant turns in
alternation: role initials ``(s?(ua)+)?``.  The cheapest repair is the lightest
derivation of a goal in a weighted hypergraph of deductions:

* items: ``Row(i)``, the i-th row with its faults, an axiom of value (0, "");
  ``Prefix(i, q)``, the rows before i are repaired and the result has brought
  the role pattern to state q; ``Goal``;
* hyperedges: ``Prefix(i, q), Row(i) -> Prefix(i + 1, q')`` for Keep, Rerole and
  Delete, ``Prefix(i, q) -> Prefix(i, q')`` for Insert, and ``Prefix(n, q) ->
  Goal`` for the states q in which a conversation may end;
* values: (cost, audit), compared in that order.  An edge adds its cost and
  appends its letter, so its value never falls below that of a tail and grows
  with it: a superior function.  Items can thus be taken from an agenda by
  rising value, each final when taken, until the goal is.

Two audits of equal cost that have consumed the same rows are never one the
beginning of the other (the rest would be Inserts, which cost), so the least
audit of an item begins the least audit of what follows from it.

Rows reach a task sorted by conversation and turn and are worked on in blocks,
with the items at a block's end as the next block's axioms, each with the state
of its SHA-256.  So a conversation of any length needs a block, its audit and
four digests in memory.  Its digest is one sequential computation by definition,
which is why one task reads one conversation.  Rows that repeat an earlier one
are found before, by an aggregate on digests.

Defined cases: null role, text, and null parts of the damage key, are one space;
rows of one turn are ordered by role, then text (after damage); a role without
a first character fits no place in the pattern and can't be kept; a null id is a
conversation like others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os.path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: The role pattern: state before, initial, state after.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START, ENDS = 0, (0, 3)
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 512, 4 << 20


class Row:
    """A row after damage: role, text, and the first fault it has."""

    __slots__ = ("role", "text", "fault")

    def __init__(self, role: str, text: str, repeats: bool):
        self.role, self.text = role, text
        core = text.rstrip(SPACE)
        self.fault = "blank" if not core else "duplicate" if repeats else "truncated" if core[-1] not in ".!?" else ""


def deductions(row: Row, state: int):
    """Hyperedges from a prefix in ``state`` and ``row``: cost, letter, state
    after, output."""
    yield DELETE, "D", state, None
    if row.fault in ("blank", "duplicate"):
        return
    more = TRUNCATED if row.fault == "truncated" else 0
    kept = STEPS.get((state, row.role[:1]))
    if kept is not None:
        yield KEEP + more, "K", kept, (row.role, row.text)
    for initial, role in ROLES.items():
        changed = STEPS.get((state, initial))
        if changed is not None:
            yield REROLE + more, "R", changed, (role, row.text)


def insertions(state: int):
    for initial, role in ROLES.items():
        after = STEPS.get((state, initial))
        if after is not None:
            yield INSERT, "I", after, (role, "")


GOAL = (-1, -1)


def lightest(rows: list[Row], axioms: dict[int, tuple[int, str]], closing: bool) -> dict:
    """Lightest derivations over a block.

    ``axioms`` gives the value of each state before the block.  Returns, by item
    (place, state), its value, the item before it and the output of its last
    edge; with ``closing`` the agenda stops when ``GOAL`` is final, otherwise
    when it is empty."""
    n = len(rows)
    serial = itertools.count()  # an Insert at the border of two blocks is derived in both
    agenda = [(cost, audit, next(serial), 0, state, None, None) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple] = {}
    while agenda:
        cost, audit, _, place, state, before, output = heapq.heappop(agenda)
        item = (place, state)
        if item in final:
            continue
        final[item] = (cost, audit), before, output
        if item == GOAL:
            break
        edges = [(edge, place) for edge in insertions(state)]
        if place < n:
            edges += [(edge, place + 1) for edge in deductions(rows[place], state)]
        elif closing and state in ENDS:
            edges.append(((0, "", GOAL[1], None), GOAL[0]))
        for (more, letter, after, out), to in edges:
            if (to, after) not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, next(serial), to, after, item, out))
    return final


def _outputs(final: dict, item: tuple[int, int]) -> tuple[int, list[tuple[str, str]]]:
    """State before the block and rows that the derivation of ``item`` gives."""
    out = []
    while True:
        _, before, output = final[item]
        if output is not None:
            out.append(output)
        if before is None:
            return item[1], out[::-1]
        item = before


class Repair:
    """One conversation, row by row in order."""

    def __init__(self):
        self.rows: list[Row] = []
        self.chars = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.initial: str | None = None
        self.turns, self.low, self.high = 0, None, None
        self.last: tuple | None = None
        self.settled: list[str] = []  # the beginning that all audits share
        self.live = {START: ((0, ""), hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        row = Row(role, text, seen or self.last == (turn, role, text))
        if row.fault:
            self.count[row.fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        self.last = (turn, role, text)
        self.rows.append(row)
        self.chars += len(text)
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self.block(False)

    def block(self, closing: bool) -> None:
        final = lightest(self.rows, {q: value for q, (value, _, _) in self.live.items()}, closing)
        ends = [GOAL] if closing else [item for item in final if item[0] == len(self.rows)]
        live = {}
        for item in ends:
            state, out = _outputs(final, item)
            _, digest, begun = self.live[state]
            digest = digest.copy()
            if out:
                told = "\n".join(f"{role}:{text}" for role, text in out)
                digest.update((("\n" if begun else "") + told).encode("utf-8", "surrogatepass"))
            live[item[1]] = final[item][0], digest, begun or bool(out)
        shared = os.path.commonprefix([value[1] for value, _, _ in live.values()])
        self.settled.append(shared)
        self.live = {q: ((cost, audit[len(shared):]), digest, begun) for q, ((cost, audit), digest, begun) in live.items()}
        self.rows, self.chars = [], 0

    def result(self) -> tuple:
        self.block(True)
        (cost, _), digest, _ = self.live[GOAL[1]]
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return (gaps, *self.count.values(), self.illegal, cost, "".join(self.settled), digest.hexdigest())


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair(batches):
    """Rows sorted by conversation, turn, role and text: conv_id, turn, role,
    text, copies (0: only the conversation is known) and first turn of equal
    rows (null unless there are several)."""
    current, repair, id_type = None, None, None

    def flushed(done):
        ids, results = zip(*done, strict=True)
        columns = list(zip(*results, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in columns[:6]),
             *(pa.array(c, pa.string()) for c in columns[6:])],
            names=["conv_id", *_FIGURES, "audit", "repaired_sha256"])

    for batch in batches:
        id_type = batch.schema.field(0).type
        done = []
        for conv, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if repair is None or conv != current:
                if repair is not None:
                    done.append((current, repair.result()))
                current, repair = conv, Repair()
            for _ in range(copies):
                repair.add(turn, role, text, seen)
        if done:
            yield flushed(done)
    if repair is not None:
        yield flushed([(current, repair.result())])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of their key: ``conv_id, turn,
    role, text, copies``; a dropped row stays with no copies."""
    def told(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(told("role")).alias("role"),
                        text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` per conversation of ``turns`` (``conv_id, turn, role,
    text``, and ``copies`` if the rows have been damaged)."""
    if "copies" not in turns.columns:
        turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    keys = [F.xxhash64(F.lit(k), "conv_id", F.col("conv_id").isNull(), "role", "text").alias(f"d{k}") for k in (1, 2)]
    rows = turns.select("*", *keys)
    # The first turn of rows that stand in several turns; null turns come first.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    several = rows.filter("copies > 0").groupBy("d1", "d2").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("d1", "d2", "first")
    seen = rows.join(several, ["d1", "d2"], "left").select(
        "conv_id", "turn", "role", "text", "copies",
        F.coalesce(F.col("first") < place, F.lit(False)).alias("seen"))
    ordered = seen.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    figures = ", ".join(f"{c} long" for c in _FIGURES)
    return ordered.mapInArrow(_repair, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {figures}, "
                                       "audit string, repaired_sha256 string")
