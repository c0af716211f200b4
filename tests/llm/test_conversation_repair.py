"""Conversation repair against an exhaustive search over edit scripts."""
import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from ledgerlens.llm import conversations as C
from ledgerlens.llm import queries as Q
from ledgerlens.llm.conversations import damaged, repair_conversations

WORDS = r"[^\x20\x09-\x0D]"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        core = re.findall(WORDS, text)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else
                   "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, most):
    """Cheapest (cost, audit) and its rows over all scripts of up to ``most`` Inserts."""
    found = faults(rows)
    best = None
    choices = []
    for (role, text), fault in zip(rows, found, strict=True):
        options = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            options += [(more, "K", (role, text))] + [(3 + more, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(options)
    inserts = [tuple(p) for k in range(most + 1) for p in itertools.product(("user", "assistant"), repeat=k)]
    for script in itertools.product(*choices):
        for n in range(len(rows) + 1):  # Inserts before row n, and up to two places
            for extra in inserts:
                for m, extra2 in [(None, ())] + [(m, e) for m in range(n + 1, len(rows) + 1) for e in inserts[1:3]]:
                    parts = []
                    for i in range(len(rows) + 1):
                        put = extra if i == n else extra2 if i == m else ()
                        parts += [(3, "I", (r, "")) for r in put]
                        if i < len(rows):
                            parts.append(script[i])
                    kept = [p[2] for p in parts if p[2]]
                    if all(r[:1] for r, _ in kept) and PATTERN.fullmatch("".join(r[:1] for r, _ in kept)):
                        value = sum(p[0] for p in parts), "".join(p[1] for p in parts)
                        if best is None or value < best[0]:
                            best = value, kept
    return best


def forward(rows):
    """The same by a table over (row, pattern state): least (cost, audit, rows)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"": (0, "", ())}

    def inserted(table):
        for _ in range(4):
            for q, (c, a, o) in list(table.items()):
                for r in ("user", "assistant"):
                    to = step.get((q, r[0]))
                    if to is not None:
                        new = (c + 3, a + "I", o + ((r, ""),))
                        if to not in table or new[:2] < table[to][:2]:
                            table[to] = new
        return table

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}

        def offer(q, value):
            if q not in after or value[:2] < after[q][:2]:
                after[q] = value

        for q, (c, a, o) in inserted(table).items():
            offer(q, (c + 4, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            for letter, cost, r in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                to = step.get((q, r[:1])) if r else None
                if to is not None:
                    offer(to, (c + cost + more, a + letter, o + ((r, text),)))
        table = after
    cost, audit, out = min(v for q, v in inserted(table).items() if q in ("", "a"))
    return (cost, audit), list(out)


def figures(turned):
    """All figures of a conversation of (turn, role, text) rows in order."""
    rows = [r[1:] for r in turned]
    (cost, audit), out = forward(rows)
    turns = [t for t, _, _ in turned if t is not None]
    found = faults(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in (
        "blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def expected(table):
    """Result rows of (conv_id, turn, role, text) rows, damage included."""
    conversations = {}
    for conv, turn, role, text in table:
        told = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows = conversations.setdefault(conv, [])
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return [(conv, *figures(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))))
            for conv, rows in conversations.items()]


TEXTS = ["Yes.", "No", "", " \t", "Why?", "ok", "Yes."]
ROLE = ["user", "assistant", "system", "tool", "", "u"]


def test_agenda_equals_exhaustive_search():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(ROLE), rng.choice(TEXTS)) for _ in range(rng.randrange(4))]
        assert exhaustive(rows, 2) == forward(rows)


def test_blocks_equal_one_table(monkeypatch):
    rng = random.Random(4)
    for size in (1, 2, 3, 7, 512):
        monkeypatch.setattr(C, "BLOCK_ROWS", size)
        for _ in range(60):
            rows = [(rng.choice(ROLE[: rng.choice([2, 6])]), f"{rng.randrange(9)}{rng.choice(TEXTS)}") for _ in range(rng.randrange(30))]
            repair, seen = C.Repair(), set()
            for n, row in enumerate(rows):
                repair.add(n, *row, row in seen)
                seen.add(row)
            assert repair.result() == figures([(n, *r) for n, r in enumerate(rows)])


@pytest.fixture
def turns():
    rng = random.Random(9)
    out = []
    for conv in [*range(150), None]:
        turn = 0
        for _ in range(rng.randrange(1, 12)):
            turn += rng.choice([1, 1, 1, 2])
            out.append((conv, turn if rng.random() < 0.95 else None, rng.choice([*ROLE[:4], "user", "assistant", None]),
                        rng.choice([*TEXTS, None, f"x{rng.randrange(9)}.", "é!", "trailing. \n", "ü"])))
    out += [out[0], out[1], out[1]]  # repeated rows
    out += [(500, t, "user" if t % 2 else "assistant", f"Turn {t % 700}.") for t in range(1400)]  # a long one
    out += [(600, None, None, None)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out += [(dropped, 0, "user", "Gone.")]
    return out


def test_whole_operator(spark, turns):
    frame = spark.createDataFrame([(*t, 7, "x") for t in turns],
                                  "conv_id long, turn long, role string, text string, cost int, first string").repartition(7)
    got = repair_conversations(damaged(frame)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(turns), key=repr)
    assert repair_conversations(damaged(frame.limit(0))).count() == 0
    empty = next(r for r in got if r.audit == "" and r.conv_id >= 1000)
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_without_damage(spark):
    frame = spark.createDataFrame([("c", 0, "user", "Hi?"), ("c", 1, "assistant", "Yes."), ("d", 0, "assistant", "Alone.")],
                                  "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in repair_conversations(frame).collect()}
    assert got == {"c": (0, "KK"), "d": (3, "IK")}


def test_registered_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = Q.op11_conversation_repair(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(expected(table))


def test_batch_borders():
    rows = [(i // 3, i % 3, "user" if i % 2 else "assistant", f"t{i}.", 1, False) for i in range(60)]
    names = ["conv_id", "turn", "role", "text", "copies", "seen"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    cut = [whole.slice(i, 7) for i in range(0, 60, 7)]
    one = pa.Table.from_batches(C._repair([whole])).to_pylist()
    assert pa.Table.from_batches(C._repair(cut)).to_pylist() == one and len(one) == 20
