"""Periodic runs against a comparison of all distances."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import queries as Q
from ledgerlens.llm.periodic import EXPONENT, LENGTH, periodic_runs, runs_of


def brute_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // EXPONENT + 1):
        b = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and b is None:
                b = i
            if not same and b is not None:
                if i + q - b >= max(LENGTH, EXPONENT * q):
                    found.setdefault((b, i + q - b), q)
                b = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def strings(rng):
    for _ in range(120):
        n, k = rng.choice([10, 60, 300, 900]), rng.choice([1, 2, 3, 50])
        text = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            p = rng.randrange(1, max(2, n // 4))
            a = rng.randrange(n)
            unit = text[a : a + p]
            e = min(n, a + p * rng.randrange(2, 9) + rng.randrange(p))
            text[a:e] = (unit * 10)[: e - a]
        yield text
    a, b = ["x"], ["y"]  # Fibonacci words, many nested repetitions
    for _ in range(13):
        a, b = a + b, a
    yield a
    thue = [0]
    for _ in range(9):
        thue += [1 - x for x in thue]
    yield [str(x) for x in thue] * 3
    yield (["a"] * 12 + ["b"]) * 5 + ["a"] * 100
    yield ((["a"] * 40 + ["b"]) * 4 + ["c"]) * 4


def test_runs_equal_brute_force():
    texts = list(strings(random.Random(5)))
    got = runs_of([[w.encode() for w in t] for t in texts])
    for text, runs in zip(texts, got, strict=True):
        assert runs == brute_runs(text)
    assert sum(map(len, got)) > 100


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(t)) for i, t in enumerate(strings(rng)) if i % 3 == 0]
    out += [(None, "a " * 50), (1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r "), (1003, "é ü x y " * 30),
            (1004, "same " * 24), (1005, "same " * 23), (1005, "same " * 23), (40, "ab cd " * 12)]
    return out


def test_registered_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, n_runs string, length int")
    got = periodic_runs(docs, plant=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert periodic_runs(docs.limit(0), plant=True).count() == 0


def test_library_form_gives_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 20 + "end")], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 60, 3)]
    assert row.text == "start a b c end"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    chosen = [d for d in docs if len((d.text or "").split()) < 700]
    got = {r.doc_id: tuple(r) for r in Q.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in chosen:
        assert got[d.doc_id] == expected(d.doc_id, d.text)
    assert np.mean([r[1] > 0 for r in got.values()]) > 0.05
