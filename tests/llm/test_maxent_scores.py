"""Maximum-entropy scores: exact counts, a normalised model, held-out gain."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import maxent as M
from ledgerlens.llm import queries as Q
from ledgerlens.llm.maxent import maxent_scores


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_rows(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = split(t)
        yield (i, held(i), len(words), sum(w in counts for w in words), n,
               sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))


def same(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(base_rows(rows), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in have], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def sentences(rng, n):
    """Text in which a word tells much about the next one."""
    words = [f"w{k}" for k in range(200)]
    follow = {w: rng.sample(words, 3) for w in words}
    for _ in range(n):
        w, out = rng.choice(words), []
        for _ in range(rng.randrange(20, 80)):
            out.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.choice(words)
        yield " ".join(out)


def test_learns_order_and_beats_the_base(spark):
    rng = random.Random(1)
    rows = list(enumerate(sentences(rng, 3000)))
    mixed_up = [(i + 10_000, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows if held(i)]
    mixed_up = [(i, t) for i, t in mixed_up if held(i)]  # so that nobody learns from them
    got = maxent_scores(spark.createDataFrame(rows + mixed_up, "doc_id long, text string")).collect()
    same(got, rows + mixed_up)
    true = [r for r in got if r.held_out and r.doc_id < 10_000]
    per_token = sum(r.score for r in true) / sum(r.n_tokens for r in true)
    base = sum(r.base_score for r in true) / sum(r.n_tokens for r in true)
    assert per_token > base + 0.25
    by_id = {r.doc_id: r.score for r in got}
    assert sum(by_id[i] < by_id[i - 10_000] for i, _ in mixed_up) > 0.95 * len(mixed_up) > 20


def test_probabilities_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASS_WORDS", 4)
    monkeypatch.setattr(M, "HEAD", 4 * M.HEAD_CLASSES)
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(sentences(rng, 400)) if not held(i)]
    value = {w: M.tokens([w])[1][0] for w in {w for _, t in rows for w in t.split()}}
    counts = Counter(w for _, t in rows for w in split(t))
    end = M.tokens([""])[1][0]
    table = [(int(np.uint64(value.get(w, end)).view(np.int64)), c) for w, c in counts.items()]
    model = M._model(spark.createDataFrame(table, "word long, c long"))
    learner = M.Learner(model)
    learner.learn(*M.tokens([t for _, t in rows]))
    model.classes, model.words = learner.tables
    vocabulary = list(value) + [None]
    for history in (["w1", "w2"], ["w7"], ["unknown", "w3"], []):
        total = 0.0
        for w in vocabulary:
            text = " ".join([*history, w]) if w else " ".join(history)
            owner, hashes = M.tokens([text])
            at, outcome = len(history), model.outcomes(hashes)
            chance = M.log_chances(model, owner, hashes, outcome)[at]
            if outcome[at] >= M.HEAD:
                chance += math.log(counts[w] + 1) - model.tail[M.tail_class(hashes)[at]]
            total += math.exp(chance)
        unknown = 0.0
        for c in range(M.TAIL_CLASSES):  # one place for the unknown words of each class
            owner, hashes = M.tokens([" ".join([*history, "x"])])
            hashes[len(history)] = (12345 << 10) + c
            unknown += math.exp(M.log_chances(model, owner, hashes, model.outcomes(hashes))[len(history)] - model.tail[c])
        assert abs(total + unknown - 1) < 1e-3


def test_sums_by_row():
    rng = np.random.default_rng(0)
    rows = np.minimum(rng.zipf(1.3, (500, 3)), 60_000).astype(np.uint16)
    slope = rng.normal(size=(500, 8)).astype(np.float32)
    found, sums, counts = M._sums_by_row(rows, slope)
    for row, total, n in zip(found, sums, counts, strict=True):
        at = np.argwhere(rows == row)[:, 0]
        assert n == len(at) and np.allclose(total, slope[at].sum(axis=0), atol=1e-4)
    assert sorted(found) == sorted(set(rows.reshape(-1)))


@pytest.mark.parametrize("limit", [50, 8 << 20])
def test_edge_cases(spark, limit):
    odd = [(None, "null id"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "É é MIX Mix mix"), (5, "a " * 3000), (6, "tie"),
           (6, "tie"), (7, "x" * 5000), (8, "a"), (9, "unseen-anywhere-else")]
    odd += [(i, f"word{i % 13} common") for i in range(20, 80)]
    frame = spark.createDataFrame([(*r, 1.0, "b") for r in odd], "doc_id long, text string, score double, block string")
    got = maxent_scores(frame, limit).collect()
    same(got, odd)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent_scores(frame.limit(0)).count() == 0
    only_held = [(i, "some words") for i in range(60) if held(i)]
    got = maxent_scores(spark.createDataFrame(only_held, "doc_id long, text string")).collect()
    same(got, only_held)
    assert {r.score for r in got} == {0.0}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(Q.op12_maxent_scores(spark, sf).collect(), rows)
