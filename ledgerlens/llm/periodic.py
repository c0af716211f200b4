"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least
``EXPONENT`` periods and ``LENGTH`` words long.  Periods below ``2 * FIRST`` are
found by comparing the words q apart.  The others are found at dyadic scales t,
each for the periods from 2t up to 4t:

* every stretch of t words has a hash as its identity; it counts as highly
  periodic if its period is t/3 at most, which the runs found before tell;
* a position is in the synchronising set if, among the identities of the t + 1
  stretches that begin there or up to t later, highly periodic ones left out,
  the smallest is the first or the last.  That depends on the next 2t words
  alone, so places with equal words agree on it;
* positions with equal contexts of 2t words, 2t to 4t apart, propose their
  distance as a period.  The words themselves then tell how far it holds.

No run is lost.  Let it have period q in [2t, 4t).  If all its stretches of t
words were highly periodic, so would be the run, with a smaller period than q.
So one is not; the one of smallest identity is in the set, within two periods
of the run's begin, and so is its counterpart one period away, with the same
context.  The regions that the set leaves out are highly periodic, and their
periods belong to the scales below.

Defined cases: a null or empty text has no word, no run, and the digests of the
empty string; a null id plants nothing (``op13_periodic_runs``); rows that repeat
each other give a row each; an empty table gives no rows; other columns are
ignored.  A text is worked on whole, in one task: memory is about 100 bytes a
word of the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.minhash import mixed
from ledgerlens.llm.tokenize import text_runs

EXPONENT, LENGTH = 3, 24
#: The smallest scale.
FIRST = 4
#: Characters of texts that are worked on together.
_CHARS = 2_000_000

_FIRST_HALF, _SECOND_HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _true_stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _reach(words: np.ndarray, at: int, apart: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the word
    ``apart`` places behind them."""
    done, size = 0, 64
    room = len(words) - apart - at if step > 0 else at + 1
    while done < room:
        size = min(size, room - done)
        lo = at + done if step > 0 else at - done - size + 1
        differ = words[lo : lo + size] != words[lo + apart : lo + apart + size]
        if step < 0:
            differ = differ[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, size = done + size, 2 * size
    return done


def _smallest(identity: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size + 1`` neighbours (``size`` a power of two)."""
    width = 1
    while width < size:
        identity = np.minimum(identity[:-width], identity[width:])
        width *= 2
    return np.minimum(identity[:-1], identity[1:])


def _proposals(names: np.ndarray, twice: np.ndarray, left_out: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(distance, place) of positions of the set with equal contexts, sorted.

    ``names`` and ``twice``: identities of the stretches of ``scale`` and of
    ``2 * scale`` words; ``left_out``: highly periodic stretches."""
    identity = np.where(left_out, _NONE, names)
    least = _smallest(identity, scale)
    n = min(len(least), len(twice))
    least = least[:n]
    chosen = np.flatnonzero((least != _NONE) & ((least == identity[:n]) | (least == identity[scale : scale + n])))
    order = np.argsort(twice[chosen], kind="stable")
    place, context = chosen[order], twice[chosen[order]]
    found, k = [], 1
    while k < len(place):
        near = (context[k:] == context[:-k]) & (place[k:] - place[:-k] < 4 * scale)
        if not near.any():  # contexts of the set don't overlap by much: k stays small
            break
        apart = (place[k:] - place[:-k])[near]
        far = apart >= 2 * scale
        found += zip(apart[far].tolist(), place[:-k][near][far].tolist(), strict=True)
        k += 1
    return sorted(found)


def repetitions(words: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], int]:
    """Smallest period by (begin, end) of every maximal stretch of at least
    ``EXPONENT`` periods, in texts that lie one behind the other in ``words``,
    by falling length, each closed by a word of its own."""
    runs: dict[tuple[int, int], int] = {}
    for q in range(1, 2 * FIRST):
        begin, end = _true_stretches(words[:-q] == words[q:])
        long = end - begin >= (EXPONENT - 1) * q
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            runs.setdefault((b, e + q), q)

    reach = np.cumsum(lengths + 1)
    names, scale, width = mixed(words.astype(np.uint64) * _FIRST_HALF), FIRST, 1
    while True:
        active = int(np.searchsorted(-lengths, -2 * EXPONENT * scale, side="right"))
        if not active:
            return runs
        names = names[: reach[active - 1]]
        while width < scale:
            names = mixed(names[:-width] * _FIRST_HALF + names[width:] * _SECOND_HALF)
            width *= 2
        twice = mixed(names[:-scale] * _FIRST_HALF + names[scale:] * _SECOND_HALF)
        begins = np.zeros(len(names) + 1, np.int32)
        for (b, e), p in runs.items():
            if 3 * p <= scale <= e - b and b < len(names):
                begins[b] += 1
                begins[min(e - scale + 1, len(names))] -= 1
        seen: dict[int, int] = defaultdict(int)  # how far a distance is known
        for apart, place in _proposals(names, twice, np.cumsum(begins[:-1]) > 0, scale):
            if place < seen[apart]:
                continue
            b = place - _reach(words, place - 1, apart, -1) if place else 0
            e = place + _reach(words, place, apart, 1)
            seen[apart] = e
            if e - b >= (EXPONENT - 1) * apart:
                runs.setdefault((b, e + apart), apart)
        scale *= 2


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a list of words, by
    start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.empty(int(sizes.sum()), object)
    at = 0
    for t in order:
        flat[at : at + sizes[t]] = texts[t]
        at += int(sizes[t])
    codes = pd.factorize(flat)[0] if len(flat) else np.empty(0, np.int64)
    lengths = sizes[order]
    ends = np.cumsum(lengths + 1)
    words = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(words), bool)
    inside[ends - 1] = False
    words[inside] = codes
    words[ends - 1] = -1 - np.arange(len(ends))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (b, e), p in repetitions(words, lengths).items():
        if e - b >= LENGTH:
            nth = int(np.searchsorted(ends, b, side="right"))
            found[order[nth]].append((b - int(ends[nth] - lengths[nth] - 1), e - b, p))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def longest_exponent(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with a repetition in a tenth of the documents, by their id."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _scan(plant: bool):
    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in text_runs(texts, _CHARS):
                # The separators of bytes.split are exactly the six white-space bytes.
                words = [t.encode("utf-8", "surrogatepass").split() for t in texts[lo:hi]]
                if plant:
                    words = [planted(i, w) for i, w in zip(ids[lo:hi], words, strict=True)]
                found, kept, out = runs_of(words), [], []
                for w, runs in zip(words, found, strict=True):
                    best = longest_exponent(runs)
                    kept.append(b" ".join(collapsed(w, runs)))
                    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    out.append((len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                                hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept[-1]).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.string()] * 2,
                                                          strict=True)]
                if not plant:
                    columns += [pa.array([[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found], _RUNS),
                                pa.array(kept).cast(pa.string())]
                names = ["doc_id", *_FIGURES, *([] if plant else ["runs", "text"])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=names)

    return scan


_FIGURES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the number of runs, the run of greatest
    exponent, digests, the ``runs`` themselves and the collapsed ``text``.

    ``plant`` first writes a repetition into a tenth of the texts and leaves the
    last two columns out.  One pass over the documents, no shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = "" if plant else ", runs array<struct<start: long, length: long, period: long>>, text string"
    return docs.select("doc_id", "text").mapInArrow(_scan(plant), f"doc_id {id_type}, {_SCHEMA}{more}")
