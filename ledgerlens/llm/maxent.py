"""Language-model scores by a hashed maximum-entropy model.

Tokens are the lower-cased words of a text and one end token.  Outcomes are
factored into classes: the ``HEAD`` most frequent words of the training texts
lie in ``HEAD_CLASSES`` classes of neighbouring frequency, every other word, known
or not, in one of ``TAIL_CLASSES`` classes by its last two bytes.

    P(w | h) = P(class(w) | h) * P(w | class(w), h)

P(class | h) is a softmax over the classes, P(w | class, h) of a head class one
over its words.  The features of a history are the word before, the two words
before together (n-grams) and the word before that one (skip); each names, by
hash, a row of a weight table with a weight per outcome.  A constant feature
starts from the logarithm of the frequencies.  For a tail class, whose only
feature is the constant one, the maximum-entropy solution is known: frequencies,
smoothed by one, with one place for all unknown words.  So the probabilities of
all known words and the unknown one add up to one after every history.

Training: ``ROUNDS`` rounds, each over its own part of the training texts, so that
every text is used once.  A task goes through its texts in small batches, with
gradient steps (AdaGrad, one rate per row) on a copy of the weights.  The
changes of all tasks are added up row by row, weighted by how often each task
met the row, and the mean makes the next weights.  The tables have a row per
``TOKENS_PER_ROW`` training tokens, ``2 ** MAX_BITS`` at most; they are the model that is
sent to the tasks (at most 2 * 2 ** MAX_BITS * 64 * 4 bytes = 32 MB).

The word counts of the corpus are a distributed table that grows with it.  Texts
lie in blocks of about ``BLOCK_CHARS`` characters.  A block's words, with their
counts in it, meet those of the other blocks in a window by word, and go back to
it with the sum: no task holds more than the words of a block.

Defined cases: null and empty texts consist of the end token; a null id trains
(it has no remainder); without a training text all counts are 0, the base score
is 0 and so is the score; equal rows get equal scores; words are told apart by a
64-bit hash; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged
from ledgerlens.llm.minhash import _block_words, _SEPARATOR, mixed
from ledgerlens.llm.tokenize import text_runs

#: Words with classes of their own frequency, and classes of both kinds.
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 64, 32
HEAD = HEAD_CLASSES * CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Size of the weight tables.
TOKENS_PER_ROW, MIN_BITS, MAX_BITS = 8192, 10, 16
ROUNDS, STEP, MINI_BATCH = 2, 0.1, 4096
LARGEST = np.float32(40)
_OFTEN = 24
#: Characters that are cut into tokens together, few enough for a processor's cache.
_CHARS = 200_000
#: Characters of a block of texts, and of the texts that a training task reads.
BLOCK_CHARS, TASK_CHARS = 32 << 20, 256 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_KINDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_HASH = ~np.uint64(TAIL_CLASSES - 1)  # TAIL_CLASSES is a power of two
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every token; each text ends in the end token.
    The lowest bits of a hash are the tail class of its word."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    limits = np.cumsum([len(p) + 1 for p in parts])
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    begin, value = _block_words(data)
    apart = _SEPARATOR[data]
    end = np.flatnonzero(apart & ~np.concatenate([[True], apart[:-1]]))
    last = data[end - 1].astype(np.uint64) * np.uint64(256) + np.where(end - begin > 1, data[end - 2], 0).astype(np.uint64)
    value = value & _HASH | mixed(last * _ODD) & ~_HASH
    owner = np.searchsorted(limits, begin, side="right")
    # The end tokens go behind the words of their texts.
    count = np.bincount(owner, minlength=len(parts))
    closes = np.cumsum(count + 1) - 1
    n = len(owner) + len(parts)
    words = np.ones(n, bool)
    words[closes] = False
    owners, values = np.empty(n, np.int64), np.full(n, _END & _HASH, np.uint64)
    owners[words], values[words] = owner, value
    owners[closes] = np.arange(len(parts))
    return owners, values


def tail_class(value: np.ndarray) -> np.ndarray:
    return (value & ~_HASH).astype(np.int64)


def training(ids: list) -> np.ndarray:
    """Whether the model learns from the documents of these ids."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i in ids], bool)


@dataclass
class Model:
    """What scoring sends to the tasks; its size has a documented bound."""

    head: np.ndarray      # hashes of the head words, sorted
    outcome: np.ndarray   # their places by frequency
    count: np.ndarray     # and their training counts
    bits: int             # of the rows of the weight tables
    classes: np.ndarray   # weights of the classes, and their constants in the last row
    words: np.ndarray     # weights of the words in a head class, then the constants of each class
    tail: np.ndarray      # natural logarithm of the size of each tail class, counts and places
    tokens: int           # training tokens
    kinds: int            # and distinct ones

    def outcomes(self, value: np.ndarray) -> np.ndarray:
        """Place of head words, ``HEAD`` and more for the class of the others."""
        if not len(self.head):
            return HEAD + tail_class(value)
        at = np.minimum(np.searchsorted(self.head, value), len(self.head) - 1)
        return np.where(self.head[at] == value, self.outcome[at], HEAD + tail_class(value))

    def features(self, owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Hash of each feature of every token's history (token x feature)."""
        before = np.full((2, len(value)), _BEGIN, np.uint64)
        for k in (1, 2):
            same = owner[k:] == owner[:-k]
            before[k - 1, k:][same] = value[:-k][same]
        first, second = before
        return np.stack([mixed(first * _ODD ^ _KINDS[0]), mixed(mixed(first + second * _ODD) ^ _KINDS[1]),
                         mixed(second * _ODD ^ _KINDS[2])], axis=1)

    def class_rows(self, features: np.ndarray) -> np.ndarray:
        return (features >> np.uint64(64 - self.bits)).astype(np.uint16)

    def word_rows(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        own = mixed(classes.astype(np.uint64) + np.uint64(1))[:, None]
        return (mixed(features ^ own) >> np.uint64(64 - self.bits)).astype(np.uint16)


def _logits(table: np.ndarray, rows: np.ndarray, constant: np.ndarray) -> np.ndarray:
    out = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += table.take(rows[:, k], axis=0)
    out += constant
    return out


def _softmax_of(logits: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural logarithm of each row's outcome; the exponentials, their sums.
    The constants are logarithms of shares, so that only weights could make a
    large sum; ``LARGEST`` bounds it alike in training and scoring."""
    if logits.max() > LARGEST:
        np.minimum(logits, LARGEST, out=logits)
    at = logits[np.arange(len(logits)), outcome]
    powers = np.exp(logits, out=logits)
    total = powers @ np.ones(powers.shape[1], np.float32)
    return at - np.log(total), powers, total


def log_chances(model: Model, owner: np.ndarray, value: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(class) for every token, times P(word | class) for
    the head words."""
    out, features = np.empty(len(value)), model.features(owner, value)
    rows, constants = 1 << model.bits, model.words[1 << model.bits :]
    for lo in range(0, len(value), MINI_BATCH):
        part, f = outcome[lo : lo + MINI_BATCH], features[lo : lo + MINI_BATCH]
        in_head = part < HEAD
        classes = np.where(in_head, part // CLASS_WORDS, part - HEAD + HEAD_CLASSES)
        chance = _softmax_of(_logits(model.classes, model.class_rows(f), model.classes[rows]), classes)[0].astype(float)
        own = classes[in_head]
        if len(own):
            chance[in_head] += _softmax_of(_logits(model.words, model.word_rows(f[in_head], own), constants.take(own, axis=0)),
                                           part[in_head] % CLASS_WORDS)[0]
        out[lo : lo + MINI_BATCH] = chance
    return out


def _sums_by_row(rows: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows (token x feature), the sum of the slopes of the tokens
    that name each, and how many do."""
    flat = rows.reshape(-1)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.concatenate([first, [len(flat)]]))
    falling = np.argsort(-counts, kind="stable")
    first, counts, order = first[falling], counts[falling], order // rows.shape[1]
    sums = slope.take(order[first], axis=0)
    often = int(np.searchsorted(-counts, -_OFTEN, side="left"))
    for k in range(often):
        sums[k] = slope[order[first[k] : first[k] + counts[k]]].sum(axis=0)
    for nth in range(1, int(counts[often]) if often < len(counts) else 0):
        more = int(np.searchsorted(-counts, -nth, side="left"))
        sums[often:more] += slope.take(order[first[often:more] + nth], axis=0)
    return flat[first], sums, counts


class Learner:
    """Gradient steps of one task on a copy of the weights."""

    def __init__(self, model: Model):
        self.model = model
        n = 1 << model.bits
        self.tables = [model.classes.copy(), model.words.copy()]
        self.squares = [np.full(n, 1e-2, np.float32) for _ in self.tables]
        self.met = [np.zeros(n, np.int64) for _ in self.tables]

    def _step(self, which: int, rows: np.ndarray, powers: np.ndarray, total: np.ndarray, outcome: np.ndarray) -> None:
        slope = powers
        slope *= (-1 / total)[:, None]
        slope[np.arange(len(slope)), outcome] += 1
        found, change, counts = _sums_by_row(rows, slope)
        squares = self.squares[which]
        squares[found] += np.einsum("ij,ij->i", change, change) / change.shape[1]
        change *= (STEP / np.sqrt(squares[found]))[:, None]
        change += self.tables[which].take(found, axis=0)
        self.tables[which][found] = change
        self.met[which][found] += counts

    def learn(self, owner: np.ndarray, value: np.ndarray) -> None:
        model, n = self.model, 1 << self.model.bits
        outcome, features = model.outcomes(value), model.features(owner, value)
        for lo in range(0, len(value), MINI_BATCH):
            part, f = outcome[lo : lo + MINI_BATCH], features[lo : lo + MINI_BATCH]
            in_head = part < HEAD
            classes = np.where(in_head, part // CLASS_WORDS, part - HEAD + HEAD_CLASSES)
            rows = model.class_rows(f)
            _, powers, total = _softmax_of(_logits(self.tables[0], rows, self.tables[0][n]), classes)
            self._step(0, rows, powers, total, classes)
            own, word = classes[in_head], part[in_head] % CLASS_WORDS
            if len(own):
                rows = model.word_rows(f[in_head], own)
                _, powers, total = _softmax_of(_logits(self.tables[1], rows, self.tables[1].take(n + own, axis=0)), word)
                self._step(1, rows, powers, total, word)

    def changes(self, per_chunk: int):
        """Changes by chunk of rows: table, chunk, how often met, change."""
        n = 1 << self.model.bits
        for which, (new, old) in enumerate(zip(self.tables, (self.model.classes, self.model.words), strict=True)):
            for lo in range(0, n, per_chunk):
                met = self.met[which][lo : lo + per_chunk]
                if met.any():
                    moved = new[lo : lo + per_chunk] - old[lo : lo + per_chunk]
                    yield which, lo // per_chunk, met.tobytes(), moved.astype(np.float16).tobytes()


# ------------------------------------------------------------- passes over the texts
def _blocks(chars: int):
    """Adds the number of a block of about ``chars`` characters within the task."""
    def number(batches):
        block = size = 0
        for batch in batches:
            numbers = []
            for text in batch.column(1).to_pylist():
                numbers.append(block)
                size += len(text or "")
                if size >= chars:
                    block, size = block + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())],
                                             names=["doc_id", "text", "part", "run"])

    return number


def _counts(batches):
    """Words of each block with their count in training texts (0: none), once a
    block: its rows follow each other."""
    block, values = None, ([], [])

    def told():
        learnt, held = (np.concatenate(v) if v else np.empty(0, np.uint64) for v in values)
        kinds, n = np.unique(learnt, return_counts=True)
        only = np.setdiff1d(held, kinds)
        n = np.concatenate([n, np.zeros(len(only), np.int64)])
        kinds = np.concatenate([kinds, only])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(kinds), block)), pa.array(kinds.view(np.int64)), pa.array(n)], names=["block", "word", "n"])

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        learn = training(batch.column("doc_id").to_pylist())
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > begin and blocks[begin] != block:
                if block is not None:
                    yield told()
                block, values = int(blocks[begin]), ([], [])
            for lo, hi in text_runs(texts[begin:end], _CHARS):
                owner, value = tokens(texts[begin + lo : begin + hi])
                of_learnt = learn[begin + lo : begin + hi][owner]
                values[0].append(value[of_learnt])
                values[1].append(np.unique(value[~of_learnt]))
    if block is not None:
        yield told()


PER_CHUNK = 1024


def _train(sent, round_of: int):
    def train(batches):
        learner = None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            chosen = [t for i, t, ok in zip(ids, texts, training(ids), strict=True)
                      if ok and zlib.crc32(f"round {i}".encode()) % ROUNDS == round_of]
            if chosen and learner is None:
                learner = Learner(sent.value)
            for lo, hi in text_runs([t or "" for t in chosen], _CHARS):
                learner.learn(*tokens(chosen[lo:hi]))
        if learner is not None:
            rows = [(w, c, m, d) for w, c, m, d in learner.changes(PER_CHUNK)]
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHANGE, strict=True)],
                                                 names=["which", "chunk", "met", "moved"])

    return train


_CHANGE = (pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _sum(batches):
    """Adds up the changes of the chunks that a task gets; memory: the model."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for which, chunk, met, moved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            weights = np.frombuffer(met, np.int64)
            change = np.frombuffer(moved, np.float16).reshape(len(weights), -1).astype(float) * weights[:, None]
            have = sums.get((which, chunk))
            if have is None:
                sums[which, chunk] = [weights.copy(), change]
            else:
                have[0] += weights
                have[1] += change
    for (which, chunk), (weights, change) in sums.items():
        mean = change / np.maximum(weights, 1)[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([which], pa.int32()), pa.array([chunk], pa.int32()), pa.array([mean.astype(np.float32).tobytes()])],
            names=["which", "chunk", "mean"])


def _score(sent, id_type):
    """Scores of one block, with the counts of its words."""
    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        model = sent.value
        ids, docs = texts.column("doc_id"), texts.column("text").to_pylist()
        known = words.column("word").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, count = known[order], words.column("c").to_numpy()[order]
        whole = model.tokens + model.kinds + 1
        columns = []
        for lo, hi in text_runs([t or "" for t in docs], _CHARS):
            owner, value = tokens(docs[lo:hi])
            outcome = model.outcomes(value)
            rest = outcome >= HEAD
            c = model.count[np.where(rest, 0, outcome)]
            c[rest] = count[np.searchsorted(known, value[rest])]
            base = np.log10((c + 1) / whole)
            chance = log_chances(model, owner, value, outcome)
            chance[rest] += np.log(c[rest] + 1) - model.tail[tail_class(value[rest])]
            chance /= math.log(10)
            if not model.tokens:
                chance[:] = 0
            sums = [np.bincount(owner, weights=w, minlength=hi - lo) for w in (c > 0, base, chance)]
            columns.append((np.bincount(owner, minlength=hi - lo), sums[0].astype(np.int64), *sums[1:]))
        n, have, base, chance = (np.concatenate(c) for c in zip(*columns, strict=True))
        held = ~training(ids.to_pylist())
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": have,
                         "train_tokens": np.full(len(n), model.tokens, np.int64), "base_score": base, "score": chance})

    return score


# ---------------------------------------------------------------------- the operator
def _model(counts: DataFrame) -> Model:
    """The untrained model: head words, classes, constants."""
    known = counts.filter("c > 0").withColumn("tail", F.col("word").bitwiseAND(TAIL_CLASSES - 1).cast("int"))
    sizes = known.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()  # TAIL_CLASSES rows
    n, kinds = sum(r.c for r in sizes), sum(r.kinds for r in sizes)
    bits = min(max(math.ceil(math.log2(max(n, 1) / TOKENS_PER_ROW)), MIN_BITS), MAX_BITS)
    top = known.orderBy(F.desc("c"), "word").limit(HEAD).collect()  # HEAD rows
    places, places_of = np.zeros(TAIL_CLASSES), np.ones(TAIL_CLASSES)
    for r in sizes:
        places[r.tail], places_of[r.tail] = r.c, r.kinds + 1
    frequency = np.zeros((HEAD_CLASSES, CLASS_WORDS))
    for k, r in enumerate(top):
        frequency.reshape(-1)[k] = r.c
        places[r.tail] -= r.c
        places_of[r.tail] -= 1
    classes = np.zeros(((1 << bits) + 1, CLASSES), np.float32)
    weight = np.concatenate([frequency.sum(axis=1), places + places_of])
    classes[-1] = np.log(np.maximum(weight, 1e-9) / weight.sum())
    words = np.zeros(((1 << bits) + HEAD_CLASSES, CLASS_WORDS), np.float32)
    words[1 << bits :] = np.log(np.maximum(frequency, 1e-9) / np.maximum(frequency.sum(axis=1, keepdims=True), 1))
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    count = np.array([*(r.c for r in top), 0], np.int64)
    return Model(hashes[order], order, count, bits, classes, words, np.log(places + places_of), n, kinds)


def trained(texts: DataFrame, counts: DataFrame, chars: int) -> Model:
    """The model of ``texts`` (``doc_id, text``), whose words have ``counts``."""
    spark = texts.sparkSession
    model = _model(counts)
    if not model.tokens:
        return model
    tasks = max(1, spark.sparkContext.defaultParallelism, chars // TASK_CHARS)
    parts = texts.select("doc_id", "text").coalesce(tasks)
    for nth in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        moved = parts.mapInArrow(_train(sent, nth), "which int, chunk int, met binary, moved binary")
        summed = staged(moved.repartition("which", "chunk").mapInArrow(_sum, "which int, chunk int, mean binary"), "lm-round")
        tables = [model.classes.copy(), model.words.copy()]
        for row in summed.toLocalIterator():  # together the size of the model
            mean = np.frombuffer(row["mean"], np.float32).reshape(-1, tables[row["which"]].shape[1])
            lo = row["chunk"] * PER_CHUNK
            tables[row["which"]][lo : lo + len(mean)] += mean
        model = replace(model, classes=tables[0], words=tables[1])
        sent.unpersist()
    return model


def maxent_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    per row of ``docs``."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(
        _blocks(block_chars), f"doc_id {id_type}, text string, part long, run long")
    placed = staged(placed.select("doc_id", "text", F.shiftleft("part", 32).bitwiseOR(F.col("run")).alias("block")), "lm-texts")
    word = Window.partitionBy("word")
    words = staged(placed.mapInArrow(_counts, "block long, word long, n long").select(
        "block", "word", F.sum("n").over(word).alias("c"),
        (F.row_number().over(word.orderBy("block")) == 1).alias("first")), "lm-words")
    counts = words.filter("first").select("word", "c")
    chars = placed.agg(F.sum(F.length("text"))).first()[0] or 0
    model = trained(placed, counts, chars)
    sent = spark.sparkContext.broadcast(model)
    return placed.groupBy("block").cogroup(words.drop("first").groupBy("block")).applyInArrow(
        _score(sent, id_type), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double")
