"""Language identification by bit-sliced Bloom filters of character n-grams.

Training keeps, per language, the n-grams found in at least ``MIN_SHARE`` of its
training documents.  All languages share one table of slots; a slot holds a bit
mask with a bit per language, so the masks of an n-gram's slots, combined by
AND, name every language that (probably) has the n-gram.  A text is scored by
the per-language popcounts over all its n-grams, corrected for the false
positives that the fill of each language's bits predicts.

Training reads a bounded sample: about ``TRAIN_DOCS`` documents a language,
chosen by a hash of the text.  The slot table is bounded by ``SLOTS``.

Defined cases: ``und`` with score 0 for a null text or one without a letter; a
text whose n-grams are all unknown gets the language with most training
documents and score 0; ties go to the language first in code-point order; rows
without a language don't train; with no training rows all results are ``und``;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged

GRAM = 4
TRAIN_DOCS = 3000
MIN_SHARE = 0.002
SLOTS = 1 << 20
HASHES = 3
#: Languages per 64-bit mask word (the sign bit is left out).
WORD_BITS = 63

_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (lower-case letters, words set apart by single
    spaces), and the number of n-grams of each text."""
    flat = [f" {' '.join(_LETTERS.findall(t.lower()))} " if t else "" for t in texts]
    lengths = np.array([len(f) for f in flat], dtype=np.int64)
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < GRAM:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h += codes[k : len(h) + k] * np.uint64(_MIX[k])
    counts = np.maximum(lengths - GRAM + 1, 0)
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes), bool)  # n-grams may not begin in a text's last places
    for back in range(1, GRAM):
        at = ends - back
        inside[at[(lengths >= back)]] = False
    return _mixed(h[inside[: len(h)]]), counts


def slots_of(h: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)]


def held_out(column: Column) -> Column:
    """Is the remainder of crc32 of the id as text, by 5, zero?  Null ids count
    as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Languages, their slots' bit masks, and false-positive rates."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray, hashes: int):
        self.languages, self.prior, self.table, self.hashes = languages, prior, table, hashes
        fill = [((table[:, i // WORD_BITS] >> np.int64(i % WORD_BITS)) & 1).mean() for i in range(len(languages))]
        self.false_rate = np.minimum(np.array(fill) ** hashes, 0.99)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        h, counts = gram_hashes(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        masks = None
        for at in slots_of(h, len(self.table), self.hashes):
            masks = self.table[at] if masks is None else masks & self.table[at]
        share = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[:, i // WORD_BITS] >> np.int64(i % WORD_BITS)) & 1
            hits = np.bincount(owner, weights=bit, minlength=len(texts))
            expected = counts * self.false_rate[i]
            share[:, i] = np.maximum(hits - expected, 0) / (1 - self.false_rate[i])
        share /= np.maximum(counts, 1)[:, None]
        best = share.argmax(axis=1)
        unknown = share.max(axis=1, initial=0) <= 0
        if unknown.any():
            best[unknown] = self.prior.argmax()
        has_letter = np.array([bool(t) and bool(_LETTERS.search(t)) for t in texts])
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)]
        scores = np.where(has_letter, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)
        return names, scores.tolist()


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE,
          slots: int = SLOTS, hashes: int = HASHES) -> Model | None:
    """Fit on the rows of ``docs`` (text, lang) that have both.  At most one row
    per language and ``slots`` rows of masks reach the driver."""
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not known:
        return None
    languages = sorted(r["lang"] for r in known)
    number = {r["lang"]: r["n"] for r in known}
    spark = docs.sparkSession
    # A hash threshold per language leaves about train_docs of its documents.
    rates = F.create_map(*(F.lit(x) for lang in languages for x in (lang, train_docs / number[lang])))
    draw = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 40)) / float(1 << 40)
    code = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))
    sample = labelled.filter(draw < rates[F.col("lang")]).select(code[F.col("lang")].alias("code"), "text")

    def grams(batches):
        for batch in batches:
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, _ = gram_hashes([text])
                found = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found) + 1, code, np.int32)),
                     pa.array([None, *found.tolist()], pa.int64())], names=["code", "gram"])

    # The null gram of each document counts the documents.
    counts = staged(sample.mapInArrow(grams, "code int, gram long").groupBy("code", "gram")
                    .agg(F.count("*").alias("n")), "lang-grams")
    trained = {r["code"]: r["n"] for r in counts.filter("gram IS NULL").collect()}
    least = F.create_map(*(F.lit(x) for c, n in trained.items() for x in (c, max(2.0, min_share * n))))
    chosen = counts.filter(F.col("gram").isNotNull() & (F.col("n") >= least[F.col("code")])).select("code", "gram")

    def bits(batches):
        for batch in batches:
            code, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at in slots_of(h, slots, hashes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(code // WORD_BITS), pa.array(np.int64(1) << (code % WORD_BITS).astype(np.int64))],
                    names=["slot", "word", "mask"])

    masks = chosen.mapInArrow(bits, "slot long, word int, mask long").groupBy("slot", "word").agg(
        F.bit_or("mask").alias("mask"))
    table = np.zeros((slots, -(-len(languages) // WORD_BITS)), np.int64)
    rows = masks.toArrow()
    table[rows["slot"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy()
    prior = np.array([number[lang] for lang in languages])
    del spark
    return Model(languages, prior, table, hashes)


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            names, scores, lo, size = [], [], 0, 0
            for hi, text in enumerate(texts, start=1):
                size += len(text or "")
                if size >= 1_000_000 or hi == len(texts):
                    part = shared.value.predict(texts[lo:hi])
                    names += part[0]
                    scores += part[1]
                    lo, size = hi, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    narrow = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(predict, f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; held-out rows don't train."""
    narrow = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(narrow.filter("NOT held_out"), **options)
    return identify(narrow, model, ["doc_id", "held_out"])
