"""Near-duplicate detection by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles (words as they stand; a text
of one to four words is one shingle).  Two texts are near duplicates when their
weighted Jaccard similarity, sum of minima over sum of maxima of the counts, is
``THRESHOLD`` or more.

Signatures: the weight axis of a shingle is cut into dyadic levels [0, 1),
[1, 2), [2, 4), ...  Each level of each shingle has a Poisson process of points
seeded by both, at a rate equal to the level's width; a point has a time and a
register, and in the level where the weight ends also a position on the weight
axis, which must lie below the weight.  A register holds the earliest point of
all processes below the text's weights, so two texts agree in a register with
probability equal to their similarity.  Points are drawn up to a time by which
nearly all registers are filled, and longer where some are not.

Search: bands of ``ROWS`` registers name buckets.  Equal texts are one node.
In a bucket, every node is compared with the bucket's pivot, a random node of it
(exact multiset overlap on 64-bit shingle hashes), and similar nodes are linked.
Components of the links are classes.  While buckets that hold several classes
have many pairs across them, each gets another pivot.  What is left is compared
in full across the classes of a bucket, but for pairs that cannot be similar: by
the triangle inequality (one minus the similarity is a metric) on their
similarities to the first pivot, or by their shingle counts in ``CELLS`` parts
of the hash range, as the sum of the smaller counts is an overlap at least as
large as the true one.
So a bucket of one class costs one comparison a node, and no pair of a bucket
is lost.

Defined cases: a null text, or one without a word, is alone in its class; rows
that repeat each other are in one class; the row with the smallest id (null
last) stays; an empty table gives no rows; other columns are ignored, and pass
through ``near_dedup_filter`` whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column_of, own_names, staged
from ledgerlens.llm.components import components, spanning
from ledgerlens.llm.tokenize import small_batches, text_runs

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 all bands miss with probability (1 - 0.8^6)^32 = 6e-5.
BANDS, ROWS = 32, 6
#: Pivots of a bucket at most before its classes are compared in full, and the
#: number of pairs a node that is few enough to do that at once.
TURNS, FEW_PAIRS = 2, 4
#: Cells of the hash range (powers of two) in which shingles are counted: a
#: quick bound, and a closer one for long texts.
CELLS = (128, 512)

#: Bytes that are hashed together; a worker keeps 16 bytes of powers for each.
_BYTES = 1 << 20
#: Points drawn at once, and texts signed at once.
_POINTS, _TEXTS = 1 << 15, 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, at least n of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word of a block that ends in a separator.

    A polynomial hash over random values of the bytes: differences of prefix
    sums, divided by the power of the word's first place."""
    apart = _SEPARATOR[data]
    before = np.concatenate([[True], apart[:-1]])
    begin, end = np.flatnonzero(~apart & before), np.flatnonzero(apart & ~before)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(_BASE, len(data))[: len(data)], out=sums[1:])
    value = (sums[end] - sums[begin]) * _powers(_INVERSE, len(data))[begin]
    return begin, mixed(value + (end - begin).astype(np.uint64) * _ODD)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of the texts, in order."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    limits = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins, values, at = [], [], 0
    while at < len(data):
        cut = min(at + _BYTES, len(data))
        if cut < len(data):  # back to a separator, or on to one behind a huge word
            back = np.flatnonzero(_SEPARATOR[data[at:cut]])
            cut = at + int(back[-1]) + 1 if len(back) else cut
            while not _SEPARATOR[data[cut - 1]]:
                cut += 1
        begin, value = _block_words(data[at:cut])
        begins.append(begin + at)
        values.append(value)
        at = cut
    return np.searchsorted(limits, np.concatenate(begins), side="right"), np.concatenate(values)


def bags(texts: list, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle, sorted by both."""
    owner, words = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = max(len(words) - shingle + 1, 0)
    value = np.zeros(count, np.uint64)
    for k in range(shingle):
        value += mixed(words[k : count + k] + np.uint64(k)) * np.uint64(2 * k + 1)
    inside = owner[:count] == owner[shingle - 1 : count + shingle - 1]
    owners, values = owner[:count][inside], mixed(value[inside])
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        whole = []
        for t in short:
            h = np.uint64(n[t])
            for w in words[first[t] : first[t] + n[t]]:
                h = mixed(np.array([h ^ w], np.uint64) * _ODD)[0]
            whole.append(h)
        owners, values = np.concatenate([owners, short]), np.concatenate([values, np.array(whole, np.uint64)])
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return owners[at], values[at], np.diff(np.concatenate([at, [len(values)]]))


def _fill(owner, value, count, until, registers: int, out: np.ndarray) -> None:
    """Earliest points up to ``until[text]`` into ``out`` (text x register).

    ``owner`` is sorted.  All processes go forward by the same numbers of points,
    in slices of bounded size; a text whose registers are all filled needs no
    point later than the latest of them."""
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    of = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 1, 2.0 ** (level - 1), 1.0)
    weight = count[of].astype(float)
    text, seed = owner[of], mixed(value[of] + (level + 1).astype(np.uint64) * _ODD)
    time, limit = np.zeros(len(of)), until.copy()
    partial = low + width > weight
    flat, drawn, size = out.reshape(-1), 0, 1
    while len(text):
        steps = np.arange(drawn + 1, drawn + size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        each = max(1, _POINTS // size)
        for lo in range(0, len(text), each):
            at_once = slice(lo, lo + each)
            own = text[at_once]
            draw = mixed(seed[at_once, None] + steps)
            gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[at_once, None]
            at = time[at_once, None] + np.cumsum(gap, axis=1)
            time[at_once] = at[:, -1]
            good = np.flatnonzero(at <= limit[own, None])
            process = good // size
            at, more = at.reshape(-1)[good], mixed(draw.reshape(-1)[good] ^ _ODD)
            if partial[at_once].any():
                above = low[at_once][process] + width[at_once][process] * (
                    more & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32
                inside = ~partial[at_once][process] | (above < weight[at_once][process])
                at, more, process = at[inside], more[inside], process[inside]
            register = ((more >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            np.minimum.at(flat, own[process] * registers + register.astype(np.int64), at)
        live = text[np.concatenate([[True], text[1:] != text[:-1]])]
        limit[live] = np.minimum(limit[live], out[live].max(axis=1))
        on = time <= limit[text]
        text, seed, low, width, weight, partial, time = (x[on] for x in (text, seed, low, width, weight, partial, time))
        drawn += size
        size = min(2 * size, 256) if drawn > 2 else 1


def signatures(texts: list, registers: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Total shingle count of each text and its registers (inf without words)."""
    owner, value, count = bags(texts)
    total = np.bincount(owner, weights=count, minlength=len(texts))
    out = np.full((len(texts), registers), np.inf)
    todo, reach = np.flatnonzero(total > 0), math.log(registers) + 4
    while len(todo):
        until = np.full(len(texts), -1.0)
        until[todo] = registers / total[todo] * reach
        chosen = until[owner] > 0
        _fill(owner[chosen], value[chosen], count[chosen], until, registers, out)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        reach *= 2
    return total.astype(np.int64), out


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per text and band; times count to 24 bits of precision."""
    bits = registers.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), bits.shape[:2]).copy()
    for r in range(rows):
        key = mixed((key ^ bits[:, :, r]) * _ODD)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _sign(batches):
    for batch in small_batches(batches, 3):
        texts = batch.column(3).to_pylist()
        for lo, hi in text_runs([t or "" for t in texts], 1_000_000, _TEXTS):
            total, registers = signatures(texts[lo:hi])
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]), pa.int32()),
                pa.array(band_keys(registers[total > 0]).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(total), keys],
                names=["doc_id", "d1", "d2", "shingles", "bands"])


def _compare(batches):
    for batch in small_batches(batches, 2, 3):
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sims, lo, size = [], 0, 0
        for hi in range(1, batch.num_rows + 1):
            size += len(left[hi - 1]) + len(right[hi - 1])
            if size < 2_000_000 and hi < batch.num_rows:
                continue
            number = {t: i for i, t in enumerate(dict.fromkeys(left[lo:hi] + right[lo:hi]))}
            owner, value, count = bags(list(number))
            cuts = np.searchsorted(owner, np.arange(1, len(number)))
            bag = list(zip(np.split(value, cuts), np.split(count, cuts), strict=True))
            sims += [similarity(bag[number[x]], bag[number[y]]) for x, y in zip(left[lo:hi], right[lo:hi], strict=True)]
            lo, size = hi, 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())],
                                         names=["a", "b", "sim"])


def _digests() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "text").alias("d1"), F.xxhash64(F.lit(2), "text").alias("d2")


def cell_counts(texts: list, cells: int) -> np.ndarray:
    """Shingles (with repeats) of each text by the top bits of their hash."""
    owner, value, count = bags(texts)
    cell = owner * cells + (value >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.bincount(cell, weights=count, minlength=len(texts) * cells).astype(np.int64).reshape(-1, cells)


def _cells(batches):
    """Counts as two bytes; none for a text with a count that needs more."""
    for batch in small_batches(batches, 1):
        texts = batch.column(1).to_pylist()
        for lo, hi in text_runs(texts, 1_000_000):
            fine = cell_counts(texts[lo:hi], CELLS[1])
            levels = [fine.reshape(hi - lo, CELLS[0], -1).sum(axis=2), fine]
            small = levels[0].max(axis=1) < 1 << 15
            starts = np.concatenate([[0], np.cumsum(small)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(
                pa.ListArray.from_arrays(
                    pa.array(starts * cells, pa.int32()),
                    pa.array(counts[small].astype(np.int16).reshape(-1)), mask=pa.array(~small))
                for counts, cells in zip(levels, CELLS, strict=True))], names=["node", "coarse", "fine"])


def _overlap(x: str, y: str) -> Column:
    """Sum of the smaller counts of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda s, n: s + n)


def node_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, written."""
    keys = wanted.join(nodes, "node").select("node", F.col("doc_id").alias("_id"), "d1", "d2")
    return staged(docs.select("doc_id", *_digests(), "text").join(
        keys, ["d1", "d2"]).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("node", "text").dropDuplicates(["node"]), "near-texts")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, sim`` of the pairs of nodes of ``texts``, written."""
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return staged(both.select("a", "b", "ta", "tb").mapInArrow(_compare, "a long, b long, sim double"), "near-sims")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, kept, d1, d2`` per input row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", *_digests(), "text").mapInArrow(
        _sign, f"doc_id {id_type}, d1 long, d2 long, shingles long, bands array<long>")
    signed = staged(signed.withColumn("node", F.monotonically_increasing_id()), "near-signatures")

    # Equal texts are one node, that of the smallest id.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    first = signed.filter("shingles > 0").groupBy("d1", "d2").agg(F.min(order)["node"].alias("rep"))
    members = staged(signed.select("node", "doc_id", "d1", "d2").join(first, ["d1", "d2"], "left").withColumn(
        "rep", F.coalesce("rep", "node")), "near-members")
    nodes = members.filter("node = rep").drop("rep")

    keyed = signed.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    open_rows = staged(keyed.join(crowds, "key"), "near-buckets")
    # Texts of nodes in open buckets, narrowed as buckets close: the table of all
    # documents is joined once.
    texts = node_texts(open_rows.select("node").distinct(), nodes, docs)
    sims, labels = None, None
    for turn in range(TURNS):
        chosen = F.min_by("node", F.xxhash64(F.lit(turn), "key", "node"))
        pivots = open_rows.groupBy("key").agg(chosen.alias("pivot"))
        told = open_rows.join(pivots, "key").filter("node <> pivot")
        if labels is not None:
            told = told.join(open_rows.select("key", F.col("node").alias("pivot"), F.col("label").alias("top")),
                             ["key", "pivot"]).filter("label <> top")
        pairs = told.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        pairs = staged(pairs if sims is None else pairs.join(sims, ["a", "b"], "left_anti"), "near-pairs")
        found = verify(pairs, texts)
        linked = found.filter(F.col("sim") >= threshold).select("a", "b")
        sims = found if sims is None else sims.unionByName(found)
        labels = components(linked if labels is None else linked.unionByName(spanning(labels)))
        if turn == 0:  # for the triangle inequality, similarities to this pivot
            to_pivot = told.select("key", "node", "pivot", F.least("pivot", "node").alias("a"), F.greatest(
                "pivot", "node").alias("b")).join(found, ["a", "b"]).select("key", "node", "sim")
            open_rows = open_rows.join(to_pivot, ["key", "node"], "left").fillna(1.0, ["sim"])
        named = staged(open_rows.drop("label").join(labels, "node", "left").withColumn(
            "label", F.coalesce("label", "node")), "near-labelled")
        several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(
            "lo <> hi").select("key")
        open_rows = staged(named.join(several, "key"), "near-open")
        texts = staged(texts.join(open_rows.select("node").distinct(), "node", "left_semi"), "near-texts")
        # Pairs across the classes of a bucket, against one comparison a node.
        sizes = open_rows.groupBy("key", "label").agg(F.count("*").alias("n"))
        across = sizes.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
                                          F.sum("n").alias("rows")).agg(F.sum("pairs"), F.sum("rows")).first()
        if (across[0] or 0) <= FEW_PAIRS * (across[1] or 0):
            break

    counted = staged(texts.mapInArrow(_cells, "node long, coarse array<smallint>, fine array<smallint>").join(
        signed.select("node", "shingles"), "node"), "near-cells")
    open_rows = open_rows.join(counted, "node")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    needed = threshold / (1 + threshold) * (F.col("x.shingles") + F.col("y.shingles")) - 1e-6
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label"))
                    & (F.abs(F.col("x.sim") - F.col("y.sim")) <= 1 - threshold + 1e-9)
                    & (F.least("x.shingles", "y.shingles") >= needed)
                    & F.coalesce(_overlap("x.coarse", "y.coarse") >= needed, F.lit(True))
                    & F.coalesce(_overlap("x.fine", "y.fine") >= needed, F.lit(True)))
    across = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = staged(across.join(sims, ["a", "b"], "left_anti"), "near-pairs")
    if not more.isEmpty():
        extra = verify(more, texts).filter(F.col("sim") >= threshold).select("a", "b")
        if not extra.isEmpty():
            labels = components(extra.unionByName(spanning(labels)))

    classed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep"))
    groups = staged(classed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
                                                 F.min(order)["node"].alias("stays")), "near-classes")
    return classed.join(groups, "label").select(
        "doc_id", "class_id", "class_size", (F.col("node") == F.col("stays")).alias("kept"), "d1", "d2")


def near_dedup_filter(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns."""
    def key(i, a, b):
        return F.concat_ws("|", i.isNull().cast("string"), i.cast("string"), a, b)

    d1, d2 = _digests()
    own = own_names(docs)
    name, rows, number = own("key"), own("rows"), own("number")
    # Wordless rows are classes of their own: each stays, however often repeated.
    stays = near_duplicates(docs, threshold).filter("kept").select(
        key(F.col("doc_id"), F.col("d1"), F.col("d2")).alias(name))
    stays = stays.groupBy(name).agg(F.count("*").alias(rows))
    numbered = docs.withColumn(name, key(F.col("doc_id"), d1, d2)).withColumn(
        number, F.row_number().over(Window.partitionBy(name).orderBy(name)))
    return numbered.join(stays, name).filter(F.col(number) <= F.col(rows)).select(*map(column_of, docs.columns))
