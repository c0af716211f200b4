"""The training-data operators against brute-force versions, on the smallest
documents table and on a hand-made table of odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import minhash, packing, quality, token_file
from ledgerlens.llm.components import components
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.language_id import held_out, language_id
from ledgerlens.llm.licenses import TEMPLATES, license_scan
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.mixing import mix_documents, mixed_texts
from ledgerlens.llm.sharding import hilbert_cells, shard_documents, write_shards
from ledgerlens.llm.tokenize import UnitEncoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
SENTENCES = [f"the {a} of {b} went to {c} and back again" for a in "abcdef" for b in "ghij" for c in "klm"]
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "Same text here.", "en", "b"),
    (5, "same TEXT here.", "en", "b"), (6, "Same text here.", "de", None), (6, "Same text here.", "de", None),
    (None, "Same text here.", "en", "a"), (None, None, None, None), (7, LONG, "en", "a"), (8, LONG + " x", "en", "a"),
    (9, "\n".join(SENTENCES), "en", "b"), (10, "\n".join(["new line", *SENTENCES[3:20], "other"]), "en", "b"),
    (11, "ÉÀ été  a \n b ć  d", "fr", "ü"), (12, "one two", "en", "b"), (13, "one\ttwo", "en", "b"),
    (14, "Released under the MIT License.", "en", "c"), (14, "different text, same id", "en", "c"),
    (15, "word " * 400, "en", "z"), (16, "### *** $$$ " * 60, "en", "z"), (17, "\n\n\n\n", "en", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    # Names that operators use themselves, and a column nobody knows.
    return frame.withColumns({"size": F.lit("x"), "kept": F.lit(1), "shard": F.lit(2), "line": F.lit(3),
                              "node": F.lit(4), "key": F.lit("k"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def small(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(params=["docs", "odd", "none"])
def table(request, docs, odd, small):
    return {"docs": (docs, small), "odd": (odd, ODD), "none": (odd.limit(0), [])}[request.param]


def collected(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- tokenisation, packing, token files ----------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_cache_gives_the_tokenizers_ids(name, small):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t or "" for _, t, _, _ in [*small, *ODD]] + [
        "a  b   c \n d\n\n e", " lead", "trail ", "<|endoftext|> x <|endoftext|>", "it's I'LL we 've", "x ́y ﬁ İ ΑΣ ΑΣ. \x1c q",
        "1234 56,78 --- ...!", "​ ﻿ z", "日本語 テキスト です"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    cached = UnitEncoder(path)
    assert cached.encode_batch(texts) == expected
    assert cached.encode_batch(texts) == expected  # from the cache


def test_packing(table):
    frame, rows = table
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = packing.pack_documents(frame, path, with_ids=True, partition_pieces=60).cache()
    pieces = defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"], r["piece"]].append(r)
    streams = [[*e.ids, 0] for e in plain.encode_batch([t or "" for _, t, _, _ in rows], add_special_tokens=False)]
    want = Counter()
    for (doc_id, *_), ids in zip(rows, streams):
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(collected(got, "doc_id", "piece", "start", "length", "ids_crc32")) == want
    bins = defaultdict(list)
    for r in got.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    for key, parts in bins.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        assert np.array(built[key], "<u4").tobytes() == b"".join(ids for _, _, ids in sorted(parts))
    lengths = np.array([k[3] for k in want.elements()], dtype=np.int64)
    if len(lengths):
        # The exchange brings small partitions close to the bound of the whole.
        assert len(bins) <= packing.lower_bound(lengths, 2048) * 1.02 + 2


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(3)
    for capacity, sizes in ((10, [6, 6, 6, 4, 4]), (10, [5, 5, 5]), (100, [51] * 7), (100, [34] * 7), (9, [9, 9])):
        bins, _, free = packing.best_fit_decreasing(np.array(sizes), capacity)
        assert len(free) == packing.lower_bound(np.array(sizes), capacity) == len(set(bins))
    for _ in range(200):  # never above an optimal packing of a known number of full bins
        capacity, sizes, full = 50, [], int(rng.integers(1, 12))
        for _ in range(full):
            cuts = np.unique(rng.integers(1, capacity, int(rng.integers(0, 5))))
            sizes += list(np.diff([0, *cuts, capacity]))
        sizes = np.array(sizes)
        bins, offsets, free = packing.best_fit_decreasing(sizes, capacity)
        assert packing.lower_bound(sizes, capacity) == full <= len(free)
        assert all(capacity - sizes[bins == b].sum() == f for b, f in enumerate(free))


def test_exchange_lowers_the_number_of_sequences(spark):
    lengths = [700] * 40 + [1300] * 40 + [300] * 50
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_id long, length long")
    one = packing.pack_pieces(pieces, rounds=1, partition_pieces=6).select("sequence_id").distinct().count()
    more = packing.pack_pieces(pieces, rounds=5, partition_pieces=6).select("sequence_id").distinct().count()
    assert more <= one and more <= packing.lower_bound(np.array(lengths), 2048) * 1.1 + 2


@pytest.mark.parametrize("kind", [token_file.BYTE_PLANES, token_file.BIT_PLANES])
def test_chunk_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000, 65536):
        for top in (1, 2, 49408, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (token_file.decode_chunk(token_file.encode_chunk(ids, kind)) == ids).all()
    with pytest.raises(ValueError):
        token_file.decode_chunk(b"XXXX" + token_file.encode_chunk(np.array([1], "<u4"))[4:])


def test_token_file(spark, table, tmp_path):
    frame, rows = table
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    token_file.write_token_file(frame, str(tmp_path / "t"), path, chunk_ids=700, kind=token_file.BIT_PLANES)
    got = sorted(collected(token_file.read_token_file(spark, str(tmp_path / "t")), "start", "doc_id", "n_tokens", "ids_crc32", "ids"))
    streams = [[*e.ids, 2] for e in plain.encode_batch([t or "" for _, t, _, _ in rows], add_special_tokens=False)]
    assert Counter((i, bytes(b)) for _, i, _, _, b in got) == Counter(
        (r[0], np.array(ids, "<u4").tobytes()) for r, ids in zip(rows, streams))
    at = 0
    for start, _, n, crc, ids in got:
        assert start == at and 4 * n == len(ids) and crc == zlib.crc32(ids)
        at += n
    assert [g[1] or -1 for g in got] == sorted(g[1] or -1 for g in got)
    assert token_file.chunk_index(spark, str(tmp_path / "t")).agg(F.sum("n_ids")).first()[0] == (at or None)


# ---- quality -------------------------------------------------------------------------------


def brute_base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_base_counts(table):
    frame, rows = table
    got = Counter(collected(quality.quality_rules(frame), "doc_id", *quality.BASE, "base_failed"))
    want = Counter()
    for i, text, *_ in rows:
        base = brute_base(text)
        want[i, *base, base[0] < 50 or 100 * base[4] > 50 * base[0]] += 1
    assert got == want


def test_quality_verdicts(spark, docs, small):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fair = [i for i in labels if not got[i]["base_failed"]]
    good = [i for i in fair if labels[i] == 1]
    assert sum(got[i]["kept"] for i in good) >= 0.99 * len(good)
    bad = [i for i in labels if labels[i] == 0]
    assert sum(not got[i]["kept"] for i in bad) >= 0.7 * len(bad)
    kept = {i for i, r in got.items() if r["kept"]}
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(60000) < 0.7
    good, bad = np.array([0.98, 0.95, 0.9, 0.97]), np.array([0.9, 0.7, 0.8, 0.4])
    right = rng.random((60000, 4)) < np.where(truth[:, None], good, bad)
    votes = np.where(right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_accuracies(patterns, counts, 200)
    assert abs(model["prior"] - 0.7) < 0.03
    assert np.abs(model["right_good"] - good).max() < 0.03 and np.abs(model["right_bad"] - bad).max() < 0.05


# ---- lines, near and exact duplicates ------------------------------------------------------


def brute_lines(rows):
    """Text left per (doc_id, text): rows that share both are one document."""
    distinct = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    where = defaultdict(list)
    for d in distinct:
        lines = d[1].split("\n")
        for p in range(len(lines) - 2):
            if any(x.strip(" ") for x in lines[p : p + 3]):
                where[tuple(lines[p : p + 3])].append((d, p))
    covered = defaultdict(set)
    for places in where.values():
        for d, p in places[1:]:
            covered[d] |= {p, p + 1, p + 2}
    return {d: "\n".join(x for p, x in enumerate(d[1].split("\n")) if p not in covered[d]) for d in distinct}


def test_line_dedup(table):
    frame, rows = table
    got = line_dedup(frame)
    assert got.columns == [*frame.columns, "_ll_lines", "_ll_removed"]
    left = brute_lines(rows)
    assert Counter(collected(got, "doc_id", "text")) == Counter((r[0], left.get((r[0], r[1]))) for r in rows)


def test_line_dedup_overlapping_runs(spark):
    lines = [str(i % 4) for i in range(23)]
    rows = [(1, "\n".join(lines), None, None), (2, "\n".join(["x", *lines[2:9], "y", "z", *lines[:3]]), None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    left = brute_lines(rows)
    assert dict(collected(line_dedup(frame), "doc_id", "text")) == {d[0]: t for d, t in left.items()}


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    bags, of = [bag(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= threshold * sum((bags[i] | bags[j]).values()):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def near_rows():
    rng = np.random.default_rng(5)
    rows = []
    for family in range(6):
        base = [f"f{family}w{x}" for x in rng.integers(0, 400, 300)]
        for _ in range(12):
            copy = list(base)
            for at in rng.choice(300, int(rng.integers(0, 9)), replace=False):
                copy[at] = f"new{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(copy), "en", "s"))
        rows.append((len(rows), rows[-1][1], "en", "s"))
    return rows


def test_near_duplicates(spark, table):
    frame, rows = table
    check_classes(frame, rows)


def test_near_duplicate_families(spark):
    check_classes(spark.createDataFrame(near_rows(), "doc_id long, text string, lang string, source string"), near_rows())


def test_near_duplicate_wide_families(spark):
    """Families whose members share buckets without being links keep their classes."""
    rng = np.random.default_rng(11)
    rows = near_rows()
    for family in range(3):
        base = [f"g{family}w{x}" for x in rng.integers(0, 400, 300)]
        for _ in range(40):
            copy = list(base)
            for at in rng.choice(300, int(rng.integers(0, 26)), replace=False):
                copy[at] = f"v{rng.integers(0, 30)}"
            rows.append((len(rows), " ".join(copy), "en", "s"))
    check_classes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows)


def test_cell_counts_bound_the_overlap():
    texts = [r[1] for r in near_rows()] + ["a b c", "x " * 40_000, "x " * 90 + "y"]
    for cells in minhash.CELLS:
        counts = minhash.cell_counts(texts, cells)
        for i, j in [(0, 5), (0, 40), (3, 80), (-1, -2), (-3, 0)]:
            true = sum((bag(texts[i]) & bag(texts[j])).values())
            assert true <= np.minimum(counts[i], counts[j]).sum() <= sum(bag(texts[i]).values())
    nodes = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts[-3:])], names=["node", "text"])
    out = next(minhash._cells([nodes]))
    # 39,996 equal shingles do not fit two bytes: no counts, so no bound
    assert [x is None for x in out.column(1).to_pylist()] == [False, True, False]
    assert [sum(x) for x in out.column(2).to_pylist() if x] == [1, 87]


@pytest.mark.parametrize("edges", [
    [], [(3, 3), (5, 4)], [(i, i + 1) for i in range(20)], [(i, 99) for i in range(12)],
    [(9, 1), (9, 2), (8, 2), (8, 3), (20, 21), (21, 20), (22, 21), (30, 8)]])
def test_components(spark, edges):
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["label"]) for r in got) == sorted(label.items())


def check_classes(frame, rows):
    got = minhash.near_duplicates(frame).collect()
    members = defaultdict(list)
    for r, c in zip(rows, brute_classes(rows)):
        members[c].append(r[0])
    want = Counter((min((i for i in m if i is not None), default=None), len(m), tuple(sorted(m, key=str))) for m in members.values())
    # Classes of one id set that differ (equal ids, other texts) are told apart by size.
    found = Counter((r["class_id"], r["class_size"]) for r in got if r["kept"])
    assert found == Counter((w[0], w[1]) for w in want.elements())
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == Counter(
        (i, w[0], w[1]) for w in want.elements() for i in w[2])
    out = minhash.near_dedup_filter(frame)
    assert out.columns == frame.columns
    assert out.count() == len(members)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_word_hashes_follow_words_only():
    texts = ["a b  c", "a\tb\nc", "c b a", "", "é" * 3 + " a", None]
    owner, value = minhash.word_hashes(texts)
    by = [list(value[owner == i]) for i in range(len(texts))]
    assert by[0] == by[1] and by[2] == by[0][::-1] and by[3] == by[5] == [] and by[4][1] == by[0][0]
    old, minhash._BYTES = minhash._BYTES, 16  # blocks: cut at separators, longer words whole
    try:
        again = minhash.word_hashes([*texts, LONG[:500], "q" * 50 + " r"])[1]
    finally:
        minhash._BYTES = old
    assert (again == minhash.word_hashes([*texts, LONG[:500], "q" * 50 + " r"])[1]).all()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = [f"w{x}" for x in rng.integers(0, 40, 400)]
    b = a[:300] + [f"v{x}" for x in rng.integers(0, 40, 100)]
    heavy = "x y z u v " * 90  # a few shingles with large counts
    light = "x y z u v " * 50
    for s, t in ((" ".join(a), " ".join(b)), (heavy, light), (heavy, heavy + "q r s t")):
        true = sum((bag(s) & bag(t)).values()) / sum((bag(s) | bag(t)).values())
        both = minhash.signatures([s, "", "one", t], 4000)[1]
        assert np.isinf(both[1]).all() and not np.isinf(both[[0, 2, 3]]).any()
        assert abs((both[0] == both[3]).mean() - true) < 0.035
        exact = minhash.bags([s, t])
        cut = np.searchsorted(exact[0], 1)
        assert minhash.similarity((exact[1][:cut], exact[2][:cut]), (exact[1][cut:], exact[2][cut:])) == pytest.approx(true, abs=1e-12)
    alone = minhash.signatures([heavy], 192)[1]
    assert (alone == minhash.signatures([" ".join(a), heavy, "x"], 192)[1][1]).all()


def test_exact_dedup(table):
    frame, rows = table
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want, keepers = Counter(), Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        keepers[keep] += 1
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_dedup(frame, digest_all=True)
    assert Counter(collected(got, "doc_id", "keep_id", "group_size", "text_sha256")) == want
    assert Counter(r["doc_id"] for r in got.filter("kept").collect()) == keepers
    lazy = exact_dedup(frame)
    assert Counter(collected(lazy, "doc_id", "keep_id", "group_size", "kept")) == Counter(
        collected(got, "doc_id", "keep_id", "group_size", "kept"))


# ---- language, licenses --------------------------------------------------------------------


def test_language_id(spark, table):
    frame, rows = table
    got = language_id(frame, train_docs=100).collect()
    assert len(got) == len(rows)
    langs = {r[2] for r in rows if r[2] and r[1] is not None}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in langs | {"und"}
    blank = Counter(r[0] for r in rows if not re.search(r"[^\W\d_]", r[1] or ""))
    assert Counter(r["doc_id"] for r in got if r["lang_pred"] == "und") == blank


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = docs.select(F.col("doc_id").alias("i"), "lang")
    rows = language_id(docs).filter("held_out").join(true, F.col("doc_id") == F.col("i")).collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_language_without_training_rows(spark):
    frame = spark.createDataFrame([(i, "some text", None) for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id(frame).collect()} == {("und", 0.0)}


def brute_shingles(text):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_license_scan(spark, table):
    frame, rows = table
    rng = np.random.default_rng(4)
    extra = []
    for k, (_, text) in enumerate(TEMPLATES):
        w = text.split()
        if len(w) > 30:
            w[int(rng.integers(5, len(w) - 5))] = "changed"
        filler = [f"z{x}" for x in rng.integers(0, 10**6, 200)]
        extra.append((100 + k, " ".join([*filler[:k], *w, *filler[k:]]), "en", "s"))
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")
    for f, r in ((frame, rows), (more, extra)):
        got = Counter(collected(license_scan(f), "doc_id", "template", "shared", "template_shingles"))
        want = Counter()
        for i, text, *_ in r:
            have = brute_shingles(text)
            for t, (_, template) in enumerate(TEMPLATES):
                own = brute_shingles(template)
                if len(own & have) >= 0.8 * len(own):
                    want[i, t, len(own & have), len(own)] += 1
        assert got == want
    assert len(want) >= len(TEMPLATES)


# ---- mixing, sharding ----------------------------------------------------------------------


def brute_targets(rows):
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, total = set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in capped)
        heavy = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / heavy for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            return size, target
        capped |= over


def test_mixing(table):
    frame, rows = table
    size, target = brute_targets(rows)
    got = collected(mix_documents(frame), "doc_id", "source", "size", "source_size", "target", "taken")
    assert Counter(g[:3] for g in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    taken = Counter()
    for _, source, n, total, goal, took in got:
        assert total == size[source] and goal == pytest.approx(target[source], abs=1e-6)
        assert 0 <= took <= 3 * n
        taken[source] += took
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 0.5 + 1e-6
    assert Counter(collected(mix_documents(frame), "doc_id", "source", "size", "taken")) == Counter(
        (g[0], g[1], g[2], g[5]) for g in got)


def test_mixed_texts_hold_the_words_taken(table):
    frame, rows = table
    out = mixed_texts(frame)
    assert out.columns == frame.columns
    had, got = Counter(), Counter()
    for i, source, n, _, _, took in collected(mix_documents(frame), "doc_id", "source", "size", "source_size", "target", "taken"):
        had[i, source] += took
    texts = defaultdict(set)
    for r in rows:
        texts[r[0], r[3]].add(tuple(words(r[1])))
    for i, source, text in collected(out, "doc_id", "source", "text"):
        w = tuple(words(text))
        assert any(whole[: len(w)] == w for whole in texts[i, source])
        got[i, source] += len(w)
    assert +had == +got


def test_hilbert_curve_is_one_path(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        cells = sorted((r["curve"], tuple(r[f"q{i}"] for i in range(dims))) for r in hilbert_cells(spark, dims, bits).collect())
        assert [c for c, _ in cells] == list(range(1 << (dims * bits)))
        assert len({p for _, p in cells}) == len(cells)
        assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def test_sharding(spark, table, tmp_path):
    frame, rows = table
    got = shard_documents(frame).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(40)]
    assert set(slots) <= set(range(40)) and (not rows or max(counts) - min(counts) <= 1)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(rows) >= 200:
        # Files of a shard cover few sources: pruning on a source skips most.
        by = defaultdict(set)
        source = {r[0]: r[3] for r in rows}
        for r in got:
            by[source[r["doc_id"]]].add(r["shard"])
        assert np.mean([len(v) for v in by.values()]) < 20
        write_shards(frame, str(tmp_path / "s"), files_per_shard=2)
        assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
