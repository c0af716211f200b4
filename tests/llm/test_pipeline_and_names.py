"""The pipeline's stages against brute force, and columns that clash with names of ours."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import quality, sharding
from ledgerlens.llm.licenses import TEMPLATES, license_scan, telling_words
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.minhash import near_dedup_filter
from ledgerlens.llm.mixing import mixed_texts
from test_llm_operators import bag, brute_base, brute_classes, brute_lines, brute_shingles, brute_targets, words

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

CLASHES = ["_ll_a", "_ll_b", "_ll_key", "_LL_KEY_", "_ll_number", "_ll_rows", "_ll_id", "_ll_hash", "_ll_size", "_ll_time", "_ll_copy",
           "_ll_lines", "_ll_removed", "shard", "slot", "odd `name`", "a.b"]


def planted():
    """Good prose, junk, copies, near copies, repeated windows, nulls."""
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}{c}" for a in ("re", "to", "an", "is", "er") for b in ("man", "ter", "ing", "low") for c in ("a", "e", "s", "d")]

    def prose(lines):
        return "\n".join(" ".join(rng.choice(vocabulary, int(rng.integers(9, 14)))).capitalize() + "." for _ in range(lines))

    texts = [prose(int(rng.integers(7, 12))) for _ in range(60)]
    shared = prose(4)
    texts += [f"{prose(4)}\n{shared}\n{prose(4)}" for _ in range(4)]       # a passage of several documents
    texts += [texts[k] for k in (3, 3, 5)]                                  # copies
    texts += [texts[k].replace(texts[k].split()[20], "changed", 1) for k in (7, 8)]
    texts += ["### $$$ " * 60, "word " * 300, "short text", "", None, "\n\n", "a b c"]
    return [(k, t, "en", f"s{k % 3}" if k % 7 else None) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s0"), (10, texts[10], "en", "s1")]


@pytest.fixture(scope="module")
def table(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("n_chars", F.length("text").cast("int"))
    extra = F.concat(F.lit("own:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return frame.select("*", *(extra.alias(c) for c in CLASHES)), rows


def untouched(frame):
    """The clashing columns still belong to their rows."""
    for r in frame.collect():
        want = f"own:{'none' if r['doc_id'] is None else r['doc_id']}"
        assert all(r[c] == want for c in CLASHES)


def plain(frame):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect())


def test_stages_against_brute_force(spark, table, tmp_path):
    docs, rows = table
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mix", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        out = stages[name](spark, frame, "unused")
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            untouched(back)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in back.collect())
        return back

    # Quality: the verdict of the rules on every text, and the base rules by count.
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.quality_rules(docs).collect()}
    kept = step("quality_rules", docs)
    want = Counter(r for r in rows if verdict[r[0], len(words(r[1]))])
    assert plain(kept) == want
    base = [(r, brute_base(r[1])) for r in rows]
    assert not [r for r, b in base if (b[0] < 50 or 100 * b[4] > 50 * b[0]) and want[r]]
    assert sum(want.values()) >= 65

    # Lines: later windows cut; a document of which nothing is left goes.
    cut = step("line_dedup", kept)
    left = brute_lines(list(want.elements()))
    expected = Counter()
    for r in want.elements():
        text = left[r[0], r[1]]
        if text != "" or r[1] == "":
            expected[(r[0], text, *r[2:])] += 1
    assert plain(cut) == expected
    assert any(left[r[0], r[1]] != r[1] for r in want)

    # Near duplicates: the smallest id of each class stays.
    near = step("minhash_near_dedup", cut)
    listed = list(expected.elements())
    classes = defaultdict(list)
    for r, c in zip(listed, brute_classes(listed), strict=True):
        classes[c].append(r)
    stays = Counter(min(group, key=lambda r: (r[0] is None, r[0] or 0))[0] for group in classes.values() if bag(group[0][1]))
    assert Counter(r["doc_id"] for r in near.collect()) == stays
    assert plain(near) <= expected and sum(stays.values()) < len(listed)

    # Mix: each source near its target, texts whole but for one cut each.
    mixed = step("source_mix", near)
    before = list(plain(near).elements())
    _, target = brute_targets(before)
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    assert all(abs(taken[s] - goal) <= 0.5 + 1e-6 for s, goal in target.items())
    whole = {(r[0], r[1]) for r in before}
    cuts = [r for r in mixed.collect() if (r["doc_id"], r["text"]) not in whole]
    assert len(cuts) <= len(target) and all(any(w[0] == r["doc_id"] and w[1].startswith(r["text"].strip()) for w in whole) for r in cuts)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3

    # Packing: every token of every row once, no sequence over its size.
    packed = step("best_fit_packing", mixed).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed.collect())
    pieces, bins = defaultdict(int), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = Counter()
    for (doc, n), k in lengths.items():
        total[doc] += n * k
    assert pieces == total
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048

    # The whole pipeline gives the same documents.
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    ran = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, ran)) == Counter(map(key, packed))


def test_pipeline_on_an_empty_table(spark, table, tmp_path):
    table[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_keep_their_values(spark, table):
    docs, _ = table
    for out in (quality.quality_filter(docs), near_dedup_filter(docs), mixed_texts(docs),
                line_dedup(docs, lines="n1", removed="n2").drop("n1", "n2")):
        assert out.columns == docs.columns
        untouched(out)


def test_null_id_is_not_the_id_dash(spark):
    frame = spark.createDataFrame([(None, "one two three", "s"), ("-", "one two three", "s")], "doc_id string, text string, source string")
    assert near_dedup_filter(frame).count() == 1
    assert sorted(map(str, [r["doc_id"] for r in mixed_texts(frame).collect()])) == ["-", "None"]


def test_shards_rank_whole_names_and_keep_columns(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"common_crawl_{2000 + i % 20}", i) for i in range(4000)] + [(7, "text 7", "en", None, -1)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    by = defaultdict(set)
    source = {r[0]: r[3] for r in rows}
    for r in sharding.shard_documents(frame).collect():
        by[source[r["doc_id"]]].add(r["shard"])
    assert np.mean([len(v) for s, v in by.items() if s]) <= 8
    folder = sharding.write_shards(frame, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert folder != "shard" and Counter(map(tuple, back.select(*frame.columns).collect())) == Counter(rows)
    counts = [r["count"] for r in back.groupBy(folder).count().collect()]
    assert len(counts) == 40 and max(counts) - min(counts) <= 1


def test_best_license_matches_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = []
    for k, (_, template) in enumerate(TEMPLATES):
        w = template.split()
        other = TEMPLATES[int(rng.integers(len(TEMPLATES)))][1]
        if len(w) > 30:
            w[int(rng.integers(5, len(w) - 5))] = "changed"
        texts += [" ".join([f"z{k}", *w]), f"{template} zz {other}", " ".join(w[: int(0.85 * len(w))])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [brute_shingles(t) for _, t in TEMPLATES]
    want = set()
    for i, text in enumerate(texts):
        have = brute_shingles(text)
        hits = [(t, s & have, len(s & have) / len(s)) for t, s in enumerate(own) if len(s & have) >= 0.8 * len(s)]
        want |= {(i, t) for t, both, c in hits if not any((c2, len(both2)) > (c, len(both)) and both <= both2 for _, both2, c2 in hits)}
    got = {(r["doc_id"], r["template"]) for r in license_scan(frame, best=True).collect()}
    assert got == want and len(want) > len(TEMPLATES)


def test_telling_words_lose_no_match():
    rng = np.random.default_rng(3)
    for _ in range(200):
        templates = [[f"w{x}" for x in rng.integers(0, 12, int(rng.integers(5, 40)))] for _ in range(3)]
        telling = set(telling_words(templates, 0.8))
        for words_ in templates:
            shingles = {tuple(words_[i : i + 5]) for i in range(len(words_) - 4)}
            silent = {s for s in shingles if not telling & set(s)}
            assert len(silent) < 0.8 * len(shingles)
