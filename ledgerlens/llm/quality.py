"""Quality rules as weak supervision.

Rules look at a whole text and vote good, vote bad or abstain.  The votes of a
document are one of at most ``3 ** len(RULES)`` patterns; expectation
maximisation over the counts of the patterns (equal to that over all documents)
estimates how often each rule is right on good and on bad documents, without
labels.  A document is kept if the posterior probability that it is good
reaches ``KEEP_AT``; no rule alone decides.

Base rules of the contract stand beside this: too few words, or half of the
words in repeated three-word windows, drop a document whatever the posterior.

Defined cases: a null or empty text has no words and fails the base rules; rows
that repeat each other are scored each by itself; an empty table gives no rows;
extra columns pass through ``quality_filter`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, own_names, staged
from ledgerlens.llm.tokenize import small_batches

MIN_WORDS = 50
KEEP_AT = 0.5
ITERATIONS = 50
#: A rule votes good up to the first limit, bad from the second, and abstains
#: between them.  Measures are shares of words, of lines, or means.
RULES = {
    "symbols": (0.10, 0.30),  # characters of #*$%&|<> per word
    "repeats": (0.15, 0.35),  # words in three-word windows found before
    "dup_lines": (0.20, 0.50),  # lines equal to an earlier line
    "capitals": (0.30, 0.60),  # words of capitals only
    "exclaims": (0.10, 0.40),  # words that end in !! or ??
    "top_word": (0.20, 0.40),  # share of the most frequent word
    "tails": (0.10, 0.40),  # words that end in two characters or more that are no letters or digits
    "digits": (0.20, 0.50),  # words with a digit
    "odd_length": (0.15, 0.50),  # words of one character or over 25
}

_WORD = re.compile(WORD)
_TAIL = re.compile(r"\w[^\w]{2,}$")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def _features(text: str) -> tuple[list[int], list[float]]:
    """Base counts and rule measures of a text."""
    words = _WORD.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reach = 0  # words before this position are counted already
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    symbols = len(_SYMBOLS.findall(text))
    base = [n, sum(map(len, words)), symbols, dup_lines, repeated]
    share = 1.0 / n if n else 0.0
    distinct = Counter(words)
    odd = sum(c for w, c in distinct.items() if len(w) == 1 or len(w) > 25)
    return base, [
        symbols * share, repeated * share, dup_lines / len(lines) if lines else 0.0,
        sum(c for w, c in distinct.items() if len(w) > 1 and w.isupper()) * share,
        sum(c for w, c in distinct.items() if w.endswith(("!!", "??"))) * share,
        max(distinct.values(), default=0) * share if n >= 20 else 0.0,
        sum(c for w, c in distinct.items() if _TAIL.search(w)) * share,
        sum(c for w, c in distinct.items() if any(x.isdigit() for x in w)) * share, odd * share]


def vote(value: float, limits: tuple[float, float]) -> int:
    return 1 if value <= limits[0] else -1 if value >= limits[1] else 0


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def votes_of(docs: DataFrame, key: list[Column], rules: dict = RULES) -> DataFrame:
    """The ``key`` columns, the base counts and ``v0..`` (one vote per rule);
    a text without words abstains everywhere."""
    names = [f"_k{i}" for i in range(len(key))]
    limits = list(rules.values())

    def measure(batches):
        for batch in small_batches(batches, len(names)):
            rows = []
            for text in batch.column(len(names)).to_pylist():
                base, values = _features(text or "")
                rows.append(base + [vote(v, lim) if base[0] else 0 for v, lim in zip(values, limits, strict=True)])
            table = np.array(rows, dtype=np.int64).reshape(-1, len(BASE) + len(limits))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *(pa.array(table[:, i]) for i in range(table.shape[1]))],
                names=[*names, *BASE, *(f"v{i}" for i in range(len(limits)))])

    keyed = docs.select(*(k.alias(n) for k, n in zip(key, names, strict=True)), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1]),
                        *(f"{b} long" for b in BASE), *(f"v{i} long" for i in range(len(limits)))])
    return keyed.mapInArrow(measure, schema)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> dict:
    """Expectation maximisation over vote patterns (rows of -1, 0, 1).

    Returns the prior of good and, per rule, the probability of a right vote on
    good and on bad documents, given that it votes.  A rule may miss most bad
    documents (each knows one kind), but a bad vote stays likelier on bad
    documents than on good ones, so that the classes can't change places."""
    rules = patterns.shape[1]
    prior, right_good, right_bad = 0.9, np.full(rules, 0.99), np.full(rules, 0.35)
    good_vote, bad_vote = (patterns == 1).astype(float), (patterns == -1).astype(float)
    weight = counts.astype(float)
    for _ in range(iterations):
        log_odds = (math.log(prior / (1 - prior)) + good_vote @ np.log(right_good / (1 - right_bad))
                    + bad_vote @ np.log((1 - right_good) / right_bad))
        good = weight / (1 + np.exp(-np.clip(log_odds, -500, 500)))
        bad = weight - good
        # A hundred votes on good and ten on bad documents stand for what is
        # believed of rules beforehand.
        right_good = np.clip((good @ good_vote + 99) / (good @ (good_vote + bad_vote) + 100), 0.6, 0.999)
        right_bad = np.clip((bad @ bad_vote + 3.5) / (bad @ (good_vote + bad_vote) + 10), 0.01, 0.99)
        right_bad = np.maximum(right_bad, np.minimum(0.99, 5 * (1 - right_good)))
        prior = float(np.clip((good.sum() + 9) / (weight.sum() + 10), 0.05, 0.95))
    return {"prior": prior, "right_good": right_good, "right_bad": right_bad}


def posterior(model: dict) -> Column:
    """Probability of a good document, from ``v0..``."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for i, (g, b) in enumerate(zip(model["right_good"], model["right_bad"], strict=True)):
        odds = odds + F.when(F.col(f"v{i}") == 1, F.lit(math.log(g / (1 - b)))).when(
            F.col(f"v{i}") == -1, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def scored(docs: DataFrame, key: list[Column], rules: dict = RULES) -> DataFrame:
    """``_k0.., n_words, ..., posterior, base_failed, kept`` per row."""
    votes = staged(votes_of(docs, key, rules), "quality-votes")
    columns = [f"v{i}" for i in range(len(rules))]
    # At most 3 ** len(rules) rows, whatever the size of the input.
    found = votes.filter("n_words > 0").groupBy(*columns).agg(F.count("*").alias("n")).collect()
    patterns = np.array([[r[c] for c in columns] for r in found], dtype=np.int64).reshape(-1, len(columns))
    model = fit_accuracies(patterns, np.array([r["n"] for r in found], dtype=np.int64))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return votes.withColumn("posterior", posterior(model)).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))


def quality_rules(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``posterior`` and
    the votes, one row per input row."""
    out = scored(docs, [F.col("doc_id")], rules)
    return out.withColumnRenamed("_k0", "doc_id").withColumnsRenamed(
        {f"v{i}": f"vote_{name}" for i, name in enumerate(rules)})


def quality_filter(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.  Equal texts have
    equal verdicts, so the rejected digests decide, read once per digest."""
    digest = [F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text")]
    own = own_names(docs)
    a, b = own("a"), own("b")
    rejected = scored(docs, digest, rules).filter("NOT kept").select(
        F.col("_k0").alias(a), F.col("_k1").alias(b)).distinct()
    return docs.join(rejected, (digest[0] == F.col(a)) & (digest[1] == F.col(b)), "left_anti")


def rule_names() -> list[str]:
    return list(chain(RULES))
