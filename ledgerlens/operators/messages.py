"""Message classification and entity extraction.

Keyword rules are short parameter lists compiled into CASE / OR expressions
(codegen).  Product names, which may be many, are found by one automaton in an
Arrow-batched function.  The customer-name test needs a set that can hold millions
of names, so it is a join: each message's distinct whitespace tokens meet the
name-token table (broadcast only behind a size check), then a per-message
count of distinct matches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import contains_any
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded

MAX_BROADCAST_TOKENS = 1_000_000


def name_tokens(customers: DataFrame, extra=None) -> DataFrame:
    """Distinct lower-case first and last names (plus optional extra tokens)."""
    toks = (customers.select(F.lower("first_name").alias("token"))
            .unionByName(customers.select(F.lower("last_name").alias("token"))))
    if extra:
        toks = toks.unionByName(customers.sparkSession.createDataFrame([(t,) for t in extra], "token string"))
    return toks.where(F.col("token").isNotNull()).distinct()


def related(messages: DataFrame, keys, tokens: DataFrame, keywords=R.BANK_KEYWORDS,
            pattern: str = R.CUSTOMER_REF_PATTERN, min_names: int = R.MIN_NAME_TOKENS,
            text_col: str = "content") -> DataFrame:
    """Keyword substring, or the customer-reference pattern, or at least
    ``min_names`` distinct whitespace tokens that are customer names."""
    keys = list(keys)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = messages.select(*keys, low.alias("_t"))
    # Only keys and flags go through the joins, not the texts.
    flags = words.select(*keys, contains_any("_t", keywords).alias("by_keyword"), F.col("_t").rlike(pattern).alias("by_pattern"))
    toks = words.select(*keys, F.explode(F.array_distinct(F.split(F.trim("_t"), r"\s+"))).alias("token"))
    hits = (toks.join(broadcast_bounded(tokens, MAX_BROADCAST_TOKENS), "token")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("name_hits")))
    out = flags.join(hits, keys, "left").withColumn("by_names", F.coalesce("name_hits", F.lit(0)) >= min_names)
    return out.select(*keys, (F.col("by_keyword") | F.col("by_pattern") | F.col("by_names")).alias("related"),
                      "by_keyword", "by_pattern", "by_names")


def intent_expr(text_lower, rules=R.INTENT_RULES, default: str = R.DEFAULT_INTENT):
    """The first rule (by priority) with a keyword contained in the text."""
    expr = None
    for _, intent, kws in sorted(rules, key=lambda r: r[0]):
        cond = contains_any(text_lower, kws)
        expr = F.when(cond, intent) if expr is None else expr.when(cond, intent)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def intents(messages: DataFrame, keys, rules=R.INTENT_RULES, text_col: str = "content") -> DataFrame:
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return messages.select(*keys, intent_expr(low, rules).alias("intent"))


#: Names that a task's automaton holds (some 100 bytes each).
MAX_NAMES = 1_000_000


def name_mention(names: list[tuple[int, str]]):
    """T4: a column function: the id of the longest name contained in a lower-case
    text (ties: the smaller id), null if there is none.

    An Aho-Corasick automaton, built once per worker: a text is read once, however
    many names there are, prefixes of one another and names of several words
    included."""
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    best: dict[str, int] = {}
    for pid, name in sorted(names, reverse=True):
        if name:
            best[name] = pid
    built = []

    def longest(texts: pd.Series) -> pd.Series:
        import ahocorasick

        if not built:
            automaton = ahocorasick.Automaton()
            for name, pid in best.items():
                automaton.add_word(name, (len(name), -pid))
            automaton.make_automaton()
            built.append(automaton)
        found = [max((hit for _, hit in built[0].iter(t)), default=None) if t else None for t in texts]
        return pd.Series([None if f is None else -f[1] for f in found], dtype="Int32")

    return F.pandas_udf(longest, "int") if best else lambda text: F.lit(None).cast("int")


def lowered_names(catalogue) -> list[tuple[int, str]]:
    return [(p, name.lower()) for p, name, _ in catalogue if name]


def entities(messages: DataFrame, catalogue, key: str = "msg_id", text_col: str = "text",
             context_col: str = "context_customer_id", extra=()) -> DataFrame:
    """T3 + T4: customer id = first digit run of the message, else the context
    customer (0 or none -> ``id_missing``); product = the longest catalogue name
    contained in the message (a name may begin with another one), else the first
    number that is a catalogue id.

    ``catalogue`` is the size-checked list of (prod_id, name, category).
    """
    text = F.col(text_col)
    ref = F.regexp_extract(text, r"(\d+)", 1)
    cust = F.when(ref != "", ref.try_cast("bigint")).otherwise(F.col(context_col).cast("bigint"))
    by_name = name_mention(lowered_names(catalogue))(F.lower(text))
    ids = [p for p, _, _ in catalogue]
    nums = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    in_cat = F.filter(nums, lambda x: x.try_cast("bigint").isin(ids))
    by_num = F.get(in_cat, 0).try_cast("int")
    return messages.select(
        key, *extra, ref.alias("customer_ref"), cust.alias("customer_id"),
        F.when(cust.isNull() | (cust == 0), "id_missing").otherwise("ok").alias("status"),
        F.coalesce(by_name, by_num).cast("int").alias("prod_id"))


def answers(msgs: DataFrame, intent_rules, products: DataFrame, catalogue, recs: DataFrame, snapshot: DataFrame,
            best: DataFrame, key: str = "msg_id", text_col: str = "text",
            context_col: str = "context_customer_id") -> DataFrame:
    """T5: answer every message from batch results instead of one call each.

    ``recs`` and ``snapshot`` are (cust_id, payload), ``products`` (prod_id, payload):
    each is one equi-join on an extracted id.  ``best`` is one row (payload), the
    answer to the top-potential question."""
    # intent and entities come from one projection over the messages (one
    # scan of the texts, no self join on the message key)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    tagged = msgs.select(key, text_col, context_col, intent_expr(low, intent_rules).alias("intent"))
    m = entities(tagged, catalogue, key, text_col, context_col, extra=("intent",))
    r = recs.select(F.col("cust_id").alias("customer_id"), F.col("payload").alias("_rec"))
    s = snapshot.select(F.col("cust_id").alias("customer_id"), F.col("payload").alias("_snap"))
    p = broadcast_bounded(products.select("prod_id", F.col("payload").alias("_prod")), MAX_NAMES)
    m = m.join(r, "customer_id", "left").join(s, "customer_id", "left").join(p, "prod_id", "left")
    listing = ", ".join(n for _, n, _ in sorted(catalogue) if n is not None)
    intent = F.col("intent")
    missing_id = F.col("status") == "id_missing"
    status = (F.when(intent.isin("recommend", "snapshot") & missing_id, "id_missing")
               .when((intent == "recommend") & F.col("_rec").isNull(), "no_result")
               .when((intent == "snapshot") & F.col("_snap").isNull(), "no_result")
               .when((intent == "explain") & F.col("prod_id").isNull(), "product_missing")
               .otherwise("ok"))
    payload = (F.when(intent == "recommend", F.col("_rec"))
                .when(intent == "snapshot", F.col("_snap"))
                .when(intent == "explain", F.col("_prod"))
                .when(intent == "list", F.lit(listing))
                .when(intent == "top_potential", best.scalar()))
    return m.select(key, "intent", status.alias("status"),
                    F.when(status == "ok", payload).alias("payload"))
