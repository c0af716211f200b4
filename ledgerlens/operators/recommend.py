"""Recommendations: top-k (W1), scenario quotas (W2), reasons (P10),
expected profit (A18), bundle offers (A19).

Every window here is partitioned by customer (plus scenario / request), so a
window group holds at most |catalogue| rows whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import clamp01, income_level, when_chain
from ledgerlens.functions.ordering import global_rank
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded

MAX_CATALOGUE = 10_000


def catalogue(products: DataFrame, max_rows: int = MAX_CATALOGUE) -> DataFrame:
    """Product attributes used by recommendations, broadcast behind a size check."""
    return broadcast_bounded(products.select("prod_id", "name", "category", "price"), max_rows)


def recommend_topk(scored: DataFrame, k: int = 3, by=("cust_id",)) -> DataFrame:
    """``rank`` 1..k per customer by score desc, ties in catalogue (prod_id) order.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which drops rows
    beyond k before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("prod_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_reason(recs: DataFrame, customers: DataFrame | None, templates: DataFrame,
                scenario_col: str | None = None) -> DataFrame:
    """P10: reason text from the product's template, the income level and age bucket.

    ``recs`` needs cust_id, prod_id, name, score and (optionally) role; the
    customer attributes come from a join on cust_id, or - with ``customers``
    None - from ``_revenue`` / ``_age`` columns already on the rows (carried
    from the customer's own row, no join).
    """
    if customers is not None:
        cust = customers.select("cust_id", F.col("revenue").alias("_revenue"),
                                F.col("age_bucket").alias("_age"))
        recs = recs.join(cust, "cust_id", "left")
    out = recs.join(templates, "prod_id", "left")
    pct = F.format_string("%d%%", F.round(F.col("score") * 100).cast("int"))
    default = F.replace(F.replace(F.lit(R.REASON_DEFAULT), F.lit("{name}"), F.col("name")),
                        F.lit("{score}"), pct)
    filled = F.replace(F.replace(F.col("template"), F.lit("{income}"), income_level("_revenue")),
                       F.lit("{age}"), F.coalesce(F.col("_age"), F.lit("")))
    reason = F.coalesce(filled, default)
    if scenario_col is not None and "role" in recs.columns:
        pre, post = R.CROSS_SELL_DECORATION
        decorate = (F.col("role") == "cross_sell") & (F.col(scenario_col) != R.HOLISTIC)
        reason = F.when(decorate, F.concat(F.lit(pre), reason, F.lit(post))).otherwise(reason)
    return out.withColumn("reason", reason).drop("_revenue", "_age", "template")


def scenario_role_rows(scenarios, product_ids=R.PRODUCT_IDS) -> list[tuple[str, int, str]]:
    """(scenario, prod_id, role) for the requested scenarios; unknown names get
    the holistic role lists (all primary) but keep non-holistic scoring."""
    rows = []
    for s in scenarios:
        primary, cross = R.SCENARIOS.get(s, R.SCENARIOS[R.HOLISTIC])
        for p in product_ids:
            rows.append((s, p, "primary" if p in primary else "cross_sell" if p in cross else "other"))
    return rows


def bonus_flags(need=None, ltv=None):
    """(first-home bonus applies, investor bonus applies) for need / ltv columns.

    Missing ltv counts as 80 and missing need as 0, so with neither given the
    first-home bonus always applies.
    """
    b = R.MORTGAGE_BONUS
    need = F.coalesce(need, F.lit(R.DEFAULT_FINANCING_NEED)) if need is not None else F.lit(R.DEFAULT_FINANCING_NEED)
    ltv = F.coalesce(ltv, F.lit(R.DEFAULT_LTV)) if ltv is not None else F.lit(R.DEFAULT_LTV)
    return ltv <= F.lit(b["first_home_max_ltv"]), need > F.lit(b["investor_min_need"])


def scenario_scores(scored: DataFrame, roles: DataFrame, first_home_ok=None, investor_ok=None) -> DataFrame:
    """Multipliers by role, real-estate bonuses, then clamp (in that order)."""
    if first_home_ok is None or investor_ok is None:
        first_home_ok, investor_ok = bonus_flags()
    df = scored.join(roles, "prod_id")
    holistic = F.col("scenario") == R.HOLISTIC
    mult = when_chain([(F.col("role") == r, F.lit(m)) for r, m in R.ROLE_MULTIPLIER.items()], F.lit(1.0))
    s = F.when(holistic, F.col("score")).otherwise(F.col("score") * mult)
    b = R.MORTGAGE_BONUS
    real_estate = F.col("scenario") == R.REAL_ESTATE
    bonus = (F.when(real_estate & (F.col("prod_id") == b["first_home_prod"]) & first_home_ok,
                    F.lit(b["first_home_factor"]))
              .when(real_estate & (F.col("prod_id") == b["investor_prod"]) & investor_ok,
                    F.lit(b["investor_factor"]))
              .otherwise(F.lit(1.0)))
    # one projection; every new column reads the unscaled input score
    return df.withColumns({"base_score": F.col("score"), "score": clamp01(s * bonus),
                           "is_primary": F.col("role") == "primary",
                           "is_cross_sell": F.col("role") == "cross_sell"})


def recommend_scenario(scored: DataFrame, roles: DataFrame, k: int = 3, by=("cust_id",),
                       first_home_ok=None, investor_ok=None) -> DataFrame:
    """Scenario recommendations with the quota pick.

    Holistic: plain top-k.  Otherwise ``np = min(#primary, max(1, k // 2))``,
    ``nc = min(#cross_sell, k - np)``, leftover slots only from *other*; output
    order primary, cross-sell, other, each by score desc then prod_id.
    """
    keys = list(by) + ["scenario"]
    df = scenario_scores(scored, roles, first_home_ok, investor_ok)
    order = [F.col("score").desc(), F.col("prod_id")]
    # The (customer, scenario) windows come first: their hash partitioning
    # also satisfies the finer (customer, scenario, role) window and the final
    # ranking, so the whole pick costs one shuffle.
    grp = Window.partitionBy(*keys)
    n_prim = F.sum(F.when(F.col("role") == "primary", 1).otherwise(0)).over(grp)
    n_cross = F.sum(F.when(F.col("role") == "cross_sell", 1).otherwise(0)).over(grp)
    df = df.withColumn("_np", F.least(n_prim, F.greatest(F.lit(1), F.lit(k // 2))))
    df = df.withColumn("_nc", F.least(n_cross, F.lit(k) - F.col("_np")))
    role_rank = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(*order))
    df = df.withColumn("role_rank", role_rank)
    holistic = F.col("scenario") == R.HOLISTIC
    keep = (holistic
            | ((F.col("role") == "primary") & (F.col("role_rank") <= F.col("_np")))
            | ((F.col("role") == "cross_sell") & (F.col("role_rank") <= F.col("_nc")))
            | ((F.col("role") == "other") & (F.col("role_rank") <= F.lit(k) - F.col("_np") - F.col("_nc"))))
    role_order = when_chain([(F.col("role") == "primary", 0), (F.col("role") == "cross_sell", 1)], 2)
    final = Window.partitionBy(*keys).orderBy(
        F.when(holistic, F.lit(0)).otherwise(role_order), F.col("score").desc(), F.col("prod_id"))
    return (df.where(keep).withColumn("rank", F.row_number().over(final))
              .where(F.col("rank") <= k).drop("_np", "_nc", "role_rank"))


def recommend_for_requests(scored: DataFrame, requests: DataFrame, roles: DataFrame, k: int = 5) -> DataFrame:
    """W2 for financing requests (real-estate scenario with need and ltv).

    A request changes the ranking only through two booleans (first-home and
    investor bonus), so recommendations are computed once per distinct
    (customer, flags) - at most four per customer however many requests it
    has - and joined back to the requests.  A customer holding a third of
    all requests is then a skewed equi-join key, split by AQE's skew join.
    """
    fh, inv = bonus_flags(F.col("financing_need"), F.col("ltv_ratio"))
    req = requests.select("request_id", "cust_id", fh.alias("first_home_ok"), inv.alias("investor_ok"))
    keys = req.select("cust_id", "first_home_ok", "investor_ok").distinct()
    cand = scored.join(keys, "cust_id")
    recs = recommend_scenario(cand, roles, k, by=("cust_id", "first_home_ok", "investor_ok"),
                              first_home_ok=F.col("first_home_ok"), investor_ok=F.col("investor_ok"))
    return req.join(recs, ["cust_id", "first_home_ok", "investor_ok"]).drop("first_home_ok", "investor_ok")


def top_potential(recs: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Expected profit per customer = sum(price * score) over its top-k.

    ``recs`` is a top-k table (cust_id, prod_id, score, rank).  Recommendations
    without a price are skipped; customers without any keep 0.0.  The detail
    list is bounded by k per customer.
    """
    priced = (recs.join(broadcast_bounded(products.select("prod_id", "name", "price")
                                          .where(F.col("price").isNotNull()), MAX_CATALOGUE), "prod_id")
                  .withColumn("expected_profit", F.col("price") * F.col("score")))
    per_cust = priced.groupBy("cust_id").agg(
        F.sum(F.col("expected_profit").cast("decimal(20,6)")).alias("_profit"),
        F.count(F.lit(1)).alias("n_recs"),
        F.sort_array(F.collect_list(F.struct("rank", "prod_id", "name", "score", "price",
                                             "expected_profit"))).alias("recommendations"))
    out = customers.select("cust_id").join(per_cust, "cust_id", "left")
    return out.select(
        "cust_id",
        F.round(F.coalesce(F.col("_profit"), F.lit(0)).cast("double"), 6).alias("expected_profit"),
        F.coalesce(F.col("n_recs"), F.lit(0)).cast("bigint").alias("n_recs"),
        F.coalesce(F.col("recommendations"), F.array().cast(per_cust.schema["recommendations"].dataType))
         .alias("recommendations"))


def best_customers(potential: DataFrame, n: int = 1) -> DataFrame:
    """Highest expected profit, ties by customer id (TakeOrderedAndProject)."""
    return potential.orderBy(F.col("expected_profit").desc(), F.col("cust_id")).limit(n)


def bundle_offer(recs: DataFrame, products: DataFrame, by=("cust_id",)) -> DataFrame:
    """First ``size`` recommendations priced together with a discount,
    offered only when at least ``min_recs`` recommendations exist."""
    b = R.BUNDLE
    price = broadcast_bounded(products.select("prod_id", "name", "price"), MAX_CATALOGUE)
    df = recs.join(price, "prod_id", "left")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.sum(F.when(F.col("rank") <= b["size"], F.col("price").cast("decimal(18,2)"))).alias("_total"),
        F.concat_ws(" + ", F.transform(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= b["size"], F.struct("rank", "name")))),
            lambda x: x["name"])).alias("bundle_names"))
    agg = agg.where(F.col("n_recs") >= b["min_recs"])
    bundle = F.col("_total") * F.lit(1 - b["discount"]).cast("decimal(4,2)")
    return agg.select(*by, "n_recs", "bundle_names",
                      F.col("_total").cast("double").alias("total_price"),
                      bundle.cast("double").alias("bundle_price"),
                      (F.col("_total") - bundle).cast("double").alias("saving"))


# ---------------------------------------------------------------------------
# Row-local variants: the candidates of a customer are an array on its own
# row (scoring.candidate_arrays), so ranking is a projection - no shuffle,
# no window.  Same results as the window operators above.
# ---------------------------------------------------------------------------
def _open_candidates(cands="cands"):
    return F.filter(F.col(cands) if isinstance(cands, str) else cands, lambda x: x["owned"] == 0)


def _role_is(role: str):
    def keep(x):
        return x["role"] == role
    return keep


def _sorted_by_score(items):
    """Sort structs whose first field is the negated score: score desc, then prod_id."""
    return F.sort_array(items)


def topk_rows(cands: DataFrame, k: int = 3, key: str = "cust_id", keep=()) -> DataFrame:
    """W1 on candidate arrays: top k unowned products per row by score desc,
    ties in catalogue order; ``rank`` 1..k.  ``keep`` row columns are carried."""
    ranked = _sorted_by_score(F.transform(_open_candidates(), lambda x: F.struct(
        (-x["score"]).alias("_ns"), x["prod_id"].alias("prod_id"), x["owned"].alias("owned"),
        x["has_model"].alias("has_model"), x["score"].alias("score"), x["pos"].alias("pos"))))
    keep = list(keep)
    return (cands.select(key, *keep, F.posexplode(F.slice(ranked, 1, k)).alias("_pos", "_r"))
            .select(key, *keep, "_r.prod_id", "_r.owned", "_r.has_model", "_r.score", "_r.pos",
                    (F.col("_pos") + 1).alias("rank")))


def topk_id_list(cands: DataFrame, k: int = 3, key: str = "cust_id", sep: str = ",") -> DataFrame:
    """``(key, ids)``: the top-k product ids of each row joined in rank order
    (the one-line form of W1), read straight off the candidate array."""
    ranked = _sorted_by_score(F.transform(_open_candidates(), lambda x: F.struct(
        (-x["score"]).alias("_ns"), x["prod_id"].alias("prod_id"))))
    ids = F.transform(F.slice(ranked, 1, k), lambda x: x["prod_id"].cast("string"))
    return cands.select(key, F.concat_ws(sep, ids).alias("ids"), F.size(ids).alias("_n"))


def _flag(v):
    """A bonus flag given as a Python bool or as a (boolean) column of the row."""
    return v if isinstance(v, Column) else F.lit(bool(v))


def _scenario_picks(cands: DataFrame, matrix, scenarios, k: int, key: str, first_home_ok,
                    investor_ok, keep, variants=None) -> tuple[DataFrame, list]:
    """W2 on candidate arrays.  The bonus flags are constants (the defaults
    mean no financing request: missing ltv = 80, need = 0) or boolean columns
    of the row.

    Per scenario: role from the matrix at the candidate's position, multiplier, real-estate bonus, clamp;
    primaries, cross-sells and others each sorted by score desc / prod_id;
    quotas ``np = min(#primary, max(1, k // 2))``, ``nc = min(#cross, k - np)``,
    the rest from *other*; holistic is a plain top-k.  ``keep`` row columns
    are carried to every output row.  ``variants`` (scenario, first_home_ok,
    investor_ok) triples replace ``scenarios`` and the shared flags when the
    flags differ per pick list.
    """
    keep = list(keep)
    b = R.MORTGAGE_BONUS
    if variants is None:
        variants = [(s, first_home_ok, investor_ok) for s in scenarios]

    def item_fn(s, first_home_ok, investor_ok):
        roles = matrix.roles(s)

        def item(x):
            role = roles[x["pos"]]
            if s == R.HOLISTIC:
                adj = x["score"]
            else:
                mult = when_chain([(role == r, F.lit(m)) for r, m in R.ROLE_MULTIPLIER.items()], F.lit(1.0))
                bonus = F.lit(1.0)
                if s == R.REAL_ESTATE:
                    bonus = (F.when((x["prod_id"] == b["first_home_prod"]) & _flag(first_home_ok),
                                    F.lit(b["first_home_factor"]))
                              .when((x["prod_id"] == b["investor_prod"]) & _flag(investor_ok),
                                    F.lit(b["investor_factor"]))
                              .otherwise(F.lit(1.0)))
                adj = clamp01(x["score"] * mult * bonus)
            return F.struct((-adj).alias("_ns"), x["prod_id"].alias("prod_id"), role.alias("role"),
                            x["score"].alias("base_score"), adj.alias("score"), x["pos"].alias("pos"))
        return item

    def out_fn(s):
        def out(x, i):
            return F.struct(F.lit(s).alias("scenario"), (i + 1).alias("rank"), x["prod_id"].alias("prod_id"),
                            x["role"].alias("role"), x["base_score"].alias("base_score"),
                            x["score"].alias("score"), x["pos"].alias("pos"))
        return out

    # Staged projections: each array below is computed once per row (a
    # higher-order function gets no common-subexpression elimination, so a
    # single nested expression would re-evaluate shared arrays many times).
    scenarios = [v[0] for v in variants]
    names = [f"_s{i}" for i in range(len(variants))]
    df = cands.select(key, *keep, _open_candidates().alias("_open"))
    items = {}
    for n, (s, fh, inv) in zip(names, variants):
        items[f"{n}_items"] = F.transform("_open", item_fn(s, fh, inv))
    df = df.select(key, *keep, *[c.alias(a) for a, c in items.items()])
    sorted_cols = []
    for n, s in zip(names, scenarios):
        it = F.col(f"{n}_items")
        if s == R.HOLISTIC:
            sorted_cols.append(F.slice(_sorted_by_score(it), 1, k).alias(f"{n}_picked"))
        else:
            for role, tag in (("primary", "p"), ("cross_sell", "c"), ("other", "o")):
                sorted_cols.append(_sorted_by_score(F.filter(it, _role_is(role))).alias(f"{n}_{tag}"))
    df = df.select(key, *keep, *sorted_cols)
    counts = []
    for n, s in zip(names, scenarios):
        if s != R.HOLISTIC:
            counts += [F.least(F.size(f"{n}_p"), F.lit(max(1, k // 2))).alias(f"{n}_np"),
                       F.size(f"{n}_c").alias(f"{n}_sc")]
    df = df.select("*", *counts)
    picks = []
    for n, s in zip(names, scenarios):
        if s == R.HOLISTIC:
            picked = F.col(f"{n}_picked")
        else:
            n_p = F.col(f"{n}_np")
            n_c = F.least(F.col(f"{n}_sc"), F.lit(k) - n_p)
            n_o = F.greatest(F.lit(0), F.lit(k) - n_p - n_c)
            picked = F.concat(F.slice(f"{n}_p", 1, n_p), F.slice(f"{n}_c", 1, n_c), F.slice(f"{n}_o", 1, n_o))
        picks.append(F.transform(picked, out_fn(s)))
    return df, picks


def scenario_rows(cands: DataFrame, matrix, scenarios, k: int = 3, key: str = "cust_id",
                  first_home_ok: bool = True, investor_ok: bool = False, keep=()) -> DataFrame:
    """W2 on candidate arrays, one row per pick (see :func:`_scenario_picks`)."""
    keep = list(keep)
    df, picks = _scenario_picks(cands, matrix, scenarios, k, key, first_home_ok, investor_ok, keep)
    out = df.select(key, *keep, F.inline(F.concat(*picks)))
    return out.withColumns({"is_primary": F.col("role") == "primary",
                            "is_cross_sell": F.col("role") == "cross_sell"})


def recommend_for_requests_rows(cands: DataFrame, matrix, requests: DataFrame, k: int = 5) -> DataFrame:
    """W2 for financing requests on candidate arrays (real-estate scenario).

    A request changes the ranking only through its two bonus flags, so every
    customer row computes the pick for all four flag combinations in one
    projection (a fixed 4x of a bounded list), keyed by ``2*first_home +
    investor``.  Each request then needs one equi-join on the customer id and
    takes its combination's list: two shuffles, no window, no distinct.  A
    customer with a third of all requests is a skewed key on the request side
    only, which AQE's skew join splits.
    """
    fh, inv = bonus_flags(F.col("financing_need"), F.col("ltv_ratio"))
    req = requests.select("request_id", "cust_id",
                          (fh.cast("int") * 2 + inv.cast("int")).alias("_flags"))
    combos = [(True, True), (True, False), (False, True), (False, False)]
    df, picks = _scenario_picks(cands, matrix, None, k, "cust_id", None, None, [],
                                variants=[(R.REAL_ESTATE, a, b) for a, b in combos])
    by_flags = F.create_map(*[x for (a, b), p in zip(combos, picks) for x in (F.lit(2 * int(a) + int(b)), p)])
    lists = df.select("cust_id", by_flags.alias("_by_flags"))
    out = req.join(lists, "cust_id")
    return out.select("request_id", "cust_id", F.inline(F.element_at("_by_flags", F.col("_flags"))))


def scenario_lists(cands: DataFrame, matrix, scenarios, k: int = 3, key: str = "cust_id",
                   first_home_ok: bool = True, investor_ok: bool = False) -> DataFrame:
    """W2 on candidate arrays, one row per (row, scenario) with its ordered
    ``recs`` list (rank, prod_id, role, base_score, score, pos)."""
    df, picks = _scenario_picks(cands, matrix, scenarios, k, key, first_home_ok, investor_ok, [])
    per = [F.struct(F.lit(s).alias("scenario"), F.transform(p, lambda x: F.struct(
        x["rank"].alias("rank"), x["prod_id"].alias("prod_id"), x["role"].alias("role"),
        x["base_score"].alias("base_score"), x["score"].alias("score"), x["pos"].alias("pos"))).alias("recs"))
           for s, p in zip(scenarios, picks)]
    return df.select(key, F.inline(F.array(*per)))


def bundle_rows(lists: DataFrame, matrix, by=("cust_id", "scenario")) -> DataFrame:
    """A19 on recommendation lists: the first ``size`` recommendations priced
    together with the discount, only with at least ``min_recs`` of them.
    Prices and names are read at the product's position; no grouping, no shuffle."""
    b = R.BUNDLE
    m = matrix
    first = F.filter("recs", lambda x: x["rank"] <= b["size"])
    staged = lists.select(*by, F.size("recs").cast("bigint").alias("n_recs"), first.alias("_first"))
    staged = staged.where(F.col("n_recs") >= b["min_recs"]).select(
        *by, "n_recs",
        F.concat_ws(" + ", F.transform("_first", lambda x: m["names"][x["pos"]])).alias("bundle_names"),
        F.filter(F.transform("_first", lambda x: m["prices"][x["pos"]].cast("decimal(18,2)")),
                 lambda v: v.isNotNull()).alias("_prices"))
    dec = "decimal(38,2)"
    total = F.when(F.size("_prices") > 0, F.aggregate("_prices", F.lit(0).cast(dec),
                                                      lambda acc, v: (acc + v).cast(dec)))
    staged = staged.select(*by, "n_recs", "bundle_names", total.alias("_total"))
    bundle = F.col("_total") * F.lit(1 - b["discount"]).cast("decimal(4,2)")
    return staged.select(*by, "n_recs", "bundle_names",
                         F.col("_total").cast("double").alias("total_price"),
                         bundle.cast("double").alias("bundle_price"),
                         (F.col("_total") - bundle).cast("double").alias("saving"))




def top_potential_rows(cands: DataFrame, matrix, k: int = 3, key: str = "cust_id", keep=()) -> DataFrame:
    """A18 on candidate arrays: expected profit = sum(price * score) over the
    top-k by score, recommendations without a price skipped; every row (every
    customer of the feature table) gets a result, 0.0 without candidates.  ``top`` lists
    the top-k whether priced or not.

    Prices and names are read from the matrix at the product's position, so the
    whole analysis is one projection of the customers' rows.
    """
    m, keep = matrix, list(keep)
    ranked = _sorted_by_score(F.transform(_open_candidates(), lambda x: F.struct(
        (-x["score"]).alias("_ns"), x["prod_id"].alias("prod_id"), x["score"].alias("score"), x["pos"].alias("pos"))))
    recs = F.transform(F.slice(ranked, 1, k), lambda x, i: F.struct(
        (i + 1).alias("rank"), x["prod_id"].alias("prod_id"), m["names"][x["pos"]].alias("name"),
        x["score"].alias("score"), m["prices"][x["pos"]].cast("double").alias("price"),
        (m["prices"][x["pos"]].cast("double") * x["score"]).alias("expected_profit")))
    # staged: each list is computed once; the priced one is then read three times
    staged = cands.select(key, *keep, recs.alias("top"))
    staged = staged.select(key, *keep, "top", F.filter("top", lambda x: x["price"].isNotNull()).alias("recommendations"))
    dec = "decimal(38,6)"
    profit = F.aggregate("recommendations", F.lit(0).cast(dec),
                         lambda acc, x: (acc + x["expected_profit"].cast("decimal(20,6)")).cast(dec))
    return staged.select(
        key, *keep, F.round(profit.cast("double"), 6).alias("expected_profit"),
        F.size("recommendations").cast("bigint").alias("n_recs"), "recommendations", "top")


def customer_names(customers: DataFrame) -> DataFrame:
    """``cust_id, customer_name``: first and last name."""
    return customers.select("cust_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"))


def named_customers(rows: DataFrame, customers: DataFrame, key: str = "cust_id") -> DataFrame:
    """``rows`` with ``customer_name``; a customer that is unknown, or has
    neither name, gets a label with the id."""
    names = customer_names(customers).withColumnRenamed("cust_id", key)
    label = F.concat(F.lit(R.CUSTOMER_LABEL), F.col(key).cast("string"))
    return rows.join(names, key, "left").withColumn(
        "customer_name", F.coalesce(F.nullif(F.trim("customer_name"), F.lit("")), label))


def ranked_customers(potential: DataFrame, score: str = "expected_profit", key: str = "cust_id") -> DataFrame:
    """A18 as the ordered list: ``rank`` 1, 2, ... over all rows by score desc, ties
    by id."""
    return global_rank(potential, [F.col(score).desc_nulls_last(), F.col(key).asc_nulls_first()])
