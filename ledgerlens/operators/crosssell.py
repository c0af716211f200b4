"""Cross-sell, upsell and coverage.

Everything is computed from one aggregated row per customer (its sorted set of
owned product ids, bounded by the catalogue size) with array expressions; the
rule edges and the catalogue are size-checked literals.  One shuffle (the
ownership aggregate by customer), no anti join, no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import coverage_band
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import collect_bounded

MAX_CATALOGUE = 10_000


def catalogue_rows(products: DataFrame, max_rows: int = MAX_CATALOGUE):
    """The catalogue as a sorted list of (prod_id, name, category); size-checked, and
    read once for the many queries that share it."""
    rows = collect_bounded(products.select("prod_id", "name", "category"), max_rows)
    return sorted((int(r["prod_id"]), r["name"], r["category"]) for r in rows)


def _int_map(d: dict) -> F.Column:
    if not d:
        return F.create_map().cast("map<int,string>")
    return F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(v))])


def _edge_map(edges: dict) -> F.Column:
    return F.create_map(*[x for s, ts in sorted(edges.items())
                          for x in (F.lit(s), F.array(*[F.lit(t) for t in ts]))])


def owned_sets(customers: DataFrame, ownership: DataFrame) -> DataFrame:
    """(cust_id, owned: sorted array<int>, n_owned) for every customer."""
    agg = ownership.groupBy("cust_id").agg(
        F.array_sort(F.collect_set(F.col("prod_id").cast("int"))).alias("owned"),
        F.count(F.lit(1)).alias("n_owned"))
    return (customers.select("cust_id").join(agg, "cust_id", "left")
            .select("cust_id", F.coalesce("owned", F.array().cast("array<int>")).alias("owned"),
                    F.coalesce("n_owned", F.lit(0)).cast("bigint").alias("n_owned")))


class CrossSell:
    """Column expressions over an ``owned`` array, bound to one catalogue."""

    def __init__(self, catalogue, edges=None, upsell=None):
        self.names = {p: n for p, n, _ in catalogue}
        self.cats = {p: c for p, _, c in catalogue}
        self.n_catalogue = len(catalogue)
        self.all_categories = sorted({c for c in self.cats.values() if c is not None})
        self.edges = R.CROSS_SELL_EDGES if edges is None else edges
        self.upsell_edges = R.UPSELL_EDGES if upsell is None else upsell

    def targets(self, owned="owned") -> F.Column:
        """Rule targets of owned products that are not owned and exist in the catalogue."""
        o = F.col(owned)
        emap = _edge_map(self.edges)
        names = _int_map(self.names)
        cand = F.flatten(F.transform(o, lambda s: F.coalesce(emap[s], F.array().cast("array<int>"))))
        keep = F.filter(cand, lambda t: ~F.array_contains(o, t) & names[t].isNotNull())
        return F.array_sort(F.array_distinct(keep))

    def target_names(self, owned="owned") -> F.Column:
        names = _int_map(self.names)
        return F.transform(self.targets(owned), lambda t: names[t])

    def upsell(self, owned="owned") -> F.Column:
        """Owns A and not B for an upsell edge A -> B."""
        o = F.col(owned)
        expr = F.lit(False)
        for a, bs in self.upsell_edges.items():
            for b in bs:
                expr = expr | (F.array_contains(o, F.lit(a)) & ~F.array_contains(o, F.lit(b)))
        return expr

    def missing_categories(self, owned="owned") -> F.Column:
        """Catalogue categories with no owned product, sorted."""
        cats = _int_map(self.cats)
        owned_cats = F.transform(F.col(owned), lambda p: cats[p])
        allc = F.array(*[F.lit(c) for c in self.all_categories]) if self.all_categories else F.array().cast("array<string>")
        return F.array_except(allc, owned_cats)

    def owned_names(self, owned="owned") -> F.Column:
        """Names of owned catalogue products in catalogue order."""
        names = _int_map(self.names)
        return F.concat_ws(", ", F.transform(F.filter(F.col(owned), lambda p: names[p].isNotNull()),
                                             lambda p: names[p]))

    def coverage(self, n_owned="n_owned") -> F.Column:
        """Owned / catalogue * 100."""
        total = float(self.n_catalogue) if self.n_catalogue else 1.0
        return F.col(n_owned).cast("double") / F.lit(total) * F.lit(100.0)


def cross_sell(sets: DataFrame, cs: CrossSell) -> DataFrame:
    names = _int_map(cs.names)
    return (sets.select("cust_id", F.explode(cs.targets()).alias("prod_id"))
            .withColumn("name", names[F.col("prod_id")]))


def upsell(sets: DataFrame, cs: CrossSell) -> DataFrame:
    rows = []
    for a, bs in cs.upsell_edges.items():
        for b in bs:
            rows.append(F.when(F.array_contains("owned", F.lit(a)) & ~F.array_contains("owned", F.lit(b)),
                               F.struct(F.lit(a).alias("from_prod_id"), F.lit(b).alias("to_prod_id"))))
    return sets.select("cust_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("u")) \
               .select("cust_id", "u.from_prod_id", "u.to_prod_id")


def missing_categories(sets: DataFrame, cs: CrossSell) -> DataFrame:
    return sets.select("cust_id", F.explode(cs.missing_categories()).alias("category"))


def owned_names(sets: DataFrame, cs: CrossSell) -> DataFrame:
    return sets.select("cust_id", cs.owned_names().alias("owned_names"))


def coverage(sets: DataFrame, cs: CrossSell) -> DataFrame:
    cov = cs.coverage()
    return sets.select("cust_id", "n_owned", cov.alias("coverage"), coverage_band(cov).alias("potential"))


def cross_sell_report(sets: DataFrame, cs: CrossSell) -> DataFrame:
    """The five analyses in one row per customer."""
    cov = cs.coverage()
    return sets.select(
        "cust_id", cs.owned_names().alias("owned_names"),
        F.concat_ws(", ", cs.target_names()).alias("cross_sell"),
        cs.upsell().alias("upsell"),
        F.concat_ws(", ", cs.missing_categories()).alias("missing_categories"),
        cov.alias("coverage"), coverage_band(cov).alias("potential"))
