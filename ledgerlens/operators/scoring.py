"""Propensity scoring (M7, M8) and explanations (W3) as a matrix product.

A customer is a vector: the encoded base features, and the sorted catalogue
positions of the products they own (the flags that are 1).  A model is a row of
weights per product, aligned with the features: base features first, then a flag
per product in catalogue order; null where a feature takes no part.  The models of
all products form one row of aligned arrays (:class:`ModelMatrix`), next to the
products' ids, names, prices and scenario roles.  Scoring walks the matrix on the
customer's own row: one sum over the owned positions per product, whatever the
number of products, so the plan has no literal per weight and nothing grows in
the generated code.

The matrix is a constant of bounded size that reaches the tasks with the plan.
Beyond ``MAX_CELLS`` weights, the same scores come from a sparse matrix product:
customers' non-zero features joined with the weights by feature, summed per
customer and product (:func:`candidates_by_join`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded, constant

#: Weights that are kept in one row (16 MB).
MAX_CELLS = 2_000_000
#: Products that a customer's row of candidates may hold.
MAX_CATALOGUE = 100_000
SCORE_DIGITS = 6
N_BASE = len(R.BASE_FEATURES)
#: Parts of a feature's customers in the join form: a base feature holds all of them.
SALTS = 64


def catalogue_positions(products: DataFrame) -> DataFrame:
    """The catalogue in id order with ``pos`` from 0.  The numbering is one task
    over the products, not over any fact table."""
    numbered = F.row_number().over(Window.orderBy("prod_id")) - 1
    return products.select("prod_id", "name", "category", "price", numbered.alias("pos"))


def feature_table(catalogue: DataFrame) -> DataFrame:
    """``feature, idx, label`` of every model feature (J11: flags are labelled with
    the product's name)."""
    base = catalogue.sparkSession.createDataFrame(
        [(f, i, R.BASE_FEATURE_LABELS[f]) for i, f in enumerate(R.BASE_FEATURES)], "feature string, idx int, label string")
    return base.unionByName(catalogue.select(
        F.concat(F.lit("has_"), F.col("prod_id").cast("string")).alias("feature"), (F.col("pos") + N_BASE).alias("idx"),
        F.concat(F.lit("owns "), F.col("name")).alias("label")))


def model_rows(catalogue: DataFrame, coefficients: DataFrame, intercepts: DataFrame) -> DataFrame:
    """``prod_id, intercept, weights`` per model from long coefficient tables.
    A flag of a product that has left the catalogue is always 0 and is left out."""
    features = feature_table(catalogue)
    placed = coefficients.join(features.select("feature", "idx"), "feature").select("prod_id", "idx", "coefficient")
    n = features.agg(F.count("*").cast("int").alias("n")).scalar()
    grid = intercepts.select("prod_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    dense = grid.join(placed, ["prod_id", "idx"], "left").groupBy("prod_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "coefficient"))), lambda x: x["coefficient"]).alias("weights"))
    return intercepts.select("prod_id", F.col("intercept").cast("double").alias("intercept")).join(dense, "prod_id")


#: The matrix's aligned arrays, and how they are typed.
FIELDS = {"prod_ids": "array<int>", "names": "array<string>", "categories": "array<string>", "prices": "array<double>",
          "has_model": "array<boolean>", "intercepts": "array<double>", "weights": "array<array<double>>",
          "features": "array<string>", "labels": "array<string>", "roles": "array<string>"}


@dataclass(frozen=True)
class ModelMatrix:
    """Models and catalogue as aligned arrays of bounded size.

    ``matrix["names"][pos]`` is a column: the entry at a catalogue position.
    ``weights`` holds an array per product; without ``in_row`` there are too many
    for a constant, and ``models`` is joined."""

    arrays: dict
    catalogue: DataFrame
    models: DataFrame
    in_row: bool

    def __getitem__(self, name: str) -> Column:
        return constant(self.arrays[name], FIELDS[name])

    def roles(self, scenario: str) -> Column:
        ids, (primary, cross) = self.arrays["prod_ids"], R.SCENARIOS.get(scenario, R.SCENARIOS[R.HOLISTIC])
        return constant(["primary" if p in primary else "cross_sell" if p in cross else "other" for p in ids], FIELDS["roles"])


def model_matrix(catalogue: DataFrame, models: DataFrame, max_cells: int = MAX_CELLS) -> ModelMatrix:
    """The matrix of ``models`` (``prod_id, intercept, weights``) over a catalogue
    with positions.  The products, and up to ``max_cells`` weights, reach the driver."""
    n = catalogue.limit(MAX_CATALOGUE + 1).count()
    if n > MAX_CATALOGUE:
        raise ValueError(f"a row of candidates holds at most {MAX_CATALOGUE} products")
    in_row = n * (n + N_BASE) <= max_cells
    known = models.select("prod_id", "intercept", *(["weights"] if in_row else []), F.lit(True).alias("has_model"))
    rows = catalogue.join(known, "prod_id", "left").orderBy("pos").collect()
    features = feature_table(catalogue).orderBy("idx").collect()
    arrays = {
        "prod_ids": [int(r.prod_id) for r in rows], "names": [r.name for r in rows], "categories": [r.category for r in rows],
        "prices": [None if r.price is None else float(r.price) for r in rows],
        "has_model": [bool(r.has_model) for r in rows], "intercepts": [r.intercept for r in rows],
        "weights": [r.weights for r in rows] if in_row else None,
        "features": [r.feature for r in features], "labels": [r.label for r in features]}
    return ModelMatrix(arrays, catalogue, models, in_row)


def customer_vectors(customers: DataFrame, ownership: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``cust_id, age_bucket, revenue, credit_score, owned``: M1 as vectors, with the
    owned positions in order.  One partial aggregate per customer."""
    placed = ownership.select("cust_id", "prod_id").join(
        broadcast_bounded(catalogue.select("prod_id", "pos"), MAX_CATALOGUE), "prod_id")
    owned = placed.groupBy("cust_id").agg(F.sort_array(F.collect_set("pos")).alias("owned"))
    return customers.select("cust_id", "age_bucket", "revenue", "credit_score").join(owned, "cust_id", "left").withColumn(
        "owned", F.coalesce("owned", F.array().cast("array<int>")))


def _terms(w: Column, start: Column) -> Column:
    """The linear form of a row in feature order; null if a base feature is."""
    z = start
    for k in range(N_BASE):
        z = z + F.coalesce(w[k], F.lit(0.0)) * F.col("base")[k]
    return F.aggregate("owned", z, lambda acc, j: acc + F.coalesce(w[j + N_BASE], F.lit(0.0)))


def _chance(z: Column) -> Column:
    """M7 + M8: rounded P(class 1), or the fallback score for a null form."""
    return F.coalesce(F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), SCORE_DIGITS), F.lit(R.FALLBACK_SCORE))


def candidate_arrays(vectors: DataFrame, matrix: ModelMatrix, keep=()) -> DataFrame:
    """``cust_id, keep..., cands``: per customer one struct ``prod_id, owned, has_model,
    score, pos`` per catalogue product, in id order.

    ``vectors`` carries ``base`` (array<double>) and ``owned``.  The candidates of a
    customer never leave its row, so rankings over them need no shuffle; "not owned"
    is the row's own list, so the anti join (J5) is a filter."""
    if not matrix.in_row:
        return candidates_by_join(vectors, matrix, keep)
    m = matrix

    def candidate(w, i):
        score = F.when(m["has_model"][i], _chance(_terms(w, m["intercepts"][i]))).otherwise(F.lit(R.FALLBACK_SCORE))
        return F.struct(m["prod_ids"][i].alias("prod_id"), F.array_contains("owned", i).cast("int").alias("owned"),
                        m["has_model"][i].alias("has_model"), score.alias("score"), i.alias("pos"))

    return vectors.select("cust_id", *keep, F.transform(m["weights"], candidate).alias("cands"))


def candidates_by_join(vectors: DataFrame, matrix: ModelMatrix, keep=()) -> DataFrame:
    """:func:`candidate_arrays` for any number of weights: the sparse product of
    customers' features and weights.  Every customer has a constant feature (-1),
    which meets the intercept of every product, also of one without a model."""
    products = matrix.catalogue.select("prod_id", "pos").join(
        matrix.models.select("prod_id", "intercept", "weights"), "prod_id", "left")
    constant = F.array(F.struct(F.lit(-1).alias("idx"), F.col("intercept").alias("w"), F.lit(True).alias("start")))
    weighted = products.select("prod_id", "pos", F.inline(F.concat(constant, F.transform(
        F.coalesce("weights", F.array().cast("array<double>")),
        lambda w, i: F.struct(i.alias("idx"), w.alias("w"), F.lit(False).alias("start"))))))
    weighted = weighted.filter("w IS NOT NULL OR start").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    values = F.concat(F.array(F.struct(F.lit(-1).alias("idx"), F.lit(1.0).alias("x"))),
                      F.transform("base", lambda x, i: F.struct(i.alias("idx"), x.alias("x"))),
                      F.transform("owned", lambda j: F.struct((j + N_BASE).alias("idx"), F.lit(1.0).alias("x"))))
    sparse = vectors.select("cust_id", F.pmod(F.xxhash64("cust_id"), F.lit(SALTS)).cast("int").alias("salt"), F.inline(values))
    sums = sparse.join(weighted, ["idx", "salt"]).groupBy("cust_id", "prod_id", "pos").agg(
        F.sum(F.col("w") * F.col("x")).alias("z"), F.count("*").alias("met"), F.count(F.col("w") * F.col("x")).alias("given"),
        F.max((F.col("idx") == -1) & F.col("w").isNotNull()).alias("has_model"))
    score = F.when(F.col("has_model") & (F.col("met") == F.col("given")), _chance(F.col("z"))).otherwise(F.lit(R.FALLBACK_SCORE))
    listed = sums.groupBy("cust_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "prod_id", "has_model", score.alias("score")))).alias("c"))
    cands = F.transform("c", lambda x: F.struct(
        x["prod_id"].alias("prod_id"), F.array_contains("owned", x["pos"]).cast("int").alias("owned"),
        x["has_model"].alias("has_model"), x["score"].alias("score"), x["pos"].alias("pos")))
    return vectors.select("cust_id", "owned", *[c for c in keep if c != "owned"]).join(listed, "cust_id").select(
        "cust_id", *keep, cands.alias("cands"))


def score_products(vectors: DataFrame, matrix: ModelMatrix, keep_owned: bool = False) -> DataFrame:
    """Long table ``cust_id, prod_id, owned, has_model, score, pos``."""
    out = candidate_arrays(vectors, matrix).select("cust_id", F.inline("cands"))
    return out if keep_owned else out.where(F.col("owned") == 0)


def contributions(rows: DataFrame, matrix: ModelMatrix, by=("cust_id", "prod_id")) -> DataFrame:
    """The list ``contribs`` of ``feature, feature_pos, coefficient, value,
    contribution`` per row, without the intercept; none for a product without a model.

    ``rows`` are recommendations with ``pos``, ``base`` and ``owned``.  The weights are
    read at the product's position; a value is the base feature or the flag."""
    m = matrix
    if matrix.in_row:
        weights = rows.withColumn("_w", F.when(m["has_model"][F.col("pos")], m["weights"][F.col("pos")]))
    else:
        weights = rows.join(matrix.models.select("prod_id", F.col("weights").alias("_w")), "prod_id", "left")
    values = F.concat("base", F.transform(m["prod_ids"], lambda p, i: F.array_contains("owned", i).cast("double")))
    out = weights.select(*by, "_w", values.alias("_x"))
    items = F.zip_with(F.col("_w"), F.col("_x"), lambda w, x: F.struct(w.alias("w"), x.alias("x")))
    listed = F.transform(items, lambda t, i: F.struct(
        m["features"][i].alias("feature"), i.alias("feature_pos"), t["w"].alias("coefficient"), t["x"].alias("value"),
        (t["w"] * t["x"]).alias("contribution")))
    return out.select(*by, F.filter(listed, lambda t: t["coefficient"].isNotNull()).alias("contribs"))


def top_contributions(listed: DataFrame, matrix: ModelMatrix, n: int = 5, by=("cust_id", "prod_id")) -> DataFrame:
    """W3 display: the n largest |contribution| of each list (unknown last, ties in
    feature order), each with its share of the n shown, summed in rank order, and
    that share as text with one decimal (P15)."""
    m = matrix
    ranked = F.sort_array(F.transform("contribs", lambda c: F.struct(
        F.coalesce(-F.abs(c["contribution"]), F.lit(float("inf"))).alias("_k"), c["feature_pos"].alias("pos"),
        c["feature"].alias("feature"), c["contribution"].alias("contribution"))))
    top = listed.select(*by, F.slice(ranked, 1, n).alias("_top"))
    top = top.select(*by, "_top", F.aggregate("_top", F.lit(0.0), lambda acc, x: acc + F.abs(x["contribution"])).alias("_total"))
    out = top.select(*by, "_total", F.posexplode("_top").alias("_pos", "_c"))
    guard = F.coalesce(F.nullif(F.col("_total"), F.lit(0.0)), F.lit(1.0))
    contribution = F.col("_c.contribution")
    return out.select(
        *by, (F.col("_pos") + 1).alias("rank"), F.col("_c.feature").alias("feature"),
        F.coalesce(m["labels"][F.col("_c.pos")], F.col("_c.feature")).alias("label"), contribution.alias("contribution"),
        (F.abs(contribution) / guard * F.lit(100.0)).alias("share"),
        F.concat(F.round((F.abs(contribution) / guard * F.lit(100.0)).cast("decimal(18,6)"), 1).cast("string"), F.lit("%")).alias("shown"),
        F.when(contribution > 0, "+").otherwise("-").alias("sign"))
