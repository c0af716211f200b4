"""Scoring as a matrix, the split, Newton training and its certificate, against NumPy."""

import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import models as MD
from ledgerlens.operators import recommend as RC
from ledgerlens.operators import scoring as SC
from ledgerlens.plans import rules as R


def catalogue(spark, n):
    data = [(1000 + 3 * i, f"p{i}", "depot", 10.0 + i % 7) for i in range(n)]
    random.Random(1).shuffle(data)
    return SC.catalogue_positions(spark.createDataFrame(data, "prod_id int, name string, category string, price double"))


def coefficients(spark, n, without=()):
    """Long tables and the same as arrays; a product in ``without`` has no model."""
    rng = np.random.default_rng(n)
    w = rng.normal(size=(n, SC.N_BASE + n)).round(3)
    b = rng.normal(size=n).round(3)
    for i in range(n):
        w[i, SC.N_BASE + i] = 0
    names = R.BASE_FEATURES + [f"has_{1000 + 3 * i}" for i in range(n)]
    long = [(1000 + 3 * i, names[j], float(w[i, j])) for i in range(n) for j in range(len(names))
            if i not in without and j != SC.N_BASE + i]
    starts = [(1000 + 3 * i, float(b[i])) for i in range(n) if i not in without]
    return (spark.createDataFrame(long, "prod_id int, feature string, coefficient double"),
            spark.createDataFrame(starts, "prod_id int, intercept double"), w, b)


def vectors(spark, n, customers, seed=7):
    rnd = random.Random(seed)
    data = []
    for c in range(customers):
        base = [float(rnd.randrange(4)), rnd.gauss(0, 1), rnd.gauss(0, 1)]
        if c % 11 == 5:
            base[rnd.randrange(3)] = None
        owned = sorted(rnd.sample(range(n), rnd.choice([0, 1, 3, min(n, 8)])))
        data.append((c, base, owned))
    return data, spark.createDataFrame(data, "cust_id long, base array<double>, owned array<int>")


def expected_scores(data, w, b, without):
    out = {}
    for c, base, owned in data:
        for i in range(len(b)):
            if i in without or None in base:
                score = R.FALLBACK_SCORE
            else:
                z = b[i] + sum(x * y for x, y in zip(w[i], base, strict=False)) + sum(w[i, SC.N_BASE + j] for j in owned)
                score = round(1 / (1 + math.exp(-z)), 6)
            out[c, 1000 + 3 * i] = (int(i in owned), i not in without, score)
    return out


@pytest.mark.parametrize("n, customers", [(25, 60), (1000, 4)])
def test_scores_of_small_and_large_catalogues(spark, n, customers):
    without = {3, n - 1}
    coef, start, w, b = coefficients(spark, n, without)
    cat = catalogue(spark, n)
    matrix = SC.model_matrix(cat, SC.model_rows(cat, coef, start))
    data, frame = vectors(spark, n, customers)
    want = expected_scores(data, w, b, without)
    got = {(r.cust_id, r.prod_id): (r.owned, r.has_model, r.score) for r in SC.score_products(frame, matrix, True).collect()}
    assert matrix.in_row and got.keys() == want.keys()
    for k, (owned, has_model, score) in want.items():
        assert got[k][:2] == (owned, has_model) and got[k][2] == pytest.approx(score, abs=2e-6)
    # The plan does not grow with the products.
    plan = SC.candidate_arrays(frame, matrix)._jdf.queryExecution().sparkPlan()
    assert len(list(plan.expressions().mkString(" ").split("aggregate("))) <= 3


def test_join_form_equals_row_form(spark):
    n, without = 12, {2}
    coef, start, _, _ = coefficients(spark, n, without)
    cat = catalogue(spark, n)
    models = SC.model_rows(cat, coef, start)
    _, frame = vectors(spark, n, 40)
    row, join = SC.model_matrix(cat, models), SC.model_matrix(cat, models, max_cells=10)
    assert row.in_row and not join.in_row
    assert rows(SC.score_products(frame, row, True)) == rows(SC.score_products(frame, join, True))
    top = RC.topk_rows(SC.candidate_arrays(frame.withColumn("o", F.col("owned")), row, ("base", "o")), 3, keep=("base", "o"))
    top = top.drop("owned").withColumnRenamed("o", "owned")
    a, b = (rows(SC.contributions(top, m).select("cust_id", "prod_id", F.inline("contribs"))) for m in (row, join))
    assert a == b and len(a) > 100


def test_contributions_sum_to_the_form_and_shares_to_100(spark):
    n = 6
    coef, start, w, b = coefficients(spark, n)
    cat = catalogue(spark, n)
    matrix = SC.model_matrix(cat, SC.model_rows(cat, coef, start))
    data, frame = vectors(spark, n, 20)
    listed = SC.contributions(frame.crossJoin(cat.select("prod_id", "pos")), matrix)
    by_id = {c: (base, owned) for c, base, owned in data}
    for r in listed.collect():
        base, owned = by_id[r.cust_id]
        i = (r.prod_id - 1000) // 3
        values = base + [float(j in owned) for j in range(n)]
        want = [(j, w[i, j], v, None if v is None else w[i, j] * v) for j, v in enumerate(values) if j != SC.N_BASE + i]
        assert [(c.feature_pos, c.coefficient, c.value, c.contribution) for c in r.contribs] == want
    top = SC.top_contributions(listed, matrix, 4).collect()
    sums = {}
    for r in top:
        sums[r.cust_id, r.prod_id] = sums.get((r.cust_id, r.prod_id), 0) + (r.share or 0)
    assert all(s == pytest.approx(100) for s in sums.values()) and {r["rank"] for r in top} == {1, 2, 3, 4}
    assert {r.label for r in top} & {"income", "owns p3"}


# ------------------------------------------------------------------- split ---
def key_of(c):
    return int(md5(f"42:{c}".encode()).hexdigest()[:15], 16)


def expected_split(data, n):
    out = {}
    for i in range(n):
        classes = {label: sorted((key_of(c), c) for c, _, owned in data if int(i in owned) == label) for label in (0, 1)}
        total = len(data)
        wanted = math.ceil(total * 0.2)
        quota = {k: len(v) * wanted // total for k, v in classes.items()}
        rest = sorted((k for k in classes if classes[k]), key=lambda k: (-(len(classes[k]) * wanted % total), k))
        for k in rest[: wanted - sum(quota.values())]:
            quota[k] += 1
        for k, members in classes.items():
            for place, (_, c) in enumerate(members):
                out[c, 1000 + 3 * i] = (k, "test" if place < quota[k] else "train")
    return out


@pytest.mark.parametrize("customers, bits", [(103, 1), (103, 12), (7, 4), (400, 6)])
def test_split_size_and_members(spark, customers, bits):
    n = 5
    data, frame = vectors(spark, n, customers, seed=customers)
    keyed = MD.with_split_key(frame)
    cat = catalogue(spark, n)
    limits = MD.split_thresholds(keyed, cat, bits=bits)
    got = {(r.cust_id, r.prod_id): (r.label, r.split) for r in MD.product_splits(keyed, limits, cat).collect()}
    assert got == expected_split(data, n)
    for i in range(n):  # over both classes
        assert sum(s == "test" for (_, p), (_, s) in got.items() if p == 1000 + 3 * i) == math.ceil(customers * 0.2)


def test_evaluation_has_no_join(spark):
    coef, start, _, _ = coefficients(spark, 5)
    cat = catalogue(spark, 5)
    _, frame = vectors(spark, 5, 50)
    keyed = MD.with_split_key(frame)
    pred = MD.predictions(keyed, SC.model_matrix(cat, SC.model_rows(cat, coef, start)), MD.split_thresholds(keyed, cat))
    assert "Join" not in MD.auc(pred)._jdf.queryExecution().optimizedPlan().toString()
    assert pred.count() == 250


# ---------------------------------------------------------------- training ---
def newton(x, y, C, iters=50):
    """Minimum of C * sum w_i logloss_i + 0.5 |beta|^2 (constant free), balanced w."""
    n = len(y)
    w = np.where(y == 1, n / (2.0 * y.sum()), n / (2.0 * (n - y.sum())))
    xa = np.hstack([x, np.ones((n, 1))])
    beta, reg = np.zeros(xa.shape[1]), np.eye(xa.shape[1])
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-xa @ beta))
        h = C * (xa * (w * p * (1 - p))[:, None]).T @ xa + reg
        beta -= np.linalg.solve(h, C * xa.T @ (w * (p - y)) + reg @ beta)
    return beta


@pytest.fixture(scope="module")
def training(spark):
    n = 6
    data, frame = vectors(spark, n, 500, seed=1)
    keyed = MD.with_split_key(frame).cache()
    cat = catalogue(spark, n)
    limits = MD.split_thresholds(keyed, cat)
    return n, data, keyed, cat, limits, expected_split(data, n)


def reference(data, split, n, i, C, features):
    use = [(base, owned) for c, base, owned in data if None not in base and split[c, 1000 + 3 * i][1] == "train"]
    x = np.array([base + [float(j in owned) for j in range(n)] for base, owned in use])
    return newton(x[:, features], x[:, SC.N_BASE + i], C)


def test_training_matches_numpy(spark, training, monkeypatch):
    n, data, keyed, cat, limits, split = training
    for bytes_ in (MD.GRAM_BYTES, 1):  # one block of products, and a block each
        monkeypatch.setattr(MD, "GRAM_BYTES", bytes_)
        for m in MD.train_models(keyed, limits, cat, C=2.0).collect():
            i = (m.prod_id - 1000) // 3
            features = [j for j in range(SC.N_BASE + n) if j != SC.N_BASE + i]
            got = [m.weights[j] for j in features] + [m.intercept]
            assert m.weights[SC.N_BASE + i] is None and m.steps < 15
            assert np.allclose(got, reference(data, split, n, i, 2.0, features), atol=1e-6)


def test_single_product_with_a_feature_list(spark, training):
    n, data, keyed, cat, limits, split = training
    names = ["revenue", "credit_score", "has_1000", "has_1009"]
    m, = MD.train_models(keyed, limits, cat, C=1.0, feature_map={1003: names}).collect()
    features = [1, 2, SC.N_BASE, SC.N_BASE + 3]
    want = reference(data, split, n, 1, 1.0, features)
    assert m.prod_id == 1003 and np.allclose([m.weights[j] for j in features] + [m.intercept], want, atol=1e-6)
    assert sum(w is not None for w in m.weights) == 4


def test_certificate_turns_red_on_a_small_change(spark, training):
    _, _, keyed, cat, limits, _ = training
    models = MD.train_models(keyed, limits, cat)
    good = {r.prod_id: r for r in MD.optimality(keyed, models, limits, cat).collect()}
    assert len(good) == 6 and all(r.optimal for r in good.values())
    changed = models.withColumn("weights", F.when(F.col("prod_id") == 1006, F.transform(
        "weights", lambda w, j: F.when(j == 1, w + 1e-3).otherwise(w))).otherwise(F.col("weights")))
    bad = {r.prod_id: r.optimal for r in MD.optimality(keyed, changed, limits, cat).collect()}
    assert bad == {p: p != 1006 for p in good}


def test_one_class_gives_no_model(spark, training):
    _, _, keyed, cat, _, _ = training
    nobody = keyed.withColumn("owned", F.filter("owned", lambda j: j != 2))
    limits = MD.split_thresholds(nobody, cat)
    ids = {r.prod_id for r in MD.train_models(nobody, limits, cat).collect()}
    assert 1006 not in ids and len(ids) == 5


def test_importance_ranks_by_size(spark):
    cat = catalogue(spark, 2)
    models = spark.createDataFrame([(1000, 0.5, [1.0, -3.0, 1.0, None, 0.0])], "prod_id int, intercept double, weights array<double>")
    got = [(r.feature, r["rank"], r.direction) for r in MD.feature_importance(models, cat).orderBy("rank").collect()]
    assert got == [("revenue", 1, "down"), ("age_bucket_encoded", 2, "up"), ("credit_score", 3, "up"), ("has_1003", 4, "down")]
    long = rows(MD.model_table(models, cat))
    assert (1000, "(intercept)", 0.5) in long and len(long) == 5
