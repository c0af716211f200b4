"""Split (M4), training (M5, M6), evaluation (M9-M12), importance.

Customers are vectors (:mod:`ledgerlens.operators.scoring`): ``base``, ``owned`` and
a ``split_key``.  The split is a threshold on that key per product and class, so a
row knows its own split, and training and evaluation need no join.

Training minimises the L2-regularised, class-balanced logistic loss by Newton's
method for all products at once: a step is one scan of the vectors, in which a task
adds up gradients and Gram matrices, and one small solve per product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.scoring import MAX_CATALOGUE, N_BASE, ModelMatrix, candidate_arrays, feature_table, model_matrix
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded, constant, scratch_path

#: Bits of the split key, and of the buckets in which customers are counted.
KEY_BITS, BUCKET_BITS = 60, 12


# ------------------------------------------------------------------- split ---
def with_split_key(vectors: DataFrame, seed: int = 42, id_col: str = "cust_id") -> DataFrame:
    """Adds ``split_key``: the first 60 bits of md5('<seed>:<id>')."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return vectors.withColumn("split_key", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint"))


def split_thresholds(vectors: DataFrame, catalogue: DataFrame, test_fraction: float = 0.2,
                     bits: int = BUCKET_BITS) -> DataFrame:
    """M4: ``prod_id, pos, label, rows, n_test, threshold`` per product and class: the
    customers of a class whose ``split_key`` is at most the threshold are its test part.

    The test part of a product has ``ceil(test_fraction * customers)`` rows over both
    classes, apportioned to them by largest remainder (ties: the smaller label).  The
    threshold is the n_test-th smallest key of the class, found exactly: one scan
    counts customers and owners by key bucket, and only the rows of the one boundary
    bucket of each class are ranked.  Written once; a row per product and class."""
    spark = vectors.sparkSession
    bucket = F.shiftright("split_key", KEY_BITS - bits)
    counted = vectors.select(bucket.alias("bucket"), F.explode(F.concat(F.array(F.lit(-1)), "owned")).alias("pos")).groupBy(
        "pos", "bucket").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "split_counts")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    everyone = counted.filter("pos = -1").select("bucket", F.col("n").alias("all"))
    n_products = catalogue.agg(F.count("*").cast("int").alias("n")).scalar()
    grid = everyone.select("bucket", "all", F.explode(F.sequence(F.lit(0), n_products - 1)).alias("pos"))
    both = grid.join(counted.filter("pos >= 0"), ["pos", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    classes = both.select("pos", "bucket", F.inline(F.array(
        F.struct(F.lit(0).alias("label"), (F.col("all") - F.col("n")).alias("n")),
        F.struct(F.lit(1).alias("label"), F.col("n").alias("n")))))
    sizes = classes.groupBy("pos", "label").agg(F.sum("n").alias("rows"))
    product = Window.partitionBy("pos")
    wanted = F.ceil(F.col("total") * F.lit(test_fraction)).cast("bigint")
    sizes = sizes.withColumn("total", F.sum("rows").over(product)).withColumn("wanted", wanted).withColumns(
        {"quota": F.expr("(rows * wanted) div total"), "rest": F.expr("(rows * wanted) % total")})
    place = F.row_number().over(product.orderBy(F.desc("rest"), "label"))
    sizes = sizes.withColumn("place", place).withColumn("missing", F.col("wanted") - F.sum("quota").over(product))
    sizes = sizes.select("pos", "label", "rows", (F.col("quota") + (F.col("place") <= F.col("missing")).cast("bigint")).alias("n_test"))
    before = Window.partitionBy("pos", "label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = classes.join(sizes, ["pos", "label"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edges = edges.filter("before < n_test AND n_test <= before + n").select(
        "bucket", "pos", "label", (F.col("n_test") - F.col("before")).alias("nth"))
    near = vectors.select("split_key", bucket.alias("bucket"), "owned").join(
        broadcast_bounded(edges, 2 * MAX_CATALOGUE), "bucket").filter(
        F.array_contains("owned", F.col("pos")).cast("int") == F.col("label"))
    nth = F.row_number().over(Window.partitionBy("pos", "label").orderBy("split_key"))
    found = near.withColumn("_nth", nth).filter("_nth = nth").select("pos", "label", F.col("split_key").alias("threshold"))
    out = sizes.join(found, ["pos", "label"], "left").join(catalogue.select("pos", "prod_id"), "pos").select(
        "prod_id", "pos", "label", "rows", "n_test", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    path = scratch_path(spark, "split_thresholds")
    out.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def threshold_row(thresholds: DataFrame) -> dict:
    """The thresholds as constants: arrays ``t0`` and ``t1`` by catalogue position (two
    numbers per product)."""
    both = thresholds.groupBy("pos").agg(F.max(F.when(F.col("label") == 0, F.col("threshold"))).alias("t0"),
                                         F.max(F.when(F.col("label") == 1, F.col("threshold"))).alias("t1"))
    rows = both.orderBy("pos").limit(MAX_CATALOGUE).collect()
    return {name: constant([r[name] for r in rows], "array<bigint>") for name in ("t0", "t1")}


def _split(t, pos, label):
    limit = F.when(label == 1, t["t1"][pos]).otherwise(t["t0"][pos])
    return F.when(F.col("split_key") <= limit, "test").otherwise("train")


def product_splits(vectors: DataFrame, thresholds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``cust_id, prod_id, label, split`` of every customer and product, row by row."""
    t = threshold_row(thresholds)
    ids = constant([int(r[0]) for r in catalogue.orderBy("pos").select("prod_id").limit(MAX_CATALOGUE).collect()], "array<int>")

    def row(p, i):
        label = F.array_contains("owned", i).cast("int")
        return F.struct(p.alias("prod_id"), label.alias("label"), _split(t, i, label).alias("split"))

    return vectors.select("cust_id", F.inline(F.transform(ids, row)))


# ---------------------------------------------------------------- training ---
@dataclass
class _State:
    """What a scan needs of the products that are being fitted."""

    pos: np.ndarray        # catalogue positions
    weights: np.ndarray    # product x (feature, constant)
    used: np.ndarray       # which of them take part
    limits: np.ndarray     # split thresholds of both classes
    balance: np.ndarray    # weights of both classes


def _gram(sent):
    """Loss, gradient and Gram matrix of each product over a task's rows."""
    def add_up(batches):
        state = sent.value
        n = state.weights.shape[1]
        loss, slope = np.zeros(len(state.pos)), np.zeros((len(state.pos), n))
        gram = np.zeros((len(state.pos), n, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                x, key = _design(batch.slice(lo, 2048), n)
                y = x[:, N_BASE + state.pos]
                own = y.astype(np.int64)
                limit = state.limits[np.arange(len(state.pos)), own]
                weight = np.where(key[:, None] > limit, state.balance[np.arange(len(state.pos)), own], 0.0)
                z = x @ state.weights.T
                chance = 1 / (1 + np.exp(-z))
                loss += (weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum(axis=0)
                slope += (weight * (chance - y)).T @ x
                curve = weight * chance * (1 - chance)
                for k in range(len(state.pos)):
                    gram[k] += (x.T * curve[:, k]) @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(state.pos, pa.int32()), pa.array([np.concatenate([[loss[k]], slope[k], gram[k].reshape(-1)]).tobytes()
                                                        for k in range(len(state.pos))])], names=["pos", "sums"])

    return add_up


def _design(batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base features, flags and a constant of each row; the split keys."""
    x = np.zeros((batch.num_rows, n))
    x[:, -1] = 1
    x[:, :N_BASE] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_BASE)
    owned = batch.column(1)
    sizes = np.diff(owned.offsets.to_numpy())
    x[np.repeat(np.arange(batch.num_rows), sizes), N_BASE + owned.flatten().to_numpy()] = 1
    return x, batch.column(2).to_numpy()


def _solve(sent, ridge: float):
    """Adds up a product's sums and solves for its Newton step: position, objective,
    largest slope, step."""
    def solve(batches):
        state = sent.value
        n = state.weights.shape[1]
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add = np.frombuffer(sums)
                total[pos] = total[pos] + add if pos in total else add
        for pos, sums in total.items():
            k = int(np.searchsorted(state.pos, pos))
            w, used = state.weights[k], state.used[k]
            decay = np.full(n, ridge)
            decay[-1] = 0
            slope = (sums[1 : n + 1] + decay * w)[used]
            gram = sums[n + 1 :].reshape(n, n) + np.diag(decay)
            step = np.zeros(n)
            step[used] = -np.linalg.lstsq(gram[np.ix_(used, used)], slope, rcond=None)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pos], pa.int32()), pa.array([sums[0] + 0.5 * float(decay @ (w * w))]),
                 pa.array([float(np.abs(slope).max())]), pa.array([step.tobytes()])],
                names=["pos", "objective", "slope", "step"])

    return solve


def complete(vectors: DataFrame) -> DataFrame:
    """The vectors without an unknown base feature: those that training can use."""
    return vectors.filter(F.forall("base", lambda x: x.isNotNull()))


def training_counts(vectors: DataFrame, thresholds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``prod_id, train_rows, positives`` of the rows that train each product."""
    rows = product_splits(complete(vectors), thresholds, catalogue).filter("split = 'train'")
    return rows.groupBy("prod_id").agg(F.count("*").alias("train_rows"), F.sum("label").alias("positives"))


MODEL_SCHEMA = ("prod_id int, intercept double, weights array<double>, train_rows bigint, positives bigint, C double, "
                "objective double, steps int")
#: Bytes of Gram matrices that a task adds up.
GRAM_BYTES = 64 << 20


def train_models(vectors: DataFrame, thresholds: DataFrame, catalogue: DataFrame, C: float = 2.0,
                 feature_map: dict | None = None, max_steps: int = 60, tol: float = 1e-10) -> DataFrame:
    """M6 (and M5 with a one-product ``feature_map``: product -> feature names): one
    balanced logistic regression per product on its train part.

    Rows with ``prod_id, intercept, weights`` (aligned with the features, null where a
    feature takes no part), the class counts, the objective and the number of steps; no
    row for a product whose train part has one class only.  All products share the
    scans, in blocks whose Gram matrices fit ``GRAM_BYTES``.  A step that does not lower
    a product's objective is halved."""
    spark = vectors.sparkSession
    rows = complete(vectors).select("base", "owned", "split_key")
    ids = [r[0] for r in catalogue.orderBy("pos").select("prod_id").collect()]
    names = [f"has_{p}" for p in ids]
    place = {f: i for i, f in enumerate([*R.BASE_FEATURES, *names])}
    counts = {r.prod_id: (r.train_rows, r.positives) for r in training_counts(vectors, thresholds, catalogue).collect()}
    limits = np.full((len(ids), 2), -1, np.int64)
    for r in thresholds.collect():
        limits[r.pos, r.label] = r.threshold
    n = N_BASE + len(ids) + 1
    wanted = [i for i, p in enumerate(ids) if (feature_map is None or p in feature_map)
              and 0 < counts.get(p, (0, 0))[1] < counts[p][0]]
    per_block = max(1, GRAM_BYTES // (8 * n * n))
    fitted = []
    for lo in range(0, len(wanted), per_block):
        pos = np.array(wanted[lo : lo + per_block])
        used = np.ones((len(pos), n), bool)
        for k, i in enumerate(pos):
            if feature_map:
                used[k, :-1] = False
                used[k, [place[f] for f in feature_map[ids[i]]]] = True
            used[k, N_BASE + i] = False
        sizes = np.array([counts[ids[i]] for i in pos], float)
        balance = np.stack([sizes[:, 0] / (2 * (sizes[:, 0] - sizes[:, 1])), sizes[:, 0] / (2 * sizes[:, 1])], axis=1)
        state = _State(pos, np.zeros((len(pos), n)), used, limits[pos], balance)
        fitted += _newton(rows, state, 1 / C, sizes[:, 0], max_steps, tol)
    out = []
    for i, w, used, objective, steps in fitted:
        kept = [float(x) if ok else None for x, ok in zip(w[:-1], used[:-1], strict=True)]
        out.append((int(ids[i]), float(w[-1]), kept, *map(int, counts[ids[i]]), float(C), float(objective), steps))
    path = scratch_path(spark, "models")
    spark.createDataFrame(out, MODEL_SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def _newton(rows: DataFrame, state: _State, ridge: float, sizes: np.ndarray, max_steps: int, tol: float):
    """Newton steps until every product's largest slope is below ``tol`` a row."""
    spark = rows.sparkSession
    best = state.weights.copy()
    lowest, step = np.full(len(best), np.inf), np.zeros_like(best)
    steps, done = np.zeros(len(best), int), np.zeros(len(best), bool)
    for _ in range(max_steps):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        part = _State(*(a[open_] for a in (state.pos, state.weights, state.used, state.limits, state.balance)))
        sent = spark.sparkContext.broadcast(part)
        sums = rows.mapInArrow(_gram(sent), "pos int, sums binary")
        solved = sums.repartition("pos").mapInArrow(_solve(sent, ridge), "pos int, objective double, slope double, step binary")
        for r in solved.collect():  # a row per product
            k = int(np.searchsorted(state.pos, r.pos))
            steps[k] += 1
            if r.objective <= lowest[k] + 1e-12 * abs(r.objective):
                best[k], lowest[k], step[k] = state.weights[k], r.objective, np.frombuffer(r.step)
                done[k] = r.slope <= tol * sizes[k]
            else:
                step[k] /= 2
                done[k] = np.abs(step[k]).max() < 1e-15
            state.weights[k] = best[k] if done[k] else best[k] + step[k]
        sent.unpersist()
    return [(int(p), best[k], state.used[k], lowest[k], int(steps[k])) for k, p in enumerate(state.pos)]


def optimality(vectors: DataFrame, models: DataFrame, thresholds: DataFrame, catalogue: DataFrame,
               tol: float = 1e-8) -> DataFrame:
    """Certificate of the training: ``prod_id, train_rows, positives, residual, optimal``.

    At the minimum of the balanced objective its gradient vanishes.  The gradient is
    computed here in plain DataFrame operations, apart from the training code: every
    customer's residual per product, spread over the customer's non-zero features and
    summed by product and feature.  ``residual`` is its largest entry a training row."""
    matrix = model_matrix(catalogue, models)
    m, t = matrix, threshold_row(thresholds)
    told = catalogue.join(models.select("prod_id", "train_rows", "positives", "C"), "prod_id", "left")
    rows = told.orderBy("pos").collect()
    sizes = {"n": constant([r.train_rows for r in rows], "array<bigint>"),
             "own": constant([r.positives for r in rows], "array<bigint>")}

    def residual(w, i):
        label = F.array_contains("owned", i).cast("int")
        z = F.aggregate("_x", m["intercepts"][i], lambda acc, x: acc + F.coalesce(w[x["idx"]], F.lit(0.0)) * x["x"])
        n, own = sizes["n"][i].cast("double"), sizes["own"][i].cast("double")
        balance = n / (F.lit(2.0) * F.when(label == 1, own).otherwise(n - own))
        return F.struct(i.alias("pos"), F.when(m["has_model"][i] & (_split(t, i, label) == "train"), balance * (
            F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - label)).alias("r"))

    sparse = F.concat(F.transform("base", lambda x, i: F.struct(i.alias("idx"), x.alias("x"))),
                      F.transform("owned", lambda j: F.struct((j + N_BASE).alias("idx"), F.lit(1.0).alias("x"))))
    rows = complete(vectors).select("owned", "split_key", sparse.alias("_x"))
    rows = rows.select("_x", F.filter(F.transform(m["weights"], residual), lambda r: r["r"].isNotNull()).alias("_r"))
    spread = rows.select("_x", F.inline("_r")).select(
        "pos", "r", F.inline(F.concat("_x", F.array(F.struct(F.lit(-1).alias("idx"), F.lit(1.0).alias("x"))))))
    slopes = spread.groupBy("pos", "idx").agg(F.sum(F.col("r") * F.col("x")).alias("slope"))
    weights = told.join(models.select("prod_id", "weights"), "prod_id").select(
        "pos", "C", F.posexplode("weights").alias("idx", "w")).filter("w IS NOT NULL")
    intercepts = told.filter("C IS NOT NULL").select("pos", "C", F.lit(-1).alias("idx"), F.lit(0.0).alias("w"))
    entries = weights.unionByName(intercepts).join(slopes, ["pos", "idx"], "left")
    worst = entries.groupBy("pos").agg(F.max(F.abs(F.coalesce("slope", F.lit(0.0)) + F.col("w") / F.col("C"))).alias("worst"))
    return told.join(worst, "pos").select(
        "prod_id", "train_rows", "positives", (F.col("worst") / F.col("train_rows")).alias("residual"),
        (F.col("worst") <= F.lit(tol) * F.col("train_rows")).alias("optimal"))


# -------------------------------------------------------------- evaluation ---
def predictions(vectors: DataFrame, matrix: ModelMatrix, thresholds: DataFrame) -> DataFrame:
    """``cust_id, prod_id, score, label, split, pred``: label, split and score all stand
    on the customer's row."""
    t = threshold_row(thresholds)
    scored = candidate_arrays(vectors, matrix, keep=("split_key",))
    rows = F.transform("cands", lambda x: F.struct(
        x["prod_id"].alias("prod_id"), x["score"].alias("score"), x["owned"].alias("label"),
        _split(t, x["pos"], x["owned"]).alias("split"), (x["score"] > F.lit(0.5)).cast("int").alias("pred")))
    return scored.select("cust_id", F.inline(rows))


def accuracy(pred: DataFrame) -> DataFrame:
    """M9: accuracy per product and split (threshold 0.5)."""
    return pred.groupBy("prod_id", "split").agg(
        (F.count(F.when(F.col("pred") == F.col("label"), 1)).cast("double")
         / F.count(F.lit(1)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"))


def confusion(pred: DataFrame, split: str = "test") -> DataFrame:
    """Counts per (product, actual, predicted) on one split."""
    return pred.where(F.col("split") == split).groupBy("prod_id", "label", "pred").agg(
        F.count(F.lit(1)).alias("n"))


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def report(pred: DataFrame, split: str = "test") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and
    support-weighted averages; zero denominators give 0."""
    t = pred.where(F.col("split") == split)
    c = F.col
    agg = t.groupBy("prod_id").agg(
        F.count(F.when((c("label") == 1) & (c("pred") == 1), 1)).alias("tp1"),
        F.count(F.when((c("label") == 0) & (c("pred") == 1), 1)).alias("fp1"),
        F.count(F.when((c("label") == 1) & (c("pred") == 0), 1)).alias("fn1"),
        F.count(F.when((c("label") == 0) & (c("pred") == 0), 1)).alias("tp0"))
    rows = []
    for cls, tp, fp, fn in (("0", c("tp0"), c("fn1"), c("fp1")), ("1", c("tp1"), c("fp1"), c("fn1"))):
        rows.append(F.struct(F.lit(cls).alias("class"), _ratio(tp, tp + fp).alias("precision"),
                             _ratio(tp, tp + fn).alias("recall"),
                             _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"), (tp + fn).alias("support")))
    per = agg.select("prod_id", F.inline(F.array(*rows)))
    w = per.groupBy("prod_id").agg(
        F.sum("support").alias("support"),
        F.sort_array(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("_c"))
    c0, c1 = F.col("_c")[0], F.col("_c")[1]
    n = F.col("support")
    macro = F.struct(F.lit("macro avg").alias("class"),
                     ((c0["precision"] + c1["precision"]) / F.lit(2.0)).alias("precision"),
                     ((c0["recall"] + c1["recall"]) / F.lit(2.0)).alias("recall"),
                     ((c0["f1"] + c1["f1"]) / F.lit(2.0)).alias("f1"), n.alias("support"))

    def wavg(k):
        return _ratio(c0[k] * c0["support"] + c1[k] * c1["support"], n)
    weighted = F.struct(F.lit("weighted avg").alias("class"), wavg("precision").alias("precision"),
                        wavg("recall").alias("recall"), wavg("f1").alias("f1"), n.alias("support"))
    avgs = w.select("prod_id", F.inline(F.array(macro, weighted)))
    return per.unionByName(avgs)


def auc(pred: DataFrame, split: str = "test") -> DataFrame:
    """ROC-AUC per product (Mann-Whitney with mid-ranks for ties).

    AUC = sum_v pos(v) * (2 * neg_below(v) + neg(v)) / (2 * P * N), over the
    distinct-score histogram; integer sums, one division.
    """
    t = pred.where(F.col("split") == split)
    hist = t.groupBy("prod_id", "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    w = Window.partitionBy("prod_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    agg = hist.groupBy("prod_id").agg(
        F.sum(F.col("pos") * (F.col("neg_below") * 2 + F.col("neg"))).alias("_num"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    den = F.col("positives") * F.col("negatives") * 2
    return agg.select("prod_id", "positives", "negatives",
                      F.when(den == 0, F.lit(None).cast("double"))
                       .otherwise(F.col("_num").cast("double") / den.cast("double")).alias("auc"))


def feature_importance(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Coefficients per product ranked by absolute value (ties in feature order)."""
    named = models.select("prod_id", F.posexplode("weights").alias("idx", "coefficient")).filter("coefficient IS NOT NULL").join(
        broadcast_bounded(feature_table(catalogue).select("idx", "feature"), MAX_CATALOGUE), "idx")
    w = Window.partitionBy("prod_id").orderBy(F.abs("coefficient").desc(), "idx")
    return named.select(
        "prod_id", "feature", "coefficient", F.abs("coefficient").alias("abs_coefficient"),
        F.row_number().over(w).alias("rank"),
        F.when(F.col("coefficient") > 0, "up").otherwise("down").alias("direction"))


def model_table(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Long form ``prod_id, feature, coefficient``; intercepts as feature '(intercept)'."""
    long = feature_importance(models, catalogue).select("prod_id", "feature", "coefficient")
    return long.unionByName(models.select("prod_id", F.lit("(intercept)").alias("feature"), F.col("intercept").alias("coefficient")))
