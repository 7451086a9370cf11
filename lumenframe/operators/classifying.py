"""Classifiers compared on whole groups held out. A features table is (id, g, label, x): x an array, g the group that stays together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fixed_rows
from . import learning as L
from .quantiles import quantiles

MAX_CLASSES = 1000


def group_split(rows: DataFrame, share: float = 0.3, tries: int = 60) -> tuple[DataFrame, DataFrame, int | None]:
    """(train, test, try): whole groups by hash, the first of ``tries`` draws in which both sides hold two classes or more and
    every class of the test side is known to the training side. Without such a draw both sides are empty and the try is null.

    All draws are judged by one aggregate over (group, label).
    """
    rows = rows.where("label IS NOT NULL AND g IS NOT NULL")
    held = rows.select("g", "label").distinct()
    side = lambda t: F.pmod(F.xxhash64("g", t), F.lit(1000)) < int(1000 * share)
    seen = held.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).groupBy("t", "label").agg(F.max(side(F.col("t")).cast("int")).alias("test"), F.max((~side(F.col("t"))).cast("int")).alias("train"))
    good = seen.groupBy("t").agg(F.sum("train").alias("a"), F.sum("test").alias("b"), F.max((F.col("test") > F.col("train")).cast("int")).alias("new")).where("a > 1 AND b > 1 AND new = 0")
    t = good.agg(F.min("t")).first()[0]
    if t is None:
        return rows.limit(0), rows.limit(0), None
    on = side(F.lit(t))
    return rows.where(~on), rows.where(on), t


def _sums(train: DataFrame, labels: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, X'X) of each class."""
    place = {c: i for i, c in enumerate(labels)}

    def part(pdf):
        x, out = np.stack(pdf["x"].to_numpy()).astype(float), np.zeros((len(place), 1 + n + n * n))
        at = pdf["label"].map(place).to_numpy()
        for i in np.unique(at):
            own = x[at == i]
            out[i] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        return out.ravel()

    got = L.task_sums(train, ["label", "x"], part, len(labels) * (1 + n + n * n)).reshape(len(labels), -1)
    return got[:, 0], got[:, 1 : n + 1], got[:, n + 1 :].reshape(-1, n, n)


def _by_score(test: DataFrame, labels: list[str], score) -> DataFrame:
    """(truth, guess): the label of the highest column of ``score(X)``, ties to the first."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                s = np.round(score(np.stack(pdf["x"].to_numpy()).astype(float)), 9)
                yield pdf[["label"]].rename(columns={"label": "truth"}).assign(guess=[labels[i] for i in s.argmax(1)])

    return test.select("label", "x").mapInPandas(run, "truth string, guess string")


def closed_forms(train: DataFrame, test: DataFrame, labels: list[str], n: int) -> dict[str, DataFrame]:
    """(truth, guess) of the classifiers that need nothing but each class's count, sum and X'X: one pass over the training rows."""
    c, s, g = _sums(train, labels, n)
    mean, every = s / np.maximum(c, 1)[:, None], c.sum()
    prior = np.log(np.maximum(c, 1e-300) / every)
    cov = [g[i] / max(c[i], 1) - np.outer(mean[i], mean[i]) for i in range(len(labels))]
    pooled = sum(c[i] * cov[i] for i in range(len(labels))) / every + 1e-6 * np.eye(n)
    inv = np.linalg.inv(pooled)
    full = np.zeros((n + 1, n + 1))
    full[0, 0], full[0, 1:], full[1:, 0], full[1:, 1:] = every, s.sum(0), s.sum(0), g.sum(0)
    target = np.concatenate([2 * c - every, (2 * s - s.sum(0)).ravel()])  # +1 in the class, -1 outside
    weights = np.linalg.solve(full + np.diag([0.0] + [1.0] * n), np.concatenate([target[: len(c)][None], target[len(c) :].reshape(len(c), n).T]))
    wide = [0.9 * v + 0.1 * pooled for v in cov]
    inverses, dets = [np.linalg.inv(v) for v in wide], [np.linalg.slogdet(v)[1] for v in wide]
    var = np.maximum(np.array([np.diag(v) for v in cov]), 1e-9)
    far = lambda x, i, m: np.einsum("nd,de,ne->n", x - mean[i], m, x - mean[i])
    forms = {
        "nearest_centroid": lambda x: -((x[:, None, :] - mean) ** 2).sum(2),
        "ridge": lambda x: weights[0] + x @ weights[1:],
        "lda": lambda x: np.stack([prior[i] - 0.5 * far(x, i, inv) for i in range(len(labels))], 1),
        "qda": lambda x: np.stack([prior[i] - 0.5 * (far(x, i, inverses[i]) + dets[i]) for i in range(len(labels))], 1),
        "gaussian_bayes": lambda x: prior - 0.5 * (((x[:, None, :] - mean) ** 2 / var).sum(2) + np.log(var).sum(1)),
    }
    return {name: _by_score(test, labels, f) for name, f in forms.items()}


def bernoulli_bayes(train: DataFrame, test: DataFrame, labels: list[str], n: int) -> DataFrame:
    """(truth, guess): naive Bayes on which features lie above 0, with one count added to each cell."""
    sign = lambda df: df.withColumn("x", F.transform("x", lambda v: (v > 0).cast("double")))
    c, s, _ = _sums(sign(train), labels, n)
    p = (s + 1) / (c + 2)[:, None]
    prior = np.log(np.maximum(c, 1e-300) / c.sum())
    return _by_score(sign(test), labels, lambda x: prior + x @ np.log(p).T + (1 - x) @ np.log1p(-p).T)


def boosted_and_linear(binary: bool, classes: int, n: int) -> dict:
    """The estimators of ``pyspark.ml`` by name."""
    from pyspark.ml import classification as M

    rest = lambda m: m if binary else M.OneVsRest(classifier=m)
    return {
        "logistic": M.LogisticRegression(maxIter=50, regParam=1e-3), "linear_svc": rest(M.LinearSVC(maxIter=30, regParam=1e-3)), "tree": M.DecisionTreeClassifier(maxDepth=8, seed=1),
        "forest": M.RandomForestClassifier(numTrees=40, maxDepth=8, seed=1), "bagging": M.RandomForestClassifier(numTrees=20, maxDepth=8, featureSubsetStrategy="all", seed=1),
        "boosted": rest(M.GBTClassifier(maxIter=15, maxDepth=4, seed=1)), "perceptron": M.MultilayerPerceptronClassifier(layers=[n, 32, classes], maxIter=60, seed=1),
    }


def compare(rows: DataFrame) -> DataFrame:
    """(model, n, accuracy, balanced_accuracy, f1_weighted, beats): every classifier on the held-out groups, best first.

    Groups that cannot be split give no row. ``beats`` tells whether a model is better than the majority of the training labels; features are standardised on the training rows.
    """
    from pyspark.ml.functions import array_to_vector

    train, test, drawn = group_split(rows)
    if drawn is None:
        return rows.sparkSession.createDataFrame([], "model string, n long, accuracy double, balanced_accuracy double, f1_weighted double, beats boolean")
    train, test = cut(train), cut(test)
    labels = sorted(r[0] for r in fixed_rows(train.select("label").distinct(), MAX_CLASSES))
    n = train.select(F.size("x")).first()[0]
    everyone = train.withColumn("label", F.lit("all"))
    c, s, g = _sums(everyone, ["all"], n)
    mean = s[0] / c[0]
    sd = np.sqrt(np.maximum(np.diag(g[0]) / c[0] - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    scale = lambda df: cut(df.withColumn("x", F.zip_with(F.zip_with("x", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b), F.array(*[F.lit(float(v)) for v in sd]), lambda a, b: a / b)))
    train, test = scale(train), scale(test)
    top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    guesses = {"majority": test.select(F.col("label").alias("truth"), F.lit(top).alias("guess"))}
    guesses |= closed_forms(train, test, labels, n) | {"bernoulli_bayes": bernoulli_bayes(train, test, labels, n)}
    number = F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, float(i))])
    name = F.array(*[F.lit(c) for c in labels])
    tr, te = (df.select("label", number[F.col("label")].alias("y"), array_to_vector("x").alias("v")) for df in (train, test))
    for m, est in boosted_and_linear(len(labels) == 2, len(labels), n).items():
        model = est.setFeaturesCol("v").setLabelCol("y").fit(tr)
        guesses[m] = model.transform(te).select(F.col("label").alias("truth"), F.get(name, F.col("prediction").cast("int")).alias("guess"))
    out = None
    for m, df in guesses.items():
        one = L.scores(df).select(F.lit(m).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    base = out.where("model = 'majority'").first()["accuracy"] or 0.0
    return out.withColumn("beats", F.col("accuracy") > base).orderBy(F.desc("accuracy"), "model")


def baseline_summary(table: DataFrame) -> DataFrame:
    """(baseline, best, best_model, beating): the table of ``compare`` in one row."""
    acc = lambda w: F.max(F.when(w, F.col("accuracy")))
    own = F.col("model") == "majority"
    return table.agg(acc(own).alias("baseline"), acc(~own).alias("best"), F.max_by("model", F.struct(F.when(~own, F.col("accuracy")).alias("a"), "model")).alias("best_model"), F.sum((F.col("beats") & ~own).cast("int")).alias("beating"))
