"""Classifier fits over embedding tables and their scoring."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.scalars import argmax, as_doubles, hash_unit, linear_logits, seeded_hash, softmax
from tilescope.operators import metrics as M
from tilescope.operators.blocks import matrix, wire_type
from tilescope.operators.embedding import standardize
from tilescope.operators.ordering import hash_sample
from tilescope.session import small_side

#: Bytes of training rows that a minibatch fit shuffles in memory at once; a few times that is what its task holds.
PILE_BYTES = 64 << 20


@dataclass(frozen=True)
class LinearModel:
    """K x d weights and K intercepts."""

    coef: np.ndarray
    intercept: np.ndarray

    def columns(self) -> tuple[Column, Column]:
        return (F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.coef]),
                F.array(*[F.lit(float(v)) for v in self.intercept]))


def score_linear(df: DataFrame, model: LinearModel, f: str = "f") -> DataFrame:
    """Add logits, prob and pred."""
    w, b = model.columns()
    return (df.withColumn("logits", linear_logits(f, w, b)).withColumn("prob", softmax("logits"))
            .withColumn("pred", argmax("logits")))


def evaluate_probe(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Accuracy over supported classes and kappa per key from predictions."""
    return _evaluate_counts(M.pair_counts(scored, keys), keys, k)


def _evaluate_counts(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    acc = M.balanced_accuracy(M.class_metrics(counts, keys, k), keys)
    kap = M.kappa(counts, keys, k).select(*keys, "n", "kappa")
    if not keys:
        both = acc.withColumn("_k", kap.select(F.struct("n", "kappa")).scalar())
        return both.select(*acc.columns, "_k.n", "_k.kappa")
    return acc.join(kap, keys)


def _with_weights(train: DataFrame, k: int, balanced: bool) -> DataFrame:
    """With the weight of each row's class as ``_w``, as it is where it has that column."""
    if "_w" in train.columns:
        return train
    if not balanced:
        return train.withColumn("_w", F.lit(1.0))
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"))
    weights = counts.withColumn("_w", total.scalar() / (F.col("_n").cast("double") * k)).select("label", "_w")
    return train.join(small_side(weights), "label")


def few_partitions(rows: DataFrame, n: int) -> DataFrame:
    """Iterative fits pay per task: at most one partition per 4,096 rows."""
    return rows.coalesce(max(1, math.ceil(n / 4096)))


def fit_logistic(train: DataFrame, k: int, c: float = 1.0, balanced: bool = True, f: str = "f", max_iter: int = 200,
                 tol: float = 1e-7) -> LinearModel:
    """Distributed L-BFGS on weighted mean NLL + |W|^2 / (2 C S), S the weight sum; intercepts free."""
    rows = _with_weights(train, k, balanced).select(
        F.col("label").cast("double").alias("label"), "_w", array_to_vector(as_doubles(f)).alias("features"))
    rows.persist()
    try:
        n, s = rows.agg(F.count(F.lit(1)), F.sum("_w")).first()
        fit = LogisticRegression(family="multinomial", weightCol="_w", standardization=False, elasticNetParam=0.0,
                                 regParam=1.0 / (c * s), maxIter=max_iter, tol=tol).fit(few_partitions(rows, n))
    finally:
        rows.unpersist()
    return LinearModel(fit.coefficientMatrix.toArray(), np.asarray(fit.interceptVector.toArray()))


def fit_grid(features: DataFrame, k: int, folds: list[int], scalings: list[bool], penalties: list[float],
             parallel: int = 8, max_iter: int = 100, tol: float = 1e-5) -> DataFrame:
    """Every fold x scaling x penalty cell, each a distributed fit scored on its test rows.

    Reads fold, role, label, f. The driver loops over the design (a few dozen cells), never over
    data, and keeps one result row per cell. Rows of a fold and scaling are read, scaled and weighted once
    and kept for the fits, scores and gradients of all penalties.
    """
    spark = features.sparkSession
    beside = max(1, min(len(penalties), parallel))  # cells of a group at a time; ``parallel`` of all groups

    def one(group):
        fold, scaled = group
        rows = features.where((F.col("fold") == fold) & F.col("role").isin("train", "test"))
        if scaled:
            rows = standardize(rows, rows.where("role = 'train'"))
        rows = rows.select("role", "label", "f").persist()
        try:
            train, test = _with_weights(rows.where("role = 'train'"), k, True), rows.where("role = 'test'")
            with ThreadPoolExecutor(beside) as inner:
                return list(inner.map(lambda c: cell(train, test, fold, scaled, c), penalties))
        finally:
            rows.unpersist()

    def cell(train, test, fold, scaled, c):
        model = fit_logistic(train, k, c, max_iter=max_iter, tol=tol)
        counts = M.pair_counts(score_linear(test, model), [])
        counts = spark.createDataFrame(counts.collect(), counts.schema)  # K x K numbers
        score = _evaluate_counts(counts, [], k).first()
        grad = loss_gradient(train, model, k, c).first()
        return (fold, scaled, c, score["n"], score["balanced_accuracy"], score["kappa"], grad["loss"], grad["gradient_max"])

    with ThreadPoolExecutor(max(1, parallel // beside)) as pool:
        results = [r for rows in pool.map(one, [(f, s) for f in folds for s in scalings]) for r in rows]
    return spark.createDataFrame(
        results, "fold int, scaled boolean, penalty double, n bigint, balanced_accuracy double, kappa double, "
                 "loss double, gradient_max double")


def _read(kept: BinaryIO, row: np.dtype, at: int, n: int) -> np.ndarray:
    kept.seek(at * row.itemsize)
    return np.frombuffer(kept.read(n * row.itemsize), row)


def _piles(kept: BinaryIO, row: np.dtype, n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """All ``n`` rows of a file in random order, about ``size`` at a time.

    Every row goes to a random pile and every pile is shuffled, which makes all orders of the rows equally likely;
    rows are read and written in long stretches, and those that fit are one pile.
    """
    piles = -(-n // size)
    if piles == 1:
        yield _read(kept, row, 0, n)[rng.permutation(n)]
        return
    ends = np.zeros((piles, piles + 1), np.int64)  # where the piles' rows end in each stretch
    with tempfile.TemporaryFile() as dealt:
        for b in range(piles):
            rows = _read(kept, row, b * size, min(size, n - b * size))
            to = rng.integers(0, piles, len(rows))
            ends[b, 1:] = np.bincount(to, minlength=piles).cumsum()
            dealt.write(rows[np.argsort(to, kind="stable")].view(np.uint8))
        for p in range(piles):
            parts = [_read(dealt, row, b * size + int(ends[b, p]), int(ends[b, p + 1] - ends[b, p])) for b in range(piles)]
            rows = np.concatenate(parts)
            yield rows[rng.permutation(len(rows))]


def _minibatches(piles: Iterator[np.ndarray], batch: int) -> Iterator[np.ndarray]:
    """``batch`` rows at a time, over the ends of piles; fewer only in the last one."""
    left = None
    for rows in piles:
        rows = rows if left is None else np.concatenate([left, rows])
        full = len(rows) - len(rows) % batch
        for at in range(0, full, batch):
            yield rows[at: at + batch]
        left = rows[full:].copy()
    if left is not None and len(left):
        yield left


def fit_sgd_probe(train: DataFrame, cells: list[str], k: int, dim: int, seeds: list[int], id_col: str, lr: float = 0.01,
                  epochs: int = 100, batch: int = 256, f: str = "f", weight: str | None = None,
                  max_rows: int | None = None) -> DataFrame:
    """Softmax probe by minibatch SGD (momentum 0.9, cosine schedule): (cells, seed, coef, intercept).

    Fits on every labelled row of a cell, or on at most ``max_rows`` of them, the first in md5 order of the id, where
    that is given. Every (cell, seed) is plain SGD, whose steps follow each other, so it is one task; its rows arrive in
    order of the id, are kept in a file once they exceed PILE_BYTES, and are shuffled anew for each epoch by piles of that size.
    """
    rows = train.select(*cells, "label", F.col(id_col).alias("_id"), F.col(f).alias("_f"),
                        (F.lit(1.0) if weight is None else F.col(weight)).alias("_w"))
    if max_rows is not None:
        rows = hash_sample(rows, max_rows, 0, ["_id"], cells)
    by = [*cells, "seed"]
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_id")
    kinds = dict(train.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cells], "seed int, state array<double>"])
    bound = 1.0 / math.sqrt(dim)
    row = np.dtype([("x", wire_type(train, f), (dim,)), ("y", np.int64), ("w", np.float64)])
    size = max(1, PILE_BYTES // row.itemsize)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        with tempfile.SpooledTemporaryFile(size * row.itemsize) as kept:
            for pdf in batches:
                part, x = np.empty(len(pdf), row), matrix(pdf["_f"])
                if x.shape[1] != dim:
                    raise ValueError(f"a feature vector holds {x.shape[1]} values, not {dim}")
                part["x"], part["y"], part["w"] = x, pdf["label"].to_numpy(int), pdf["_w"].to_numpy(float)
                kept.write(part.view(np.uint8))
                n += len(part)
                key = pdf[by].iloc[:1]
            seed = int(key["seed"].iloc[0])
            theta = np.random.default_rng(seed).uniform(-bound, bound, (k, dim + 1))
            speed = np.zeros_like(theta)
            for epoch in range(epochs):
                step = lr * 0.5 * (1.0 + math.cos(math.pi * epoch / epochs))
                for part in _minibatches(_piles(kept, row, n, size, np.random.default_rng([seed, epoch])), batch):
                    x, w = np.hstack([part["x"], np.ones((len(part), 1))]), part["w"]
                    z = x @ theta.T
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(part)), part["y"]] -= 1.0
                    speed = 0.9 * speed + (p * w[:, None]).T @ x / w.sum()
                    theta = theta - step * speed
        yield key.assign(state=[theta.ravel()])

    state = rows.groupBy(*by).applyInPandas(fit, schema)
    wide = dim + 1
    return state.select(
        *cells, "seed", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.slice("state", c * wide + 1, F.lit(dim))).alias("coef"),
        F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.element_at("state", c * wide)).alias("intercept"))


def score_probes(test: DataFrame, probes: DataFrame, cells: list[str], f: str = "f") -> DataFrame:
    """Score test rows by every seed's probe of their cell; the probe table has one row per cell and seed."""
    j = test.join(small_side(probes), cells)
    return j.withColumn("logits", linear_logits(f, "coef", "intercept")).withColumn("pred", argmax("logits")).drop(
        "coef", "intercept")


def loss_gradient(df: DataFrame, model: LinearModel, k: int, c: float = 1.0, balanced: bool = True, scale: np.ndarray | None = None,
                  f: str = "f") -> DataFrame:
    """One row: weighted NLL, penalty, loss, gradient max-norm (also in scaler coordinates), concern flag.

    Tasks add K x (d+1) gradients in NumPy and emit K rows; the sums stay on the JVM.
    """
    coef, bias = model.coef, model.intercept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, nll, total = np.zeros((k, coef.shape[1] + 1)), 0.0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, w = matrix(pdf[f]), pdf["label"].to_numpy(int), pdf["_w"].to_numpy(float)
            z = x @ coef.T + bias
            top = z.max(axis=1, keepdims=True)
            p = np.exp(z - top)
            norm = p.sum(axis=1, keepdims=True)
            at = np.arange(len(y))
            nll += float((w * (np.log(norm[:, 0]) + top[:, 0] - z[at, y])).sum())
            total += float(w.sum())
            p /= norm
            p[at, y] -= 1.0
            p *= w[:, None]
            grad += np.hstack([p.T @ x, p.sum(axis=0)[:, None]])
        yield pd.DataFrame({"cls": np.arange(k), "grad": list(grad), "nll": [nll / k] * k, "total": [total / k] * k})

    parts = _with_weights(df, k, balanced).select(f, "label", "_w").mapInPandas(
        run, "cls int, grad array<double>, nll double, total double")
    rows = parts.groupBy("cls").agg(vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("g"),
                                    F.sum("nll").alias("nll"), F.sum("total").alias("total"))
    penalty = float((coef ** 2).sum()) / (2.0 * c)
    w = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in (*row, 0.0)]) for row in coef]), F.col("cls") + 1)
    full = F.zip_with(F.col("g"), w, lambda g, v: F.abs(g + v / c))
    spread = np.ones(coef.shape[1]) if scale is None else scale
    inner = F.zip_with(full, F.array(*[F.lit(float(v)) for v in (*spread, 1.0)]), lambda g, v: g * v)
    s = F.sum("total")
    out = rows.agg((F.sum("nll") / s).alias("nll"), (F.max(F.array_max(full)) / s).alias("gradient_max"),
                   (F.max(F.array_max(inner)) / s).alias("scaled_gradient_max"), s.alias("weight"))
    return (out.withColumn("penalty", F.lit(penalty) / F.col("weight")).withColumn("loss", F.col("nll") + F.col("penalty"))
            .withColumn("concern", F.col("gradient_max") > 1e-4).drop("weight"))


# ---- baselines -----------------------------------------------------------------------------------

def majority_baseline(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent training class per key (lowest on ties) for every test row."""
    counts = train.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(*keys).agg(F.max_by("label", F.struct(F.col("_n"), -F.col("label"))).alias("pred"))
    return test.join(small_side(top), keys)


def prior_baseline(train: DataFrame, test: DataFrame, keys: list[str], seed, id_col: str) -> DataFrame:
    """A seeded draw from training frequencies per test row: first class whose cumulative share exceeds it."""
    counts = train.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    prior = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "_n"))).alias("_c"), F.sum("_n").alias("_t"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_c")), lambda i: F.struct(
        F.element_at("_c", i)["label"].alias("label"),
        (F.aggregate(F.slice("_c", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, x: s + x["_n"]) / F.col("_t")).alias("cum")))
    j = test.join(small_side(prior.select(*keys, steps.alias("_steps"))), keys).withColumn("_u", hash_unit(seeded_hash(seed, id_col)))
    return j.withColumn("pred", F.filter("_steps", lambda s: F.col("_u") < s["cum"])[0]["label"]).drop("_steps", "_u")
