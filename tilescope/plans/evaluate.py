"""Compositions of operators into whole evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.operators import domain_gap as G
from tilescope.operators import embedding as E
from tilescope.operators import fit as L
from tilescope.operators import metrics as M
from tilescope.operators.membership import restrict_to_source_classes


def reduce_metrics(metrics: DataFrame, keys: list[str], reducer: Callable[[str], Column]) -> DataFrame:
    """Apply any aggregate to each metric of a long (keys, metric, value) table."""
    return metrics.groupBy(*keys, "metric").agg(reducer("value").alias("value"))


def knn_fold_metrics(folds: DataFrame, k: int, classes: int, id_col: str = "vec_id") -> DataFrame:
    """Per fold: k-NN balanced accuracy, macro F1 and kappa."""
    pred = E.knn_classify(folds.where("role = 'train'"), folds.where("role = 'test'"), k, id_col, ["fold"])
    counts = M.pair_counts(pred, ["fold"])
    m = M.class_metrics(counts, ["fold"], classes)
    return (M.balanced_accuracy(m, ["fold"]).select("fold", "balanced_accuracy")
            .join(M.macro(m, ["fold"], "supported").select("fold", "macro_f1"), "fold")
            .join(M.kappa(counts, ["fold"], classes).select("fold", "n", "kappa"), "fold"))


def _long(df: DataFrame, keys: list[str], values: list[str], **extra: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, *[F.lit(v).alias(c) for c, v in extra.items()], F.inline(pairs))


def within_eval(folds: DataFrame, k: int, classes: int, dim: int, seeds: list[int], id_col: str = "vec_id",
                epochs: int = 100) -> DataFrame:
    """Probe seeds, k-NN and silhouette per fold as one long table (fold, method, seed, metric, value).

    Seeds stay separate rows; summarise seeds inside folds before folds.
    """
    train, test = folds.where("role = 'train'"), folds.where("role = 'test'")
    counts = M.class_counts(train, ["fold"], classes)
    weighted = M.with_class_weight(train, M.inv_freq_weights(counts, ["fold"]), ["fold"])
    probes = L.fit_sgd_probe(weighted, ["fold"], classes, dim, seeds, id_col, epochs=epochs, weight="weight")
    scored = L.score_probes(test, probes, ["fold"])
    cell = ["fold", "seed"]
    probe = _long(L.evaluate_probe(scored, cell, classes), cell, ["balanced_accuracy", "kappa"], method="probe")
    knn = _long(knn_fold_metrics(folds, k, classes, id_col), ["fold"], ["balanced_accuracy", "kappa"], method="knn").withColumn(
        "seed", F.lit(-1))
    parts = probe.unionByName(knn)
    for fold in sorted(r["fold"] for r in test.select("fold").distinct().collect()):  # one row per fold of the design
        s = _long(E.silhouette(test.where(F.col("fold") == fold)), [], ["silhouette"], method="silhouette")
        parts = parts.unionByName(s.withColumn("fold", F.lit(fold)).withColumn("seed", F.lit(-1)))
    return parts


def transfer_eval(source: DataFrame, target: DataFrame, k: int, classes: int, dim: int, seeds: list[int],
                  id_col: str = "vec_id", epochs: int = 100) -> DataFrame:
    """Train on the source domain, test on supported target classes, with the domain-gap bundle.

    Long table (method, metric, value).
    """
    test = restrict_to_source_classes(target, source)
    one = lambda d: d.withColumn("run", F.lit(0))
    probes = L.fit_sgd_probe(one(source), ["run"], classes, dim, seeds, id_col, epochs=epochs)
    scored = L.score_probes(one(test), probes, ["run"])
    probe = L.evaluate_probe(scored, ["seed"], classes)
    probe = probe.agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("kappa").alias("kappa"))
    knn = L.evaluate_probe(E.knn_classify(source, test, k, id_col), [], classes)
    both = source.withColumn("domain", F.lit(0)).unionByName(target.withColumn("domain", F.lit(1)))
    gaps = [_long(G.mmd_linear(both, "domain", 0, 1), [], ["mmd2"], method="mmd_linear"),
            _long(G.mmd_rbf(both, "domain", 0, 1, id_col), [], ["mmd2"], method="mmd_rbf"),
            _long(G.proxy_a_distance(both, "domain", 0, 1, id_col), [], ["a_distance"], method="proxy_a"),
            _long(E.mean_distance(E.centroid_distances(both, "domain", 0, 1, classes)), [], ["mean_distance"], method="centroids"),
            _long(E.coral_distance(both, "domain", 0, 1), [], ["coral_distance"], method="coral")]
    out = _long(probe, [], ["balanced_accuracy", "kappa"], method="probe").unionByName(
        _long(knn, [], ["balanced_accuracy", "kappa"], method="knn"))
    for g in gaps:
        out = out.unionByName(g)
    return out
