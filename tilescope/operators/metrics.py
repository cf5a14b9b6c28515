"""Label and prediction metrics: counts first, everything else is arithmetic on counts.

Rows are reduced to (keys, label, prediction) counts with map-side combine, so a hot key costs
nothing extra; all later steps work on K x K numbers per key. ``undefined`` picks the policy for
ratios without support: ``'null'`` or ``'zero'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.scalars import ratio
from tilescope.session import small_side

METRICS = ("precision", "recall", "f1")


def class_counts(df: DataFrame, keys: list[str], k: int, label: str = "label") -> DataFrame:
    """Dense counts ``n`` per (keys, class), zero classes included."""
    raw = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return _dense(raw, keys, [F.struct(F.lit(c).alias("class"), _sum_if(F.col(label) == c).alias("n"))
                              for c in range(k)])


def _sum_if(cond: Column, n: str = "_n") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("bigint")


def _dense(raw: DataFrame, keys: list[str], structs: list[Column]) -> DataFrame:
    return (raw.groupBy(*keys).agg(F.array(*structs).alias("_cells"))
            .select(*keys, F.inline("_cells")))


def pair_counts(pred: DataFrame, keys: list[str], label="label", prediction="pred") -> DataFrame:
    """Sparse confusion counts."""
    return pred.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Dense K x K counts per key: ``label`` true, ``pred`` predicted, ``n``."""
    return densify(pair_counts(pred, keys), keys, k)


def densify(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    raw = counts.withColumnRenamed("n", "_n")
    hit = lambda a, b: (F.col("label") == a) & (F.col("pred") == b)
    return _dense(raw, keys, [
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), _sum_if(hit(a, b)).alias("n"))
        for a in range(k) for b in range(k)])


def confusion_rates(cm: DataFrame, keys: list[str]) -> DataFrame:
    """Row-normalised confusion; empty rows stay zero."""
    rows = cm.groupBy(*keys, "label").agg(F.sum("n").alias("_row"),
                                          F.collect_list(F.struct("pred", "n")).alias("_cells"))
    return (rows.select(*keys, "label", "_row", F.inline("_cells"))
            .withColumn("rate", F.col("n") / F.greatest(F.col("_row"), F.lit(1))).drop("_row"))


def outcome_counts(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per class ``tp, fp, fn, support, predicted`` from sparse or dense confusion counts."""
    raw = counts.withColumnRenamed("n", "_n")
    lab, prd = F.col("label"), F.col("pred")
    cells = _dense(raw, keys, [
        F.struct(F.lit(c).alias("class"), _sum_if((lab == c) & (prd == c)).alias("tp"),
                 _sum_if(lab == c).alias("support"), _sum_if(prd == c).alias("predicted"))
        for c in range(k)])
    return (cells.withColumn("fp", F.col("predicted") - F.col("tp"))
            .withColumn("fn", F.col("support") - F.col("tp")))


def class_metrics(counts: DataFrame, keys: list[str], k: int, undefined: str = "null") -> DataFrame:
    """Precision, recall and F1 per class."""
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if undefined == "zero" else (lambda c: c)
    return (outcome_counts(counts, keys, k)
            .withColumn("precision", fill(ratio("tp", "predicted")))
            .withColumn("recall", fill(ratio("tp", "support")))
            .withColumn("f1", fill(ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")))))


def macro(metrics: DataFrame, keys: list[str], policy: str = "all") -> DataFrame:
    """Mean class metric per key.

    ``all``: over every class, undefined counts as zero. ``supported``: classes with true rows.
    ``strict``: NULL unless every class is defined.
    """
    def reduce(m):
        if policy == "all":
            return F.avg(F.coalesce(m, F.lit(0.0)))
        if policy == "supported":
            return F.avg(F.when(F.col("support") > 0, F.coalesce(m, F.lit(0.0))))
        if policy == "strict":
            return strict_avg(m)
        raise ValueError(f"unknown policy {policy!r}")
    return metrics.groupBy(*keys).agg(*[reduce(F.col(m)).alias(f"macro_{m}") for m in METRICS])


def strict_avg(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_sd(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.stddev_samp(c))


def balanced_accuracy(metrics: DataFrame, keys: list[str], classes: list[int] | None = None) -> DataFrame:
    """Mean recall over classes with true rows, optionally only over source ``classes``."""
    if classes is not None:
        metrics = metrics.where(F.col("class").isin(list(classes)))
    return metrics.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0))
        .alias("balanced_accuracy"),
        F.count_if(F.col("support") > 0).alias("classes_present"))


def kappa(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cohen kappa; perfect expected agreement gives 1 or 0, empty input gives 0."""
    n, n2 = F.sum("support"), F.pow(F.sum("support").cast("double"), 2)
    cells = outcome_counts(counts, keys, k).groupBy(*keys).agg(
        n.alias("n"), ratio(F.sum("tp"), n).alias("observed"),
        F.try_divide(F.sum(F.col("support").cast("double") * F.col("predicted")), n2).alias("expected"))
    return cells.withColumn(
        "kappa", F.when(F.col("n") == 0, 0.0)
        .when(F.col("expected") == 1.0, F.when(F.col("observed") == 1.0, 1.0).otherwise(0.0))
        .otherwise(F.try_divide(F.col("observed") - F.col("expected"), 1.0 - F.col("expected"))))


def top_errors(cm: DataFrame, n: int) -> DataFrame:
    """Largest off-diagonal counts with error rates; ties in row-major order."""
    rates = confusion_rates(cm, [])
    return (rates.where((F.col("label") != F.col("pred")) & (F.col("n") > 0))
            .orderBy(F.desc("n"), "label", "pred").limit(n))


def confusion_report(pred: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Long report: accuracy plus class precision, recall, F1 and support (``class`` -1 is overall)."""
    counts = pair_counts(pred, keys)
    rows = class_metrics(counts, keys, k, "zero").select(
        *keys, "class", F.expr(
            "stack(4, 'precision', precision, 'recall', recall, 'f1', f1, "
            "'support', cast(support as double)) as (metric, value)"))
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    overall = counts.groupBy(*keys).agg(ratio(hit, F.sum("n")).alias("value")).select(
        *keys, F.lit(-1).alias("class"), F.lit("accuracy").alias("metric"), "value")
    return rows.unionByName(overall)


# ---- weights -----------------------------------------------------------------------

def inv_freq_weights(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``1/max(n,1)`` scaled to mean one over the K class rows of each key."""
    rows = counts.withColumn("_w", 1.0 / F.greatest(F.col("n"), F.lit(1)))
    mean = rows.groupBy(*keys).agg(F.avg("_w").alias("_m"),
                                   F.collect_list(F.struct("class", "n", "_w")).alias("_rows"))
    return (mean.select(*keys, "_m", F.inline("_rows"))
            .select(*keys, "class", "n", (F.col("_w") / F.col("_m")).alias("weight")))


def balanced_weights(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``N/(K*n_class)`` per class row; a class without rows is an error."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"),
                                      F.collect_list(F.struct("class", "n")).alias("_rows"))
    return (total.select(*keys, "_total", F.inline("_rows"))
            .select(*keys, "class", "n", F.when(
                F.col("n") > 0, F.try_divide(F.col("_total"), F.col("n").cast("double") * k))
                .otherwise(F.raise_error(F.concat(F.lit("no training rows for class "), F.col("class"))))
                .alias("weight")))


def with_class_weight(df: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a class weight to every row; the weight table has K rows per key."""
    return df.join(small_side(weights.select(*keys, F.col("class").alias("label"), "weight")), [*keys, "label"])


def population_weight(weights: DataFrame, keys: list[str] = ()) -> DataFrame:
    return weights.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n") * F.col("weight")), F.sum("n")).alias("population_weight"))


# ---- seed and fold summaries -----------------------------------------------------------

def summarize_folds(metrics: DataFrame, keys: list[str], value: str, fold="fold") -> DataFrame:
    """Mean over seeds inside a fold, then equal-weight mean and sample SD over folds."""
    per_fold = metrics.groupBy(*keys, fold).agg(F.avg(value).alias("_v"))
    return per_fold.groupBy(*keys).agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"),
        F.count(F.lit(1)).alias("folds"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"))


def summarize_strict(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Any undefined input makes mean and SD undefined; ``n`` counts all inputs."""
    return values.groupBy(*keys).agg(strict_avg(value).alias("mean"), strict_sd(value).alias("sd"),
                                     F.count(F.lit(1)).alias("n"))


def summarize_seeds(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample SD across seeds; undefined seeds are left out."""
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                      F.count(value).alias("n"))


def pooled_metrics(counts: DataFrame, keys: list[str], k: int, seed="seed") -> DataFrame:
    """Pool folds inside a seed, score each seed, then average seeds; seeds are never pooled."""
    pooled = counts.groupBy(*keys, seed, "label", "pred").agg(F.sum("n").alias("n"))
    per_seed = macro(class_metrics(pooled, [*keys, seed], k), [*keys, seed], "all")
    return per_seed.groupBy(*keys).agg(*[F.avg(f"macro_{m}").alias(f"macro_{m}") for m in METRICS],
                                       F.count(F.lit(1)).alias("seeds"))


# ---- contrasts ----------------------------------------------------------------------------

def paired(df: DataFrame, keys: list[str], arm: str, a, b, value: str) -> DataFrame:
    """Both arms of each key side by side (``value_a``, ``value_b``); incomplete pairs drop out.

    One conditional aggregate: a self-join would scan and shuffle the input twice.
    """
    return (df.where(F.col(arm).isin(a, b)).groupBy(*keys)
            .agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("value_a"),
                 F.max(F.when(F.col(arm) == b, F.col(value))).alias("value_b"))
            .where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()))


def contrast(metrics: DataFrame, arm: str, a, b, value: str, fold="fold", seed="seed") -> DataFrame:
    """Percentage-point difference a-b per fold and seed, seed mean, then fold mean and SD."""
    diff = paired(metrics, [fold, seed], arm, a, b, value).select(
        fold, ((F.col("value_a") - F.col("value_b")) * 100.0).alias("diff"))
    return summarize_folds(diff, [], "diff", fold)


def contrast_unpaired(metrics: DataFrame, arm: str, single, many, value: str, fold="fold") -> DataFrame:
    """One state minus the mean of several states, per fold."""
    is_one = F.col(arm) == single
    return (metrics.where(F.col(arm).isin([single, *many])).groupBy(fold)
            .agg(F.avg(F.when(is_one, F.col(value))).alias("single"),
                 F.avg(F.when(~is_one, F.col(value))).alias("many_mean"))
            .withColumn("diff", F.col("single") - F.col("many_mean")))


def pairwise_contrasts(fold_values: DataFrame, family: str, value: str, fold="fold",
                       tie: float = 1e-12) -> DataFrame:
    """Every unordered family pair over folds: mean, SD and sign counts. Input is one row per
    (family, fold), so the fold-keyed join stays families squared per fold."""
    a = fold_values.select(fold, F.col(family).alias("family_a"), F.col(value).alias("_a"))
    b = fold_values.select(fold, F.col(family).alias("family_b"), F.col(value).alias("_b"))
    d = (a.join(b, fold).where(F.col("family_a") < F.col("family_b"))
         .withColumn("d", F.col("_a") - F.col("_b")))
    return d.groupBy("family_a", "family_b").agg(
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
        F.count_if(F.col("d") > tie).alias("positive"),
        F.count_if(F.col("d") < -tie).alias("negative"),
        F.count_if(F.abs(F.col("d")) <= tie).alias("ties"))


def interaction(metrics: DataFrame, keys: list[str], f1: str, f2: str, value: str) -> DataFrame:
    """2x2 design with 0/1 factors: four simple contrasts and their interaction."""
    at = lambda i, j: F.avg(F.when((F.col(f1) == i) & (F.col(f2) == j), F.col(value)))
    cells = metrics.groupBy(*keys).agg(at(0, 0).alias("v00"), at(0, 1).alias("v01"),
                                       at(1, 0).alias("v10"), at(1, 1).alias("v11"))
    v = F.col
    return cells.select(*keys, (v("v10") - v("v00")).alias("first_at_0"),
                        (v("v11") - v("v01")).alias("first_at_1"),
                        (v("v01") - v("v00")).alias("second_at_0"),
                        (v("v11") - v("v10")).alias("second_at_1"),
                        ((v("v11") - v("v01")) - (v("v10") - v("v00"))).alias("interaction"))


def paired_t(diffs: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """t statistic and degrees of freedom over fold differences."""
    return diffs.groupBy(*keys).agg(
        F.avg(diff).alias("mean"), F.count(diff).alias("n"),
        F.try_divide(F.avg(diff), F.stddev_samp(diff) / F.sqrt(F.count(diff))).alias("t"),
        (F.count(diff) - 1).alias("df"))


def control_summary(reference: DataFrame, replacement: DataFrame, value: str, fold="fold",
                    draw="draw") -> DataFrame:
    """Reference, replacement (draws averaged first) and difference per fold and over folds."""
    ref = reference.groupBy(fold).agg(F.avg(value).alias("reference"))
    rep = (replacement.groupBy(fold, draw).agg(F.avg(value).alias("_v"))
           .groupBy(fold).agg(F.avg("_v").alias("replacement")))
    per_fold = ref.join(rep, fold).withColumn("difference", F.col("reference") - F.col("replacement"))
    long = per_fold.select(fold, F.expr(
        "stack(3, 'reference', reference, 'replacement', replacement, 'difference', difference)"
        " as (quantity, v)"))
    return long.groupBy("quantity").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
                                        F.count(F.lit(1)).alias("folds"))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic by the finite trigonometric series for whole degrees of freedom.

    With theta = atan(|t|/sqrt(df)) the central probability is a sum of powers of cos(theta), one
    series for odd and one for even degrees of freedom.
    """
    theta = F.atan2(F.abs(t), F.sqrt(df.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    odd = (df % 2) == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")

    def step(acc, k):
        # k-th term from the one before it: even df multiplies by (2k-1)/(2k), odd by 2k/(2k+1)
        factor = F.when(odd, (2.0 * k) / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        term = acc["term"] * factor * c * c
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    first = F.when(odd, c).otherwise(F.lit(1.0))
    series = F.when(terms > 0, F.when(terms == 1, first).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1))),
        F.struct(first.alias("total"), first.alias("term")), step)["total"])).otherwise(F.lit(0.0))
    central = F.when(odd, (theta + s * series) * (2.0 / 3.141592653589793)).otherwise(s * series)
    return F.when(t.isNotNull(), F.greatest(1.0 - central, F.lit(0.0)))


# ---- losses and small-sample diagnostics -----------------------------------------------

def weighted_loss(pred: DataFrame, keys: list[str], p_label: str, weight: str,
                  denominator: str = "weights") -> DataFrame:
    """Weighted cross-entropy sums per key and loss under a denominator of ``weights`` or ``rows``."""
    sums = pred.groupBy(*keys).agg(
        F.sum(-F.col(weight) * F.log(F.col(p_label))).alias("numerator"),
        F.sum(weight).alias("weight_sum"), F.count(F.lit(1)).alias("n"))
    den = F.col("weight_sum") if denominator == "weights" else F.col("n").cast("double")
    return sums.withColumn("loss", F.try_divide(F.col("numerator"), den))


def leverage(metrics: DataFrame, keys: list[str], cls: int, k: int) -> DataFrame:
    """Macro recall if a class's only example were wrong or right; one-support keys only."""
    one = F.sum(F.when(F.col("class") == cls, F.col("support"))) == 1
    rec = F.sum(F.coalesce(F.col("recall"), F.lit(0.0))) / k
    hit = F.sum(F.when(F.col("class") == cls, F.col("tp")))
    return (metrics.groupBy(*keys).agg(one.alias("_one"), hit.alias("correct"), rec.alias("macro_recall"))
            .where("_one").drop("_one")
            .withColumn("if_incorrect", F.col("macro_recall") - F.col("correct") / k)
            .withColumn("if_correct", F.col("macro_recall") + (1 - F.col("correct")) / k)
            .withColumn("leverage", F.lit(1.0 / k)))


def summarize_runs(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and SD over runs; a single run has SD zero."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.avg(v).alias(f"{v}_mean") for v in values],
        *[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd") for v in values])
