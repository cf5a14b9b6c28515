"""Ranking curves, average precision, selections and top-k reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.functions.scalars import ratio
from tilescope.operators.metrics import strict_avg, strict_sd
from tilescope.operators.ordering import exact_quantiles, hash_first, hash_sample, running_totals, values_near_quantiles
from tilescope.session import small_side


def ranking_curve(df: DataFrame, keys: list[str], score: str, positive: Column,
                  item: str | None = None) -> DataFrame:
    """One row per distinct score, descending; equal scores enter together.

    Rows collapse to (keys, score) counts before any shuffle, then cumulate bucket by bucket.
    ``hits`` and ``size`` are this tie group's positives and rows. A NULL or NaN score or a NULL
    outcome raises inside the job.
    """
    fine = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & positive.isNotNull()
    df = df.where(F.when(fine, True).otherwise(F.raise_error(F.lit("ranking needs finite scores and known outcomes")).cast("boolean")))
    hit = positive.cast("int")
    aggs = [F.count(F.lit(1)).alias("size"), F.sum(hit).alias("hits")]
    if item:
        aggs.append(F.max(F.when(hit == 1, F.col(item))).alias("hit_item"))
    groups = df.groupBy(*keys, F.col(score).alias("threshold")).agg(*aggs)
    curve = (running_totals(groups, keys, "threshold", ["size", "hits"], descending=True)
             .withColumnsRenamed({"cum_size": "retrieved", "cum_hits": "tp", "all_size": "n", "all_hits": "positives"}))
    return (curve.withColumn("fp", F.col("retrieved") - F.col("tp"))
            .withColumn("precision", ratio("tp", "retrieved"))
            .withColumn("recall", ratio("tp", "positives")))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Non-interpolated AP and tie facts per key; AP is NULL without positives."""
    return curve.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("positives").alias("positives"),
        ratio(F.max("positives"), F.max("n")).alias("prevalence"),
        F.try_divide(F.sum(F.col("hits") * F.col("precision")), F.max("positives")).alias("ap"),
        F.count(F.lit(1)).alias("distinct_scores"),
        F.count_if(F.col("size") > 1).alias("tied_groups"), F.max("size").alias("largest_tie"))


def single_positive(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Rank range of the only positive, for keys that have exactly one."""
    return curve.where((F.col("positives") == 1) & (F.col("hits") == 1)).select(
        *keys, "hit_item", (F.col("retrieved") - F.col("size") + 1).alias("rank_first"),
        F.col("retrieved").alias("rank_last"), F.col("size").alias("tie_size"))


def one_vs_rest(pred: DataFrame, keys: list[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """Long rows (keys, class, score, positive) from probability arrays."""
    return pred.select(*keys, label, F.posexplode(prob).alias("class", "score")).withColumn(
        "positive", F.col(label) == F.col("class"))


def ovr_average_precision(pred: DataFrame, keys: list[str]) -> DataFrame:
    long = one_vs_rest(pred, keys)
    curve = ranking_curve(long, [*keys, "class"], "score", F.col("positive"))
    return average_precision(curve, [*keys, "class"])


def with_macro_ap(ap: DataFrame, keys: list[str], cls: str = "class") -> DataFrame:
    """Per-class AP plus one row of class -1 per key, the macro AP: NULL if any class has none."""
    macro = ap.groupBy(*keys).agg(strict_avg("ap").alias("ap")).select(*keys, F.lit(-1).cast(dict(ap.dtypes)[cls]).alias(cls), "ap")
    return ap.select(*keys, cls, "ap").unionByName(macro)


def ap_summary(ap: DataFrame, arm: list[str], fold: str = "fold", seed: str = "seed", cls: str = "class") -> DataFrame:
    """(arm, class, fold, mean, sd): seed means per region, and with fold NULL their mean and SD over regions.

    Class -1 is the macro AP. Seeds are averaged first, scores are never pooled; an undefined AP makes
    everything it enters undefined.
    """
    seeds = with_macro_ap(ap, [*arm, fold, seed], cls).groupBy(*arm, cls, fold).agg(strict_avg("ap").alias("mean"))
    regions = seeds.groupBy(*arm, cls).agg(strict_avg("mean").alias("_m"), strict_sd("mean").alias("sd"))
    return (seeds.withColumn("sd", F.lit(None).cast("double"))
            .unionByName(regions.select(*arm, cls, F.lit(None).cast(dict(ap.dtypes)[fold]).alias(fold), F.col("_m").alias("mean"), "sd")))


def ap_contrasts(ap: DataFrame, arm: str, a, b, keys: list[str] = (), fold: str = "fold", seed: str = "seed", cls: str = "class") -> DataFrame:
    """(keys, class, fold, pairs, paired, unpaired): AP of arm ``a`` minus arm ``b`` per region.

    ``paired`` averages the differences of equal seeds, ``pairs`` counts them; ``unpaired`` is the difference
    of the arms' seed means, for arms with other seeds. Undefined APs make the contrast undefined; seeds
    of one arm only are left out of the pairs, and without pairs ``paired`` is NULL.
    """
    rows = with_macro_ap(ap.where(F.col(arm).isin(a, b)), [*keys, arm, fold, seed], cls)
    of = lambda value, c: F.max(F.when(F.col(arm) == value, F.lit(True) if c is None else F.col(c)))
    seeds = rows.groupBy(*keys, cls, fold, seed).agg(
        of(a, None).alias("_in_a"), of(b, None).alias("_in_b"), of(a, "ap").alias("_a"), of(b, "ap").alias("_b"))
    both = F.col("_in_a") & F.col("_in_b")
    mean = lambda here, value: F.when(F.count(F.when(here, value)) == F.count(F.when(here, 1)), F.avg(F.when(here, value)))
    side = lambda c: mean(F.coalesce(F.col(f"_in_{c}"), F.lit(False)), F.col(f"_{c}"))
    pair = F.coalesce(both, F.lit(False))
    return seeds.groupBy(*keys, cls, fold).agg(
        F.count_if(pair).alias("pairs"), mean(pair, F.col("_a") - F.col("_b")).alias("paired"), (side("a") - side("b")).alias("unpaired"))


def retrieval_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Recall against retrieved count at the points where true positives rise."""
    return curve.where(F.col("hits") > 0).select(*keys, "retrieved", "tp", "recall")


# ---- selections ------------------------------------------------------------------------

def select_epoch(hist: DataFrame, cell: list[str], score: str = "score", steps: str = "steps") -> DataFrame:
    """Earliest epoch with the best score among epochs that made updates."""
    best = F.max_by(F.struct("epoch", score), F.struct(F.col(score), -F.col("epoch")))
    return (hist.where(F.col(steps) > 0).groupBy(*cell).agg(best.alias("_b"))
            .select(*cell, "_b.epoch", f"_b.{score}"))


def select_rate(cells: DataFrame, keys: list[str], rate: str, score: str) -> DataFrame:
    """Highest score, then lowest rate, with the number of candidates."""
    best = F.max_by(F.struct(rate, score), F.struct(F.col(score), -F.col(rate)))
    return cells.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("candidates")).select(
        *keys, f"_b.{rate}", f"_b.{score}", "candidates")


def priority_topk(df: DataFrame, score: str, item: str, k: int) -> DataFrame:
    """Top-k report: descending score, ties by item; ``rank`` counts over k rows only."""
    top = df.orderBy(F.desc(score), item).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), item)))


def median_pick(df: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """Row nearest the exact median per key in decimal arithmetic, ties by item."""
    dec = df.select(*keys, item, F.col(value).cast("decimal(18,4)").alias("_x"))
    med = exact_quantiles(dec.select(*keys, F.col("_x").cast("double").alias("_d")), keys, "_d", [0.5])
    med = med.select(*keys, F.col("value").cast("decimal(19,5)").alias("median"), "n")
    near = dec.join(small_side(med), keys).withColumn("_gap", F.abs(F.col("_x") - F.col("median")))
    return near.groupBy(*keys).agg(
        F.min_by(item, F.struct("_gap", item)).alias(item), F.first("median").cast("double").alias("median"),
        F.first("n").alias("candidates"))


def quantile_picks(df: DataFrame, keys: list[str], value: str, item: str, qs: list[float]) -> DataFrame:
    """Nearest row to each linear quantile, ties by item, no row picked twice.

    Only values within ``len(qs)`` rows of a quantile's position can hold its ``len(qs)`` nearest
    rows (enough to survive every earlier pick), so the data is joined to those few values; the final
    assignment sees at most ``len(qs)**2`` rows per key.
    """
    marks = values_near_quantiles(df.select(*keys, value), keys, value, qs, len(qs))
    near = (df.select(*keys, item, value).join(small_side(marks), [*keys, value])
            .withColumn("gap", F.abs(F.col(value) - F.col("mark"))))
    w = Window.partitionBy(*keys, "q").orderBy("gap", item)
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= len(qs)).drop("_r")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, part in pdf.sort_values(["q", "gap", item]).groupby("q", sort=True):
            free = part[~part[item].isin(taken)]
            if len(free):
                out.append(free.iloc[:1])
                taken.add(free.iloc[0][item])
        return pd.concat(out) if out else pdf.iloc[:0]

    return near.groupBy(*keys).applyInPandas(assign, near.schema)


def subsample_train(df: DataFrame, n: int, seed, ids: list[str], label: str | None = None) -> DataFrame:
    """Uniform, or class-stratified by largest remainder, training subset of size ``n``."""
    if label is None:
        return hash_sample(df, n, seed, ids)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    share = counts.withColumn("_s", F.try_divide(F.lit(n) * F.col("_n"), total.cast("double"))).withColumn(
        "_base", F.floor("_s"))
    spare = F.lit(n) - share.select(F.sum("_base")).scalar()
    by_rest = Window.orderBy(F.desc(F.col("_s") - F.col("_base")), label)  # one row per class
    quota = share.withColumn("_extra", (F.row_number().over(by_rest) <= spare).cast("bigint")).select(
        label, F.least(F.col("_base") + F.col("_extra"), F.col("_n")).alias("_quota"))
    return hash_first(df, [label], quota, seed, ids)


def column_winners(summary: DataFrame, metric: str, value: str, digits: int = 2) -> DataFrame:
    """Flag every row equal to its metric's maximum after rounding half to even."""
    shown = summary.withColumn("shown", F.bround(value, digits))
    best = shown.groupBy(metric).agg(F.max("shown").alias("_best"))
    return shown.join(best, metric).withColumn("winner", F.col("shown") == F.col("_best")).drop("_best")


