"""Error analysis over predictions: draws, cohorts, bands, bins, strata and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.functions.scalars import entropy, is_finite, ratio, wrap_lon
from tilescope.operators import metrics as M
from tilescope.operators.ordering import exact_quantiles, hash_rank
from tilescope.session import cut_lineage



def _hit() -> Column:
    return (F.col("label") == F.col("pred")).cast("int")


def mark_correct(df: DataFrame, cls: int) -> DataFrame:
    """Add ``correct`` and, for one class, ``hit``."""
    return df.withColumn("correct", F.col("label") == F.col("pred")).withColumn(
        "hit", (F.col("label") == cls) & (F.col("pred") == cls))


def draw_errors(rows: DataFrame, mask: Column, k: int) -> DataFrame:
    """Per draw and a ``mean`` row: support, baseline and substitute errors, rates and difference.

    Reads draw, label, baseline, substitute. Draws without masked rows keep NULL rates.
    """
    bad = lambda c: F.count_if(mask & (F.col(c) != F.col("label"))).cast("double")
    per_draw = rows.groupBy(F.col("draw").cast("string").alias("draw")).agg(
        F.count_if(mask).cast("double").alias("n"),
        *[F.count_if(mask & (F.col("label") == c)).cast("double").alias(f"support_{c}") for c in range(k)],
        bad("baseline").alias("baseline_errors"), bad("substitute").alias("substitute_errors"))
    mean = per_draw.agg(*[F.avg(c).alias(c) for c in per_draw.columns if c != "draw"]).withColumn(
        "draw", F.lit("mean"))
    both = per_draw.unionByName(mean)
    return (both.withColumn("baseline_rate", ratio("baseline_errors", "n"))
            .withColumn("substitute_rate", ratio("substitute_errors", "n"))
            .withColumn("difference", ratio(F.col("substitute_errors") - F.col("baseline_errors"), "n")))


def coverage_scores(pred: DataFrame, keys: list[str], fraction: str, k: int, fold="fold", seed="seed") -> DataFrame:
    """Strict macro F1 for all / complete (fraction 1) / partial rows: seeds, then folds, NULL-propagating."""
    cohorts = F.array(F.lit("all"), F.when(F.col(fraction) == 1, "complete").otherwise("partial"))
    rows = pred.withColumn("cohort", F.explode(cohorts))
    cell = [*keys, "cohort", fold, seed]
    m = M.macro(M.class_metrics(M.pair_counts(rows, cell), cell, k), cell, "strict")
    per_fold = m.groupBy(*keys, "cohort", fold).agg(M.strict_avg("macro_f1").alias("v"))
    return M.summarize_strict(per_fold, [*keys, "cohort"], "v")


LATITUDE_BANDS = ("north_polar", "south_polar", "north_mid", "south_mid", "equatorial")
HEMISPHERES = ("western", "eastern")


def latitude_band(lat) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    return (F.when(lat > 60, "north_polar").when(lat < -60, "south_polar").when(lat > 30, "north_mid")
            .when(lat < -30, "south_mid").otherwise("equatorial"))


def band_accuracy(pred: DataFrame, k: int) -> DataFrame:
    """Accuracy by latitude band, band and class, hemisphere, and overall; empty groups keep NULL.

    One grouping-sets aggregate, then a left join from the fixed list of groups.
    """
    rows = pred.select("label", "pred", latitude_band("lat").alias("band"),
                       F.when(wrap_lon("lon") >= 180, "western").otherwise("eastern").alias("hemisphere"))
    sets = rows.groupingSets([["band"], ["band", "label"], ["hemisphere"], []], "band", "hemisphere", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_hit()).alias("accuracy"))
    have = sets.select(F.coalesce("band", "hemisphere", F.lit("overall")).alias("region"),
                       F.coalesce("label", F.lit(-1)).cast("int").alias("class"), "n", "accuracy")
    regions = F.array(*[F.lit(r) for r in (*LATITUDE_BANDS, *HEMISPHERES, "overall")])
    grid = pred.sparkSession.range(1).select(F.explode(regions).alias("region")).withColumn(
        "class", F.explode(F.when(F.col("region").isin(*LATITUDE_BANDS), F.sequence(F.lit(-1), F.lit(k - 1)))
                           .otherwise(F.array(F.lit(-1)))))
    return grid.join(have, ["region", "class"], "left").fillna(0, ["n"])


def safe_corr(x, y) -> Column:
    """Pearson correlation, NULL for fewer than two rows or zero variance (never an ANSI error)."""
    x, y = [F.col(c) if isinstance(c, str) else c for c in (x, y)]
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((F.count(a) >= 2) & ~flat, F.try_divide(F.covar_pop(a, b), sd))


def _edges(rows: DataFrame, x: str, n: int) -> DataFrame:
    """One row of n + 1 edges, computed once and kept: several expressions read it."""
    return cut_lineage(exact_quantiles(rows, [], x, [i / n for i in range(n + 1)]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda s: s["value"]).alias("edges")))


def binned_accuracy(pred: DataFrame, x: str, n: int) -> DataFrame:
    """Accuracy in quantile bins of ``x``: tied edges collapse, a constant is one bin, the last bin
    is closed. Reads label, pred, x; non-finite x is dropped. ``correlation`` repeats on each row."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    rows = pred.where(is_finite(x)).select(F.col(x).cast("double").alias("x"), _hit().alias("hit"))
    e = F.array_distinct("edges")
    edges = _edges(rows, "x", n).select(F.when(F.size(e) == 1, F.concat(e, e)).otherwise(e).alias("edges"))
    cut = F.slice("edges", 1, F.size("edges") - 1)
    binned = rows.withColumn("edges", edges.scalar()).withColumn(
        "bin", F.size(F.filter(cut, lambda v: v <= F.col("x"))))
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"),
                                      F.avg("x").alias("mean_x"))
    corr = rows.agg(safe_corr("x", "hit").alias("correlation"))
    grid = edges.select("edges", F.posexplode(cut).alias("_i", "low")).select(
        (F.col("_i") + 1).alias("bin"), "low", F.element_at("edges", F.col("_i") + 2).alias("high"))
    return (grid.join(stats, "bin", "left").fillna(0, ["n"]).withColumn("correlation", corr.scalar()))


def confidence_accuracy(pred: DataFrame, c: str, thresholds: list[float]) -> DataFrame:
    """Accuracy and share at or above each threshold, and in quartiles that keep ties.

    Rows: (kind, mark, low, high, n, accuracy, share); quartile marks are 1..4.
    """
    rows = pred.where(is_finite(c)).select(F.col(c).cast("double").alias("c"), _hit().alias("hit"))
    marks = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    per = (rows.withColumn("mark", F.explode(F.filter(marks, lambda t: t <= F.col("c"))))
           .groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy")))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    above = (pred.sparkSession.range(1).select(F.explode(marks).alias("mark")).join(per, "mark", "left")
             .fillna(0, ["n"]).withColumn("share", F.coalesce(ratio("n", total.scalar()), F.lit(0.0)))
             .select(F.lit("threshold").alias("kind"), "mark", F.col("mark").alias("low"),
                     F.lit(None).cast("double").alias("high"), "n", "accuracy", "share"))
    edges = _edges(rows, "c", 4)
    at = lambda i: F.element_at("edges", i)
    quart = rows.withColumn("edges", edges.scalar()).withColumn(
        "mark", F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("c") >= at(i)) & (
            (F.col("c") < at(i + 1)) | ((i == 4) & (F.col("c") <= at(i + 1)))))[0])
    stats = quart.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
    grid = edges.select("edges", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("mark")).select(
        "mark", at(F.col("mark")).alias("low"), at(F.col("mark") + 1).alias("high"))
    quartiles = grid.join(stats, "mark", "left").fillna(0, ["n"]).select(
        F.lit("quartile").alias("kind"), F.col("mark").cast("double").alias("mark"), "low", "high", "n", "accuracy",
        F.coalesce(ratio("n", total.scalar()), F.lit(0.0)).alias("share"))
    return above.unionByName(quartiles)


def mode_lowest(df: DataFrame, keys: list[str], code: str, valid: Column | None = None) -> DataFrame:
    """Most frequent code per key, lowest on ties, with its fraction of valid rows (4 decimals)."""
    rows = df if valid is None else df.where(valid)
    counts = rows.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.max_by(code, F.struct(F.col("n"), -F.col(code))).alias("mode"),
        F.round(F.max("n") / F.sum("n"), 4).alias("fraction"), F.sum("n").alias("valid"))


def strata_errors(pred: DataFrame, keys: list[str], fraction: str, low: float = 0.75, high: float = 0.90,
                  min_n: int = 20) -> DataFrame:
    """Error rate per stratum below ``low`` and at or above ``high``; eligible when both have support."""
    f, bad = F.col(fraction), (F.col("label") != F.col("pred")).cast("int")
    out = pred.groupBy(*keys).agg(
        F.count_if(f < low).alias("low_count"), F.avg(F.when(f < low, bad)).alias("low_error"),
        F.count_if(f >= high).alias("high_count"), F.avg(F.when(f >= high, bad)).alias("high_error"))
    return out.withColumn("eligible", F.least("low_count", "high_count") >= min_n)


def strata_contrast(strata: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Equal-weight means over eligible strata."""
    return strata.where("eligible").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("strata"), F.avg("low_error").alias("low_error"),
        F.avg("high_error").alias("high_error"),
        F.avg(F.col("low_error") - F.col("high_error")).alias("low_minus_high"))


def part_counts(tiles: DataFrame, parts: DataFrame, mapping: str = "parts") -> DataFrame:
    """Explode a part -> pixel-count map and keep the selected tiles."""
    return parts.select("tile_id", F.explode(mapping).alias("part", "pixels")).join(
        tiles.select("tile_id").distinct(), "tile_id", "left_semi")


def part_support(parts: DataFrame) -> DataFrame:
    """Tiles per part, share of all tiles, place among the two largest (0 otherwise), and how many
    tiles those two cover together."""
    pairs = parts.select("tile_id", "part").distinct()
    total = pairs.select("tile_id").distinct().agg(F.count(F.lit(1)).alias("t"))
    sizes = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("tiles"))
    top = sizes.orderBy(F.desc("tiles"), "part").limit(2)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tiles"), "part"))).select("part", "place")
    cover = pairs.join(top, "part", "left_semi").select("tile_id").distinct().agg(F.count(F.lit(1)).alias("c"))
    return (sizes.join(top, "part", "left").fillna(0, ["place"])
            .withColumn("fraction", ratio("tiles", total.scalar())).withColumn("top_two_tiles", cover.scalar()))


# ---- ensembles -------------------------------------------------------------------------

def align_models(pred: DataFrame, n_models: int, item="tile_id", model="member") -> DataFrame:
    """Items that do not have exactly one row from each of ``n_models`` models."""
    pairs = pred.groupBy(item, model).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("models"), F.max("_n").alias("most_rows")).where(
        (F.col("models") != n_models) | (F.col("most_rows") > 1))


def disagreement(pred: DataFrame, keys: list[str], prediction="pred") -> DataFrame:
    """1 - (modal count / members); a single member gives zero."""
    counts = pred.groupBy(*keys, prediction).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg((1.0 - F.max("_n") / F.sum("_n")).alias("disagreement"))


def ensemble_mean(pred: DataFrame, keys: list[str], k: int, prob="prob") -> DataFrame:
    """Mean member probabilities per key, as an array; no explode, one aggregate."""
    return pred.groupBy(*keys).agg(F.array(*[F.avg(F.col(prob)[c]) for c in range(k)]).alias("prob"))


def ensemble_entropy(pred: DataFrame, keys: list[str], k: int) -> DataFrame:
    return ensemble_mean(pred, keys, k).withColumn("entropy", entropy("prob"))


def composite(df: DataFrame, cols: list[str], out: str = "score") -> DataFrame:
    """Mean of the present components after min-max scaling over the whole set (flat range gives 0)."""
    bounds = df.agg(F.struct(*[F.min(c).alias(f"{c}_lo") for c in cols], *[F.max(c).alias(f"{c}_hi") for c in cols]))
    rows = df.withColumn("_b", bounds.scalar())

    def scaled(c):
        lo, hi = F.col(f"_b.{c}_lo"), F.col(f"_b.{c}_hi")
        return F.when(hi - lo < 1e-8, 0.0).otherwise(F.try_divide(F.col(c) - lo, hi - lo))

    total = sum((scaled(c) for c in cols[1:]), scaled(cols[0]))
    return rows.withColumn(out, total / len(cols)).drop("_b")


def distributions(df: DataFrame, cls: str, values: list[str]) -> DataFrame:
    """Rows and mean values by class, and over all rows (class -1)."""
    aggs = lambda: [F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]]
    return df.groupingSets([[cls], []], cls).agg(*aggs()).select(
        F.coalesce(cls, F.lit(-1)).alias("class"), "n", *[f"mean_{v}" for v in values])


def contrast_ratio(df: DataFrame, keys: list[str], cls: str, value: str) -> DataFrame:
    """(max - min) / mean of class means; zero with fewer than two classes or a zero mean."""
    means = df.groupBy(*keys, cls).agg(F.avg(value).alias("_m"))
    return means.groupBy(*keys).agg(F.when(F.count("_m") < 2, 0.0).otherwise(F.coalesce(
        F.try_divide(F.max("_m") - F.min("_m"), F.avg("_m")), F.lit(0.0))).alias("contrast"),
        F.count("_m").alias("classes"))


# ---- training records -------------------------------------------------------------------

def batch_availability(counts: DataFrame, n: str, k: str, batch: int) -> DataFrame:
    """Expected class-bearing batches of a uniform shuffle, with the last partial batch, and the
    upper bound min(K, batches)/batches. Reads whole-number columns n and k."""
    N, K = F.col(n).cast("bigint"), F.col(k).cast("bigint")

    def some(b):  # 1 - C(N-K, b) / C(N, b) as a running product
        none = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(b - 1, F.lit(0)).cast("bigint")), F.lit(1.0),
                           lambda p, i: p * F.try_divide((N - K - i).cast("double"), (N - i).cast("double")))
        return F.when(b <= 0, 0.0).when(N - K < b, 1.0).otherwise(1.0 - none)

    full, rest = F.floor(N / batch), F.pmod(N, F.lit(batch).cast("bigint"))
    out = counts.withColumn("batches", F.ceil(N / batch)).withColumn(
        "expected", full * F.when(full > 0, some(F.lit(batch).cast("bigint"))).otherwise(0.0) + some(rest))
    return out.withColumn("expected_fraction", ratio("expected", "batches")).withColumn(
        "upper_bound", ratio(F.least(K, F.col("batches")), "batches"))


def history_budget(hist: DataFrame, cell: list[str], n_train: Column, batch: int = 32) -> DataFrame:
    """Per cell: epochs, steps, skips, presentations, and whether every epoch spends ceil(n/batch) steps."""
    rows = hist.withColumn("_n", n_train)
    ok = F.col("steps") + F.col("skipped") == F.ceil(F.col("_n") / batch)
    return rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("epochs"), F.sum("steps").alias("steps"), F.sum("skipped").alias("skipped"),
        F.sum("_n").alias("presentations"), F.bool_and(ok).alias("budget_ok"))


def batch_composition(train: DataFrame, item: str, label: str, batch: int, seed, k: int) -> DataFrame:
    """Size, class counts and ordered-member digest of every seeded-shuffle minibatch."""
    ranked = hash_rank(train.select(item, label), [], seed, [item]).withColumn(
        "batch", F.floor((F.col("rank") - 1) / batch))
    members = F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda s: s[item])
    return ranked.groupBy("batch").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count_if(F.col(label) == c).alias(f"class_{c}") for c in range(k)],
        F.sha2(F.to_json(members), 256).alias("digest"))
