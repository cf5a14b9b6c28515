"""Ordered computations that keep no group in one task: running totals, exact quantiles, seeded ranks.

A plain window over a key sorts that key's whole group in one task. Here rows are dealt to range
partitions by key and order, so that a key's rows lie in consecutive partitions, however many it
has; totals per key and partition give offsets, and windows run inside partitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.functions.scalars import seeded_hash
from tilescope.session import cut_lineage, small_side


def ranged(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """``df`` sorted into range partitions by ``keys``, then ``order``, evaluated once and kept; ``_b`` numbers the partitions.

    Rows equal in all of these share a partition; no other rows have to. Results must not depend on where the cuts lie.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_b", F.spark_partition_id()))


def bucketed(df: DataFrame, keys: list[str], order: str, sums: list[str],
             descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_b``, one row per (keys, _b) with totals ``_t_*`` and exclusive offsets ``_o_*``).

    A key has a row for each partition it touches, all keys together as many as there are keys and partitions.
    """
    rows = ranged(df, keys, F.desc(order) if descending else F.asc(order))
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select("*", *[
        F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums], *[
        F.sum(f"_t_{s}").over(whole).alias(f"_a_{s}") for s in sums])
    return rows, cut_lineage(offsets)


def _cumulate(rows, offsets, keys, order, sums, descending):
    by = [*keys, "_b"]
    edge = F.col(order).desc() if descending else F.col(order).asc()
    upto = Window.partitionBy(*by).orderBy(edge).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets.select(*by, *[f"_{p}_{s}" for s in sums for p in "oa"]), by)
    return joined.select(*by, *[c for c in rows.columns if c not in by], *[
        (F.col(f"_o_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums], *[
        F.col(f"_a_{s}").alias(f"all_{s}") for s in sums])


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str],
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<s>`` and the key's total ``all_<s>`` per summed column. Rows must be unique on (keys, order)."""
    rows, offsets = bucketed(df, keys, order, sums, descending)
    return _cumulate(rows, offsets, keys, order, sums, descending).drop("_b")


def _around_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], margin: int) -> DataFrame:
    """(keys, q, _v, _core, _frac, _n): distinct values within ``margin`` rows of each quantile's
    position; ``_core`` marks the one or two values it interpolates."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("n")))
    rows, offsets = bucketed(counts, keys, "_v", ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    overlaps = lambda lo, hi, m: (first <= hi + m) & (last >= lo - m)
    totals = offsets.groupBy(*keys).agg(F.sum("_t_n").alias("_n"))
    pos = (totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
           .withColumn("_p", F.col("q") * (F.col("_n") - 1))
           .select(*keys, "q", "_n", (F.col("_p") - F.floor("_p")).alias("_frac"),
                   F.floor("_p").alias("_lo"), F.ceil("_p").alias("_hi")))
    spans = offsets.select(*keys, "_b", F.col("_o_n").alias("_from"),
                           (F.col("_o_n") + F.col("_t_n")).alias("_to"))
    meets = (F.col("_hi") + margin >= F.col("_from")) & (F.col("_lo") - margin < F.col("_to"))
    # one row per quantile and bucket it touches: both sides are a few hundred rows per key
    placed = (pos.join(spans, keys).where(meets) if keys else pos.join(spans, meets)).drop("_from", "_to")
    # only buckets that hold a wanted position are sorted
    hit = rows.join(placed.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    cum = _cumulate(hit, offsets, keys, "_v", ["n"], False)
    near = cum.join(placed, [*keys, "_b"]).where(overlaps(F.col("_lo"), F.col("_hi"), margin))
    return near.select(*keys, "q", "_v", overlaps(F.col("_lo"), F.col("_hi"), 0).alias("_core"), "_frac", "_n")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles, one row per (keys, q): columns ``q``, ``value``, ``n``."""
    near = _around_quantiles(df, keys, value, qs, 0)
    lo, hi = F.min("_v"), F.max("_v")
    return near.groupBy(*keys, "q").agg(
        (lo + (hi - lo) * F.first("_frac")).cast("double").alias("value"), F.first("_n").alias("n"))


def values_near_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], margin: int) -> DataFrame:
    """(keys, q, mark, value): each quantile with every distinct value within ``margin`` rows of it."""
    near = _around_quantiles(df, keys, value, qs, margin)
    core = lambda f: f(F.when(F.col("_core"), F.col("_v")))
    both = near.groupBy(*keys, "q").agg(
        (core(F.min) + (core(F.max) - core(F.min)) * F.first("_frac")).cast("double").alias("mark"),
        F.collect_set("_v").alias("_vs"))
    return both.select(*keys, "q", "mark", F.explode("_vs").alias(value))


def hash_rank(df: DataFrame, keys: list[str], seed, ids: list[str], out: str = "rank") -> DataFrame:
    """1-based rank in seeded md5 order within keys, over range partitions of that order."""
    rows = ranged(df.withColumn("_h", seeded_hash(seed, *ids)), keys, "_h", *ids)
    by = [*keys, "_b"]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy(*by).orderBy("_h", *ids)
    return (rows.join(offsets, by)
            .withColumn(out, (F.row_number().over(inside) + F.col("_o")).cast("bigint"))
            .drop("_h", "_b", "_o"))


#: Hash digits counted at a time, and the rows of a key that may be ranked at once.
DIGITS = 3
RANKED = 10_000


def hash_first(df: DataFrame, keys: list[str], quota: DataFrame, seed, ids: list[str]) -> DataFrame:
    """Of each key's rows, those with the ``_quota`` smallest seeded hashes; ``quota`` has a row per key (one, without keys).

    The hash at which a key's quota is reached is found from counts of its leading digits; where more than
    RANKED rows share them, the next digits of those rows are counted, until few do. Rows above it go, and rows
    below it stay, without being shuffled or ranked; only the few at it are ranked. A group's size does not matter.
    """
    rows = df.withColumn("_h", seeded_hash(seed, *ids))

    def beside(cuts: DataFrame) -> DataFrame:
        if keys:
            return rows.join(small_side(cuts), keys)
        one = cuts.first()
        return rows.withColumns({c: F.lit(v) for c, v in one.asDict().items()}) if one else rows.where("false").withColumns({c: F.lit(None).cast(t) for c, t in cuts.dtypes})

    cuts = quota.select(*keys, F.col("_quota").cast("bigint").alias("_quota"), F.lit("").alias("_cut"), F.lit(0).cast("bigint").alias("_below"))
    for digits in range(DIGITS, 33, DIGITS):
        counts = (beside(cuts).where(F.startswith("_h", F.col("_cut"))).groupBy(*keys, "_quota", "_below", F.substring("_h", 1, digits).alias("_cut"))
                  .agg(F.count(F.lit(1)).alias("_n")))
        earlier = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        reached = (counts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                   .where(F.col("_below") < F.col("_quota")).groupBy(*keys).agg(F.max_by(F.struct("_quota", "_cut", "_below", "_n"), "_cut").alias("_m")))
        found = cut_lineage(reached.select(*keys, "_m.*"))
        cuts = found.drop("_n")
        if (found.agg(F.max("_n")).first()[0] or 0) <= RANKED:
            break
    near = cut_lineage(beside(cuts).where(F.substring("_h", F.lit(1), F.length("_cut")) <= F.col("_cut")))
    at = F.startswith("_h", F.col("_cut"))
    w = Window.partitionBy(*keys).orderBy("_h", *ids)
    ranked = near.where(at).withColumn("_r", F.row_number().over(w) + F.col("_below")).where(F.col("_r") <= F.col("_quota"))
    return near.where(~at).select(*df.columns).unionByName(ranked.select(*df.columns))


def hash_sample(df: DataFrame, n: int, seed, ids: list[str], keys: list[str] = ()) -> DataFrame:
    """Fixed-size sample without replacement, per key when keys are given: the ``n`` smallest seeded hashes.

    A small one of all rows is a top-n; others go by ``hash_first``.
    """
    if not keys and n <= RANKED:
        return df.withColumn("_h", seeded_hash(seed, *ids)).orderBy("_h", *ids).limit(n).drop("_h")
    quota = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return hash_first(df, list(keys), quota.withColumn("_quota", F.lit(n)), seed, ids)


def with_previous(df: DataFrame, keys: list[str], order: str, cols: list[str],
                  descending: bool = False) -> DataFrame:
    """Add ``prev``: a struct of the preceding row's ``cols`` in key order, NULL on the first row.

    Lag runs inside partitions; only each partition's last row crosses their edges.
    """
    edge = F.col(order).desc() if descending else F.col(order).asc()
    rows = ranged(df, keys, edge)
    by = [*keys, "_b"]
    what = F.struct(*cols)
    last = F.min_by(what, order) if descending else F.max_by(what, order)
    lasts = rows.groupBy(*by).agg(last.alias("_last"))
    lasts = lasts.select(*by, F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    inside = F.lag(what).over(Window.partitionBy(*by).orderBy(edge))
    return (rows.join(lasts, by).withColumn("prev", F.coalesce(inside, F.col("_before")))
            .drop("_b", "_before"))
