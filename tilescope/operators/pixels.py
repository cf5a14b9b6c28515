"""Pixel-distribution estimators: seeded samples, normalisation bounds and quantile maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.scalars import from_db, is_finite, to_db
from tilescope.operators.ordering import exact_quantiles, hash_sample
from tilescope.operators.tiles import normalize_pixels
from tilescope.session import cut_lineage, small_side

MAX_QUANTILES = 10_000


def sample_pixels(train: DataFrame, tiles: DataFrame, n_tiles: int, per_tile: int, seed) -> tuple[DataFrame, DataFrame]:
    """(pixels, report): up to ``n_tiles`` training tiles and ``per_tile`` finite positive pixels of each.

    The report has one row per chosen tile with status used / empty / missing.
    """
    chosen = hash_sample(train.select("tile_id"), n_tiles, seed, ["tile_id"])
    found = chosen.join(tiles.select("tile_id", "px"), "tile_id", "left")
    good = F.size(F.filter("px", lambda v: is_finite(v) & (v > 0)))
    report = found.select("tile_id", F.when(F.col("px").isNull(), "missing").when(good == 0, "empty")
                          .otherwise("used").alias("status"))
    long = found.select("tile_id", F.posexplode("px").alias("pos", "v")).where(is_finite("v") & (F.col("v") > 0))
    return hash_sample(long, per_tile, seed, ["tile_id", "pos"], ["tile_id"]), report


def percentile_range(sample: DataFrame, value: str = "v", low: float = 1.0, high: float = 99.0,
                     default: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """One row lo, hi, fallback: exact percentiles, or the default when empty or nearly flat."""
    q = exact_quantiles(sample, [], value, [low / 100, high / 100])
    b = q.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bad = F.col("lo").isNull() | (F.col("hi") - F.col("lo") < 1e-6)
    return b.select(F.when(bad, default[0]).otherwise(F.col("lo")).alias("lo"),
                    F.when(bad, default[1]).otherwise(F.col("hi")).alias("hi"), bad.alias("fallback"))


def moment_range(catalog: DataFrame, mean: str, sd: str, sigmas: float = 3.0,
                 default: tuple[float, float] = (-30.0, 0.0)) -> DataFrame:
    """Mean of tile means +- sigmas * sqrt(mean within-variance + variance of means)."""
    m = catalog.agg(F.avg(mean).alias("mu"), F.var_pop(mean).alias("between"),
                    F.when(F.count(sd) == F.count(F.lit(1)), F.avg(F.col(sd) * F.col(sd))).alias("within"))
    sigma = F.sqrt(F.greatest(F.coalesce("within", F.lit(0.0)) + F.col("between"), F.lit(0.0)))
    m = m.withColumn("sigma", F.when(sigma == 0.0, 1.0).otherwise(sigma))
    return m.select(F.coalesce(F.col("mu") - F.col("sigma") * sigmas, F.lit(default[0])).alias("lo"),
                    F.coalesce(F.col("mu") + F.col("sigma") * sigmas, F.lit(default[1])).alias("hi"))


def normalize(tiles: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scale every role's pixels with one row of bounds fitted on training tiles."""
    b = bounds.select(F.struct("lo", "hi")).scalar()
    return (tiles.withColumn("_b", b)
            .withColumn("px", normalize_pixels("px", F.col("_b.lo"), F.col("_b.hi"))).drop("_b"))


@dataclass(frozen=True)
class QuantileMap:
    """Matched quantiles per group (group ``None`` is the global map); at most MAX_QUANTILES pairs each."""

    pairs: dict

    def table(self, group=None):
        return self.pairs.get(group)


def _levels(n: int) -> list[float]:
    if not 2 <= n <= MAX_QUANTILES:
        raise ValueError(f"quantile count must be in [2, {MAX_QUANTILES}]")
    return [i / (n - 1) for i in range(n)]


# ---- quantiles of arrays ------------------------------------------------------------------

def _sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned integers that order like finite floats of the same width."""
    top = np.array(1 << (values.itemsize * 8 - 1), f"u{values.itemsize}")
    bits = np.ascontiguousarray(values + values.dtype.type(0)).view(top.dtype)  # -0.0 becomes 0.0
    return np.where(bits & top, ~bits, bits | top)


def _value(bits: int, width: int) -> float:
    top = 1 << (width * 8 - 1)
    raw = np.array([bits ^ top if bits & top else bits ^ (2 * top - 1)], f"u{width}")
    return float(raw.view(f"f{width}")[0])


def array_quantiles(tiles: DataFrame, keys: list[str], px: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles over the finite pixels of arrays: one row (keys, q, value, n) for each key and level.

    Selection by radix: a pass counts 16 bits of the pixels at a time, from the top, in mergeable histograms of at most 65,536
    entries for each prefix that a wanted position still lies in; float arrays take two passes, double arrays four. Pixels never
    become rows, and what is shuffled are counts. Keys with no finite pixel have no row.
    """
    kinds = dict(tiles.dtypes)
    width = 4 if kinds[px] == "array<float>" else 8
    cols = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    lead = cols + ", " if keys else ""
    key_of = lambda r: tuple(r[: len(keys)])
    tiles = tiles.where(F.col(px).isNotNull())
    wanted = None
    for shift in range(width * 8 - 16, -1, -16):
        first = wanted is None
        if first:
            rows = tiles.select(*keys, F.col(px).alias("_px"))
        else:
            alive = wanted.select(*keys, "prefix").distinct()
            prefixes = alive.groupBy(*keys).agg(F.sort_array(F.collect_list("prefix")).alias("_p")) if keys else alive.agg(F.sort_array(F.collect_list("prefix")).alias("_p"))
            rows = tiles.select(*keys, F.col(px).alias("_px"))
            rows = rows.join(small_side(prefixes), keys) if keys else rows.withColumn("_p", prefixes.scalar())

        def count(batches, shift=shift, first=first):
            for pdf in batches:
                acc: dict = {}
                for r in pdf.itertuples(index=False):
                    v = np.asarray(r[len(keys)], dtype=f"f{width}")
                    bits = _sortable(v[np.isfinite(v)]) >> np.array(shift, f"u{width}")
                    if not first:
                        known = np.asarray(r[len(keys) + 1], dtype=np.int64)
                        mine = (bits >> np.array(16, bits.dtype)).astype(np.int64)
                        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        bits = bits[known[at] == mine] if len(known) else bits[:0]
                    acc.setdefault(key_of(r), []).append(bits)
                for key, parts in acc.items():
                    bits, n = np.unique(np.concatenate(parts), return_counts=True)
                    if len(bits):
                        yield pd.DataFrame({**{k: [v] * len(bits) for k, v in zip(keys, key)}, "prefix": (bits >> np.array(16, bits.dtype)).astype(np.int64) if shift < width * 8 - 16 else np.zeros(len(bits), np.int64),
                                            "digit": (bits & np.array(0xFFFF, bits.dtype)).astype(np.int32), "n": n})

        counts = rows.mapInPandas(count, lead + "prefix bigint, digit int, n bigint").groupBy(*keys, "prefix", "digit").agg(F.sum("n").alias("n"))
        hist = counts.groupBy(*keys, "prefix").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("h"))
        if first:
            hist = cut_lineage(hist)  # read for the totals and again for the digits
            total = hist.select(*keys, "prefix", F.aggregate("h", F.lit(0).cast("bigint"), lambda s, e: s + e["n"]).alias("total"))
            level = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
            wanted = total.withColumn("q", level).withColumn("_at", F.col("q") * (F.col("total") - 1)).select(
                *keys, "prefix", "q", "total", (F.col("_at") - F.floor("_at")).alias("part"), F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("rank"))
        places = wanted.groupBy(*keys, "prefix").agg(F.collect_list(F.struct("q", "total", "part", "rank")).alias("w"))
        met = hist.join(places, [*keys, "prefix"])

        def choose(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    digits, upto = np.array([e["digit"] for e in r.h], np.int64), np.cumsum([e["n"] for e in r.h])
                    rank = np.array([e["rank"] for e in r.w], np.int64)
                    k = np.searchsorted(upto, rank, side="right")
                    found = np.array([r.prefix], np.int64).astype(np.uint64) << np.uint64(16) | digits[k].astype(np.uint64)
                    yield pd.DataFrame({**{c: [v] * len(k) for c, v in zip(keys, key_of(r))}, "prefix": found.astype(np.int64), **{c: [e[c] for e in r.w] for c in ("q", "total", "part")},
                                        "rank": rank - np.where(k > 0, upto[k - 1], 0)})

        wanted = cut_lineage(met.select(*keys, "prefix", "h", "w").mapInPandas(choose, lead + "prefix bigint, q double, total bigint, part double, rank bigint"))

    def values(batches):
        for pdf in batches:
            bits = pdf["prefix"].to_numpy(np.int64).astype(np.uint64)
            yield pdf.drop(columns=["prefix", "rank"]).assign(v=[_value(int(b), width) for b in bits])

    ends = wanted.select(*keys, "q", "total", "part", "prefix", "rank").mapInPandas(values, lead + "q double, total bigint, part double, v double")
    lo, hi = F.min("v"), F.max("v")
    return ends.groupBy(*keys, "q").agg((lo + (hi - lo) * F.first("part")).alias("value"), F.first("total").alias("n"))


def quantile_pairs(source: DataFrame, target: DataFrame, px: str, n: int, keys: list[str] = (),
                   min_n: int = 0) -> DataFrame:
    """Rows (keys, q, source, target) of matched exact quantiles of two sets of pixel arrays; thin groups are left out."""
    keys = list(keys)
    s = array_quantiles(source, keys, px, _levels(n)).select(*keys, "q", F.col("value").alias("source"), F.col("n").alias("_ns"))
    t = array_quantiles(target, keys, px, _levels(n)).select(*keys, "q", F.col("value").alias("target"), F.col("n").alias("_nt"))
    return s.join(t, [*keys, "q"]).where((F.col("_ns") >= min_n) & (F.col("_nt") >= min_n)).drop("_ns", "_nt")


def fit_quantile_map(source: DataFrame, target: DataFrame, px: str, n: int = 1000) -> QuantileMap:
    rows = quantile_pairs(source, target, px, n).orderBy("q").collect()  # n rows
    return QuantileMap({None: ([r["source"] for r in rows], [r["target"] for r in rows])})


def fit_quantile_map_by_class(source: DataFrame, target: DataFrame, px: str, label: str, n: int = 500,
                              min_n: int = 10) -> QuantileMap:
    """One map per class; classes with fewer than ``min_n`` values on a side keep the identity.

    For a list of classes, whose maps fit a worker; ``quantile_pairs`` keeps maps of any number of groups as a table.
    """
    rows = quantile_pairs(source, target, px, n, [label], min_n).orderBy(label, "q").collect()  # n rows per class
    pairs: dict = {}
    for r in rows:
        s, t = pairs.setdefault(r[label], ([], []))
        s.append(r["source"])
        t.append(r["target"])
    return QuantileMap(pairs)


def apply_quantile_map(values: Column, qmap: QuantileMap, group: Column | None = None) -> Column:
    """Piecewise-linear mapping of a pixel array, clamped at both ends; unmapped groups pass through."""
    pairs = qmap.pairs

    @F.pandas_udf("array<double>")
    def run(px: pd.Series, key: pd.Series) -> pd.Series:
        if not len(px):
            return pd.Series([], dtype=object)
        flat = np.concatenate([np.asarray(v, dtype=float) for v in px])
        sizes = px.str.len().to_numpy(int)
        owner = np.repeat(np.arange(len(px)), sizes)
        for k in key.drop_duplicates():  # one interpolation per group of the batch
            p = pairs.get(None if pd.isna(k) else k)
            if p is not None:
                mine = (key.isna() if pd.isna(k) else key == k).to_numpy()[owner]
                flat[mine] = np.interp(flat[mine], p[0], p[1])
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]), dtype=object)

    return run(values, F.lit(None).cast("int") if group is None else group)


def remap_tile(px: str, qmap: QuantileMap) -> Column:
    """Linear tile to dB, through the map, and back to linear."""
    db = F.transform(px, lambda v: to_db(v))  # the second parameter is a floor, not the position
    return F.transform(apply_quantile_map(db, qmap), from_db)
