"""Per-tile functions and raster tiling. A tile is one row: h, w and a row-major pixel array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.functions.scalars import SPHERE_RADIUS_M, bind, is_finite, scale_clip


def array_sum(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def sorted_quantile(s: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array."""
    pos = F.lit(q) * (F.size(s) - 1)
    lo, hi = F.element_at(s, F.floor(pos).cast("int") + 1), F.element_at(s, F.ceil(pos).cast("int") + 1)
    return lo + (hi - lo) * (pos - F.floor(pos))


def valid_pixels(px, fill: float = 0.0) -> Column:
    return F.filter(px, lambda v: is_finite(v) & (v > 0) & (v != F.lit(fill)))


def tile_stats(tiles: DataFrame, fill: float = 0.0) -> DataFrame:
    """Valid fraction, mean and population SD over finite positive non-fill pixels, 4 decimals, 0 if none."""
    def stats(v):
        n = F.size(v)
        return bind(F.try_divide(array_sum(v), n.cast("double")), lambda m: F.struct(
            n.alias("valid"), m.alias("mean"),
            F.sqrt(F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)),
                                n.cast("double"))).alias("sd")))
    out = tiles.withColumn("_s", bind(valid_pixels("px", fill), stats))
    return out.select(
        *[c for c in tiles.columns if c != "px"],
        F.round(F.col("_s.valid") / F.size("px"), 4).alias("valid_fraction"),
        F.round(F.coalesce("_s.mean", F.lit(0.0)), 4).alias("mean_display_dn"),
        F.round(F.coalesce("_s.sd", F.lit(0.0)), 4).alias("std_display_dn"))


def rejection_reason(fraction, angle=None, min_valid: float = 0.8, lo: float = 0.0, hi: float = 90.0) -> Column:
    """NULL when kept; the valid-fraction rule is applied before the inclusive angle rule."""
    reason = F.when(F.col(fraction) < min_valid, "low_valid_fraction")
    if angle is not None:
        a = F.col(angle)
        bad = F.raise_error(F.lit("incidence angles must be finite for every tile")).cast("boolean")
        reason = reason.when(F.when(is_finite(a), ~a.between(lo, hi)).otherwise(bad), "bad_incidence_angle")
    return reason


def quality_filter(df: DataFrame, fraction: str, angle: str | None, min_valid: float, lo: float,
                   hi: float) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts per rejection reason)."""
    marked = df.withColumn("reason", rejection_reason(fraction, angle, min_valid, lo, hi))
    counts = marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where("reason is null").drop("reason"), counts


def _clean(px) -> Column:
    return F.transform(px, lambda v: F.when(is_finite(v), v.cast("double")).otherwise(0.0))


def stretch_unit(px) -> Column:
    """1/99 percent stretch of a whole tile to [0, 1]; non-finite pixels count as zero."""
    def go(clean):
        return bind(F.array_sort(clean), lambda s: bind(
            F.struct(sorted_quantile(s, 0.01).alias("lo"), sorted_quantile(s, 0.99).alias("hi")),
            lambda b: F.transform(clean, lambda v: F.least(F.greatest(
                (v - b["lo"]) / F.greatest(b["hi"] - b["lo"], F.lit(1e-8)), F.lit(0.0)), F.lit(1.0)))))
    return bind(_clean(px), go)


def stretch_uint8(px) -> Column:
    return F.transform(stretch_unit(px), lambda v: F.bround(v * 255.0, 0).cast("int"))


def stretch_display(px, low: float = 2, high: float = 98) -> Column:
    """Stretch by percentiles of valid pixels only; invalid pixels become NULL, a flat tile 0."""
    px = F.col(px) if isinstance(px, str) else px

    def go(s):
        return bind(F.struct(sorted_quantile(s, low / 100).alias("lo"), sorted_quantile(s, high / 100).alias("hi")),
                    lambda b: F.transform(px, lambda v: F.when(
                        is_finite(v) & (v > 0), F.when(b["hi"] > b["lo"], F.least(F.greatest(F.try_divide(
                            v - b["lo"], b["hi"] - b["lo"]), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))))
    return bind(F.array_sort(valid_pixels(px)), lambda s: F.when(F.size(s) > 0, go(s)).otherwise(
        F.transform(px, lambda v: F.lit(None).cast("double"))))


def normalize_pixels(px, lo: Column, hi: Column) -> Column:
    """Non-finite to zero, then linear scaling clipped to [0, 1]."""
    return F.transform(_clean(px), lambda v: scale_clip(v, lo, hi))


def recenter_raster(cells: DataFrame, width: int, col: str = "c") -> DataFrame:
    """Move a [-180, 180] raster to [0, 360] by rolling columns half the width."""
    return cells.withColumn(col, F.pmod(F.col(col) - width // 2, F.lit(width)))


def tile_grid(spark, height: int, width: int, size: int, ppd: float, lat_top: float = 90.0,
              lon_left: float = 0.0) -> DataFrame:
    """Non-overlapping windows with centre coordinates, row-major tile numbers."""
    rows, cols = height // size, width // size
    grid = spark.range(rows * cols).select(
        F.col("id").alias("tile_id"), (F.floor(F.col("id") / cols) * size).alias("row"),
        (F.pmod("id", F.lit(cols)) * size).alias("col"))
    return (grid.withColumn("center_lat", F.round(F.lit(lat_top) - (F.col("row") + size / 2) / ppd, 4))
            .withColumn("center_lon", F.round(F.lit(lon_left) + (F.col("col") + size / 2) / ppd, 4)))


def metric_centres(rings: DataFrame, footprint_m: float, radius: float = SPHERE_RADIUS_M,
                   stride_m: float | None = None) -> DataFrame:
    """Centres along each latitude ring (column ``ring`` = 0,1,..); the longitude step widens with latitude."""
    stride = footprint_m if stride_m is None else stride_m
    if stride < footprint_m:
        raise ValueError("stride_m must not be smaller than footprint_m")
    step = F.degrees(F.lit(stride / radius))
    lat = rings.select("ring", (F.lit(-90.0) + step / 2 + F.col("ring") * step).alias("lat")).where("lat < 90.0")
    lon_step = F.least(F.lit(360.0), step / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    lat = lat.withColumn("_step", lon_step)
    count = F.ceil((360.0 - F.col("_step") / 2) / F.col("_step")).cast("int")
    return lat.select("ring", "lat", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), "_step").select(
        "ring", "k", "lat", (F.col("_step") / 2 + F.col("k") * F.col("_step")).alias("lon"))


def label_by_site(df: DataFrame, sites: DataFrame, key: str = "site") -> DataFrame:
    """Constant class per site; a row of an unknown site raises inside the job."""
    known = sites.select(key, F.struct(*[c for c in sites.columns if c != key]).alias("_site"))
    site = F.when(F.col("_site").isNotNull(), F.col("_site")).otherwise(
        F.raise_error(F.concat(F.lit("unknown site: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return df.join(known, key, "left").withColumn("_site", site).select(*df.columns, "_site.*")


def map_tiles(tiles: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a user function to Arrow batches of tiles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return tiles.mapInPandas(run, schema)


def unpack_bits(mask, cells: int) -> Column:
    """Little-endian bit order to 0/1 cells, JVM-side: one hex pair per byte."""
    byte = lambda i: F.conv(F.substring(F.hex(mask), F.floor(i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)),
                       lambda i: F.getbit(byte(i), F.pmod(i, F.lit(8))).cast("int"))


def pack_bits(cells, n: int) -> Column:
    """0/1 cells to packed little-endian bytes."""
    def byte(b):
        total = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + F.element_at(
            cells, b * 8 + k + 1).cast("int") * F.pow(F.lit(2.0), k).cast("int"))
        return F.lpad(F.hex(total), 2, "0")
    return F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(n // 8 - 1)), byte)))
