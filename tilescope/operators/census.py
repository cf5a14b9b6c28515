"""Label composition of masked map grids: per-tile counts in four modes, group summaries, cohorts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.functions.scalars import ratio

MODES = ("baseline", "weighted", "all_four", "any_valid")
UNKNOWN = 255


def cell_weight(mask, grid_h: int, grid_w: int) -> Column:
    """Valid mask entries (0-4) under each coarse cell of a mask twice the grid size."""
    wide = grid_w * 2

    def at(k):
        base = F.floor(k / grid_w).cast("int") * 2 * wide + F.pmod(k, F.lit(grid_w)) * 2 + 1
        return sum((F.element_at(mask, base + o) for o in (1, wide, wide + 1)), F.element_at(mask, base))
    return F.transform(F.sequence(F.lit(0), F.lit(grid_h * grid_w - 1)), at)


def count_cells(grids: DataFrame, grid_h: int, grid_w: int, k: int) -> DataFrame:
    """Replace ``grid`` and packed ``mask`` by counts (mode x class), unknown and weight-histogram arrays.

    Each Arrow batch unpacks its little-endian masks and counts as one NumPy block; nothing shuffles.
    """
    keep = [f for f in grids.schema.fields if f.name not in ("grid", "mask")]
    schema = T.StructType([*keep, *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("_counts", "_unknown", "_weights")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.stack([np.asarray(g) for g in pdf["grid"]]).astype(np.int64)
            packed = np.stack([np.frombuffer(m, dtype=np.uint8) for m in pdf["mask"]])
            bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : 4 * grid_h * grid_w]
            w = bits.reshape(-1, grid_h, 2, grid_w, 2).sum(axis=(2, 4), dtype=np.int64).reshape(len(codes), -1)
            slot = np.arange(len(codes))[:, None] * (k + 1) + np.where(codes == UNKNOWN, k, codes)
            per_mode = [np.bincount(slot.ravel(), weights=weight.ravel(), minlength=len(codes) * (k + 1))
                        .reshape(-1, k + 1).astype(np.int64)
                        for weight in (np.ones_like(w), w, (w == 4).astype(np.int64), (w > 0).astype(np.int64))]
            counts = np.stack(per_mode, axis=1)
            out = pdf.drop(columns=["grid", "mask"])
            out["_counts"] = list(counts[:, :, :k].reshape(len(codes), -1))
            out["_unknown"] = list(counts[:, :, k])
            out["_weights"] = list(np.stack([(w == v).sum(axis=1) for v in range(5)], axis=1))
            yield out

    return grids.mapInPandas(run, schema)


def census(grids: DataFrame, grid_h: int, grid_w: int, k: int) -> DataFrame:
    """One row per (tile, mode): ``counts`` array, ``known`` and ``unknown`` cells."""
    keep = [c for c in grids.columns if c not in ("grid", "mask")]
    rows = F.array(*[F.struct(
        F.lit(m).alias("mode"), F.slice("_counts", i * k + 1, k).alias("counts"),
        F.col("_unknown")[i].alias("unknown")) for i, m in enumerate(MODES)])
    return count_cells(grids, grid_h, grid_w, k).select(*keep, F.inline(rows)).withColumn("known", F.aggregate(
        "counts", F.lit(0).cast("bigint"), lambda s, x: s + x))


def weight_histogram(grids: DataFrame, grid_h: int, grid_w: int, k: int) -> DataFrame:
    """Cells per (tile, weight 0-4)."""
    return count_cells(grids, grid_h, grid_w, k).select("tile_id", F.posexplode("_weights").alias("weight", "cells"))


def modal_class(counts) -> Column:
    """Lowest class with the largest count."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")


def with_groups(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Repeat each row for the whole catalog and for every (fold, role) its tile holds.

    ``roles`` has one row per tile: an array of ``fold:role`` names.
    """
    return rows.join(roles, "tile_id").withColumn("grp", F.explode(F.concat(F.array(F.lit("catalog")), "groups"))).drop("groups")


def census_summary(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per group and mode, one row per class: cells, images containing it, images where it is modal,
    with group image, known and unknown totals. One aggregate over K-element arrays."""
    c = F.col("counts")
    agg = rows.groupBy(*keys, "mode").agg(
        F.count(F.lit(1)).alias("images"), F.sum("known").alias("known_total"), F.sum("unknown").alias("unknown_total"),
        F.array(*[F.struct(F.lit(i).alias("class"), F.sum(c[i]).alias("cells"),
                           F.count_if(c[i] > 0).alias("containing"),
                           F.count_if(F.col("modal") == i).alias("modal_images"),
                           F.sum(F.when(F.col("modal") != i, c[i]).otherwise(0)).alias("cells_elsewhere"))
                  for i in range(k)]).alias("_cls"))
    return agg.select(*keys, "mode", "images", "known_total", "unknown_total", F.inline("_cls"))


def modal_matrix(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cells of each class (columns) by modal class of the image (rows)."""
    agg = rows.groupBy(*keys, "mode", "modal").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(k)]).alias("_n"))
    return agg.select(*keys, "mode", "modal", F.posexplode("_n").alias("class", "cells"))


def presence_share(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Images containing a class against modal images, and the share of its cells in other mixtures."""
    return summary.select(*keys, "class", "containing", "modal_images", "cells", "cells_elsewhere",
                          ratio("cells_elsewhere", "cells").alias("share_elsewhere"))


# ---- predictions against map composition -----------------------------------------------------

def map_rows(pred: DataFrame, counts: DataFrame, cls: int) -> DataFrame:
    """Per prediction and mode: composition of the map under the image, NULL fractions without known cells."""
    j = pred.join(counts.select("tile_id", "mode", "counts", "known", "unknown"), "tile_id")
    at = lambda c: F.element_at("counts", F.col(c).cast("int") + 1)
    return (j.withColumn("correct", F.col("label") == F.col("pred"))
            .withColumn("true_fraction", ratio(at("label"), "known"))
            .withColumn("pred_cells", at("pred")).withColumn("pred_fraction", ratio(at("pred"), "known"))
            .withColumn("single_class", (F.col("known") > 0) & (F.col("counts")[cls] == F.col("known"))))


def map_cohort(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per cohort: images, correct, undefined, errors, explained errors, single-class images."""
    c = F.col("correct")
    return rows.groupBy(*keys, "mode").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(c).alias("correct"),
        F.count_if(F.col("known") == 0).alias("undefined"), F.count_if(~c).alias("errors"),
        F.count_if(~c & (F.col("pred_cells") > 0)).alias("errors_present"),
        F.count_if("single_class").alias("single_class"),
        F.count_if(F.col("single_class") & c).alias("single_class_correct"))


def subset_from_map(rows: DataFrame, keys: list[str], modes: list[str]) -> DataFrame:
    """IDs whose known cells all carry the class in every one of ``modes``."""
    return (rows.where(F.col("mode").isin(modes)).groupBy(*keys)
            .agg(F.bool_and("single_class").alias("_all"), F.count_distinct("mode").alias("_m"))
            .where(F.col("_all") & (F.col("_m") == len(modes))).select(*keys))


def subset_outcomes(pred: DataFrame, subset: DataFrame, family: str, region: str, cls: int) -> DataFrame:
    """Subset hits, TP, FP and predictions of one class per family and region, with pooled rows (region NULL)."""
    rows = pred.join(subset.select("tile_id", F.lit(True).alias("_in")), "tile_id", "left")
    hit, said = F.col("label") == cls, F.col("pred") == cls
    return rows.groupingSets([[family, region], [family]], family, region).agg(
        F.count_if(F.col("_in").isNotNull() & said).alias("subset_correct"), F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"), F.count_if(said).alias("predicted"))
