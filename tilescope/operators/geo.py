"""Distance joins and spatial folds, without cross joins.

Points live in cubes of a 3-D grid on the unit sphere, so poles and the date line need no special
case: a great-circle distance d is a chord 2 sin(d / 2R), and two points closer than that are in
neighbouring cubes of that edge. Occupied cubes decide for all their rows where they can, and split where they
cannot; right-side points are packed into blocks of about BLOCK rows, and a join emits (left row, block), never point pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.scalars import SPHERE_RADIUS_M, haversine, in_holdout, sector, sector_role
from tilescope.session import cut_lineage

BLOCK = 1024
#: Blocks of a group's points that a row may have to meet before cells are split once more, and how often they may be.
FEW, LEVELS = 3, 12
CROWD = 512


def _cube(edge: float) -> Column:
    lat, lon = F.radians("lat"), F.radians("lon")
    at = lambda x: F.floor(x / F.lit(edge)).cast("int")
    return F.struct(at(F.cos(lat) * F.cos(lon)).alias("x"), at(F.cos(lat) * F.sin(lon)).alias("y"),
                    at(F.sin(lat)).alias("z"))


def _around(cube: str) -> Column:
    offsets = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
                        for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    c = F.col(cube)
    return F.transform(offsets, lambda o: F.struct((c["x"] + o["x"]).alias("x"), (c["y"] + o["y"]).alias("y"),
                                                   (c["z"] + o["z"]).alias("z")))


def _blocks(points: DataFrame, by: list[str]) -> DataFrame:
    """Pack (lat, lon) into arrays of about BLOCK points per key; a hot key becomes many blocks."""
    size = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    return (points.join(size, by)
            .withColumn("_part", F.pmod(F.xxhash64("lat", "lon", F.col("_row")), F.col("_parts")))
            .groupBy(*by, "_part").agg(F.collect_list(F.struct("lat", "lon")).alias("block")))


def _chord(distance_m: float, radius: float) -> float:
    return max(2.0 * math.sin(min(distance_m / radius, math.pi) / 2.0) * (1 + 1e-9), 1e-12)


def _cover(left: DataFrame, right: DataFrame, group: str, edge: float) -> tuple[list[tuple[float, DataFrame]], float, DataFrame]:
    """Cells of ``left`` settled as a whole, (cell edge, (cube, group)) for each level, and what is left: (edge, (cube, group, b, n)).

    Occupied cells meet occupied cells, rows do not take part. A pair of cells whose farthest corners are nearer
    than ``edge`` settles the left cell for the group; one whose nearest corners are not is dropped; the others are
    split into cells of half the edge, as long as some left cell still has more than FEW blocks of points to look at.
    """
    cell = edge
    pairs = (left.select(_cube(cell).alias("_home")).distinct().withColumn("b", F.explode(_around("_home")))
             .join(right.groupBy(group, _cube(cell).alias("b")).agg(F.count(F.lit(1)).alias("n")), "b").select(F.col("_home").alias("cube"), group, "b", "n"))
    settled = []
    for level in range(LEVELS):
        apart = [F.abs(F.col(f"cube.{c}") - F.col(f"b.{c}")).cast("double") for c in "xyz"]
        far, near = (sum((F.greatest(o + step, F.lit(0.0)) * F.greatest(o + step, F.lit(0.0)) for o in apart), F.lit(0.0)) * cell**2 for step in (1, -1))
        judged = cut_lineage(pairs.withColumn("_in", far < edge**2 * (1 - 1e-9)).where(near < edge**2 * (1 + 1e-9)))
        sure = judged.where("_in").select("cube", group).distinct()
        settled.append((cell, sure))
        open_pairs = judged.join(sure, ["cube", group], "left_anti").drop("_in")
        most = open_pairs.groupBy("cube", group).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FEW * BLOCK or level == LEVELS - 1:
            return settled, cell, open_pairs
        cell /= 2
        half = lambda c: F.struct(*[F.floor(F.col(f"{c}.{x}") / 2).cast("int").alias(x) for x in "xyz"])
        mine = left.select(_cube(cell).alias("_a")).distinct().withColumn("cube", half("_a"))
        other = right.groupBy(group, _cube(cell).alias("_b")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", half("_b"))
        pairs = open_pairs.drop("n").join(mine, "cube").join(other, [group, "b"]).select(F.col("_a").alias("cube"), group, F.col("_b").alias("b"), "n")


def near_groups(left: DataFrame, right: DataFrame, group: str, distance_m: float,
                radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """(tile_id, group) for every right group with a point strictly nearer than ``distance_m``.

    Cells decide first, at the coarsest level that can (``_cover``); only rows of cells at a group's rim meet its
    points, those of their cell's open partners, packed into blocks: a row is joined once for each block, and
    stops at the first hit inside one.
    """
    edge = _chord(distance_m, radius)
    l = left.select("tile_id", "lat", "lon")
    r = right.select(group, "lat", "lon")
    settled, cell, open_pairs = _cover(l, r, group, edge)
    sure = [l.withColumn("cube", _cube(size)).join(cubes, "cube").select("tile_id", group) for size, cubes in settled]
    points = open_pairs.select("cube", group, "b").join(r.withColumn("b", _cube(cell)), [group, "b"]).drop("b").distinct()
    blocks = _blocks(points.withColumn("_row", F.lit(0)), ["cube", group])
    hit = F.exists("block", lambda p: haversine(F.col("lat"), F.col("lon"), p["lat"], p["lon"], radius) < distance_m)
    found = l.withColumn("cube", _cube(cell)).join(blocks, "cube").where(hit).select("tile_id", group)
    return reduce(DataFrame.unionByName, [found, *sure]).distinct()


def within(left: DataFrame, right: DataFrame, distance_m: float, radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """Left rows with ``exposed``: is any right point strictly nearer than ``distance_m``?"""
    near = near_groups(left, right.withColumn("_g", F.lit(1)), "_g", distance_m, radius)
    return left.join(near.select("tile_id", F.lit(True).alias("exposed")), "tile_id", "left").fillna(False, ["exposed"])


def _nearest_within(left: DataFrame, blocks: DataFrame, edge: float, radius: float) -> DataFrame:
    looking = left.withColumn("_home", _cube(edge)).withColumn("cube", F.explode(_around("_home"))).drop("_home")
    best = F.array_min(F.transform("block", lambda p: haversine(F.col("lat"), F.col("lon"), p["lat"], p["lon"], radius)))
    return (looking.join(blocks, "cube").select("tile_id", best.alias("distance_m"))
            .groupBy("tile_id").agg(F.min("distance_m").alias("distance_m")))


def nearest(left: DataFrame, right: DataFrame, radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """(tile_id, distance_m) to the nearest right point, exact at any distance; one row per left row.

    ``distance_m`` is NULL for a left row without coordinates and when no right point has any.

    The search radius starts near the right side's mean spacing, or finer until no cube holds more
    than a few blocks, and grows fourfold for rows still without an answer inside it: crowded places
    settle in the fine rounds, far rows are still exact.
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    l = left.select("tile_id", "lat", "lon").where(known)
    r = cut_lineage(right.select("lat", "lon").where(known).distinct()).withColumn("_row", F.lit(0))
    n = r.count()
    blank = left.where(F.lit(n == 0) | ~known).select("tile_id", F.lit(None).cast("double").alias("distance_m"))
    if not n:
        return blank
    reach = radius * math.sqrt(4.0 * math.pi / n) * 2.0

    def crowd(metres):
        cubes = r.groupBy(_cube(_chord(metres, radius)).alias("cube")).agg(F.count(F.lit(1)).alias("n"))
        return cubes.agg(F.max("n")).first()[0] or 0

    while reach > 1.0 and crowd(reach) > CROWD:
        reach /= 4.0
    done = blank
    while True:
        edge = _chord(reach, radius)
        blocks = _blocks(r.withColumn("cube", _cube(edge)), ["cube"])
        last = reach >= math.pi * radius
        found = _nearest_within(l, blocks, edge, radius)
        sure = cut_lineage(found if last else found.where(F.col("distance_m") <= reach))
        done = done.unionByName(sure)
        if last:
            return done
        l = cut_lineage(l.join(sure, "tile_id", "left_anti"))
        if l.isEmpty():
            return done
        reach *= 4.0


def exposure_support(flags: DataFrame, keys: list[str]) -> DataFrame:
    return flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("exposed").alias("exposed"))


def sector_folds(points: DataFrame, n: int, gap_m: float, radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """All folds of contiguous sectors with distance buffers: (tile_id, fold, role, reason).

    Which sectors (or the holdout) come within the gap of each point is found once; every fold's
    ordered rules then read that set. Equality at the gap is kept.
    """
    area = F.when(in_holdout("lat", "lon"), -1).otherwise(sector("lon", n))
    placed = points.withColumn("area", area)
    near = near_groups(placed, placed, "area", gap_m, radius).groupBy("tile_id").agg(F.collect_set("area").alias("near"))
    rows = (placed.join(near, "tile_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
            .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("original", sector_role("lat", "lon", n, "fold")))
    return rows.select("tile_id", "label", "fold", "original", buffer_reason("fold", n).alias("reason")).withColumn(
        "role", F.when(F.col("reason").isNotNull(), "buffer_excluded").otherwise(F.col("original")))


def buffer_reason(fold: str, n: int) -> Column:
    """First rule that excludes a row, reading ``original`` role and the ``near`` area set."""
    test, val = F.col(fold), F.pmod(F.col(fold) + 1, F.lit(n))
    near = lambda a: F.array_contains("near", a)
    role = F.col("original")
    return (F.when((role != "holdout") & near(F.lit(-1)), "holdout_buffer")
            .when((role == "val") & near(test), "val_buffer")
            .when((role == "train") & (near(val) | near(test)), "train_buffer"))


def apply_buffers(points: DataFrame, role: str, gap_m: float, radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """One fold's buffers from an existing role column (holdout / test / val / train)."""
    near = near_groups(points, points, role, gap_m, radius).groupBy("tile_id").agg(F.collect_set(role).alias("near"))
    rows = points.join(near, "tile_id", "left")
    has = lambda r: F.coalesce(F.array_contains("near", F.lit(r)), F.lit(False))
    own = F.col(role)
    reason = (F.when((own != "holdout") & has("holdout"), "holdout_buffer")
              .when((own == "val") & has("test"), "val_buffer")
              .when((own == "train") & (has("val") | has("test")), "train_buffer"))
    return rows.withColumn("reason", reason).drop("near")


# ---- balanced block folds ---------------------------------------------------------------------------

MAX_BLOCKS = 100_000


def block_folds(df: DataFrame, block: str, label: str, n: int) -> DataFrame:
    """Whole blocks to folds, largest first, each to the fold that stays most even in class and size.

    Only per-block class counts meet in one task; a sphere has a fixed number of blocks, and more
    than MAX_BLOCKS is refused.
    """
    counts = df.groupBy(block, label).agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("by_class"))
    if blocks.limit(MAX_BLOCKS + 1).count() > MAX_BLOCKS:
        raise ValueError("too many blocks for a greedy assignment; use larger blocks")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        per_block = {b: dict(c) for b, c in zip(pdf[block], pdf["by_class"])}
        totals: dict = {}
        for c in per_block.values():
            for cls, m in c.items():
                totals[cls] = totals.get(cls, 0) + m
        rows = sum(totals.values())
        load = [{cls: 0 for cls in totals} for _ in range(n)]
        size, out = [0] * n, []
        for b in sorted(per_block, key=lambda b: (-sum(per_block[b].values()), str(b))):
            c = per_block[b]
            grow = sum(c.values())

            def cost(f):
                rise = sum(((load[f][k] + m) / totals[k]) ** 2 - (load[f][k] / totals[k]) ** 2 for k, m in c.items())
                return rise + ((size[f] + grow) / rows) ** 2 - (size[f] / rows) ** 2
            f = min(range(n), key=lambda i: (cost(i), i))
            for k, m in c.items():
                load[f][k] += m
            size[f] += grow
            out.append((b, f))
        return pd.DataFrame(out, columns=[block, "fold"])

    kind = dict(df.dtypes)[block]
    folds = blocks.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(assign, f"{block} {kind}, fold int")
    return df.join(folds, block)
