"""Rasters as tables of square blocks: a row per block with its packed values and validity bits, never a row per cell.

A block (br, bc) holds the cells of rows br * side to (br + 1) * side and columns bc * side to (bc + 1) * side.
``values`` are bands x side x side doubles, ``valid`` their packed bits, ``h`` and ``w`` how far the block's cells
reach. Points and windows meet blocks in chunks of bounded size, so a crowded block is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.scalars import is_finite
from tilescope.operators.tiles import valid_pixels

SIDE = 256
#: Points or window corners that meet a block at once.
CHUNK = 4096
_BLOCK = "br bigint, bc bigint, h int, w int, values binary, valid binary"


def _cells(r, bands: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    n = bands * side * side
    valid = np.unpackbits(np.frombuffer(r.valid, np.uint8), count=n).astype(bool)
    return np.frombuffer(r.values, np.float64).reshape(bands, side, side), valid.reshape(bands, side, side)


def block_runs(runs: DataFrame, bands: int = 1, side: int = SIDE, nodata: float | None = None) -> DataFrame:
    """Blocks of runs (band, r, c0, v): cells of one row and band from column c0 on. A run is cut where blocks meet.

    A cell is valid if it is finite and not ``nodata``; cells that no run holds are not.
    """
    first, last = F.floor(F.col("c0") / side), F.floor((F.col("c0") + F.size("v") - 1) / side)
    start = F.greatest(F.col("bc") * side - F.col("c0"), F.lit(0))
    stop = F.least((F.col("bc") + 1) * side - F.col("c0"), F.size("v"))
    pieces = runs.where(F.size("v") > 0).withColumn("bc", F.explode(F.sequence(first, last))).select(
        F.floor(F.col("r") / side).alias("br"), "bc", F.struct(
            "band", F.pmod("r", F.lit(side)).alias("y"), (F.col("c0") + start - F.col("bc") * side).alias("x"),
            F.slice("v", (start + 1).cast("int"), (stop - start).cast("int")).alias("v")).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cells = np.full((bands, side, side), np.nan)
                h = w = 0
                for p in r.pieces:
                    v = np.asarray(p["v"], dtype=np.float64)
                    cells[p["band"], p["y"], p["x"]:p["x"] + len(v)] = v
                    h, w = max(h, p["y"] + 1), max(w, p["x"] + len(v))
                valid = np.isfinite(cells)
                if nodata is not None:
                    valid &= cells != nodata
                yield pd.DataFrame({"br": [r.br], "bc": [r.bc], "h": [h], "w": [w], "values": [cells.tobytes()], "valid": [np.packbits(valid).tobytes()]})

    return pieces.groupBy("br", "bc").agg(F.collect_list("p").alias("pieces")).mapInPandas(run, _BLOCK)


def cells_of(blocks: DataFrame, bands: int = 1, side: int = SIDE) -> DataFrame:
    """(r, c, band, v, valid) a row per cell within the blocks' reach: for reports on small rasters."""
    def run(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v, ok = _cells(b, bands, side)
                band, y, x = np.indices((bands, b.h, b.w)).reshape(3, -1)
                yield pd.DataFrame({"r": y + b.br * side, "c": x + b.bc * side, "band": band, "v": v[:, :b.h, :b.w].ravel(), "valid": ok[:, :b.h, :b.w].ravel()})
    return blocks.mapInPandas(run, "r bigint, c bigint, band bigint, v double, valid boolean")


def cut_tiles(blocks: DataFrame, size: int, height: Column, width: Column, min_valid: float | None = None, side: int = SIDE) -> DataFrame:
    """size x size tiles (tr, tc, px, valid_fraction) of a raster of one band; partial tiles at its edges drop out.

    ``side`` is a multiple of ``size``, so a block is cut where it lies and nothing is shuffled.
    """
    if side % size:
        raise ValueError("blocks must be cut into whole tiles: their side has to be a multiple of the tile's")
    rows = blocks.select("br", "bc", "h", "w", "values", "valid", F.floor(height / size).cast("bigint").alias("rows"), F.floor(width / size).cast("bigint").alias("cols"))

    def run(batches):
        per = side // size
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v, _ = _cells(b, 1, side)
                tiles = v[0].reshape(per, size, per, size).swapaxes(1, 2).reshape(per * per, size * size)
                tr, tc = b.br * per + np.arange(per * per) // per, b.bc * per + np.arange(per * per) % per
                whole = np.flatnonzero((tr < b.rows) & (tc < b.cols))
                if len(whole):
                    yield pd.DataFrame({"tr": tr[whole], "tc": tc[whole], "px": list(tiles[whole])})

    tiles = rows.mapInPandas(run, "tr bigint, tc bigint, px array<double>").withColumn("valid_fraction", F.size(valid_pixels("px")) / F.lit(size * size))
    return tiles if min_valid is None else tiles.where(F.col("valid_fraction") >= min_valid)


# ---- points ------------------------------------------------------------------------------------

def _chunks(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(br, bc, chunk): the rows of each block in arrays of about CHUNK; a crowded block has many."""
    sizes = rows.groupBy("br", "bc").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts"))
    part = F.pmod(F.xxhash64(*cols), F.col("_parts"))
    return rows.join(sizes, ["br", "bc"]).groupBy("br", "bc", part.alias("_part")).agg(F.collect_list(F.struct(*cols)).alias("chunk")).drop("_part")


def with_halo(blocks: DataFrame, bands: int = 1, side: int = SIDE) -> DataFrame:
    """Blocks of side + 1: each with the first column, row and cell of its right, lower and lower right neighbours.

    Every block sends three thin edges and itself; what no neighbour sends is not valid.
    """
    def send(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v, ok = _cells(b, bands, side)
                for kind, dr, dc, y, x in ((0, 0, 0, side, side), (1, 0, 1, side, 1), (2, 1, 0, 1, side), (3, 1, 1, 1, 1)):
                    yield pd.DataFrame({"br": [b.br - dr], "bc": [b.bc - dc], "kind": [kind], "values": [np.ascontiguousarray(v[:, :y, :x]).tobytes()],
                                        "valid": [np.packbits(ok[:, :y, :x]).tobytes()]})

    def join(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v, ok = np.full((bands, side + 1, side + 1), np.nan), np.zeros((bands, side + 1, side + 1), bool)
                for p in b.parts:
                    y, x = ((slice(0, side), slice(0, side)), (slice(0, side), slice(side, None)), (slice(side, None), slice(0, side)), (slice(side, None), slice(side, None)))[p["kind"]]
                    shape = v[:, y, x].shape
                    v[:, y, x] = np.frombuffer(p["values"], np.float64).reshape(shape)
                    ok[:, y, x] = np.unpackbits(np.frombuffer(p["valid"], np.uint8), count=int(np.prod(shape))).astype(bool).reshape(shape)
                yield pd.DataFrame({"br": [b.br], "bc": [b.bc], "values": [v.tobytes()], "valid": [np.packbits(ok).tobytes()]})

    sent = blocks.mapInPandas(send, "br bigint, bc bigint, kind int, values binary, valid binary")
    own = sent.groupBy("br", "bc").agg(F.collect_list(F.struct("kind", "values", "valid")).alias("parts"))
    return own.where(F.exists("parts", lambda p: p["kind"] == 0)).mapInPandas(join, "br bigint, bc bigint, values binary, valid binary")


def sample_bilinear(points: DataFrame, blocks: DataFrame, lon0: float, lat0: float, dlon: Column, dlat: Column,
                    width: Column, height: Column, bands: int, side: int = SIDE) -> DataFrame:
    """(tile_id, band, value) where every positive-weight neighbour is valid in every band.

    Pixel-centre convention, both longitude candidates, near-integers snap, no renormalising. With the blocks'
    halo a point meets one block: one join row for each chunk of points.
    """
    lon360 = F.pmod("lon", F.lit(360.0))
    inside = lambda x: (x >= lon0) & (x <= F.lit(lon0) + dlon * width)
    x = F.when(inside(lon360), lon360).when(inside(lon360 - 360.0), lon360 - 360.0)
    snap = lambda v: F.when(F.abs(v - F.rint(v)) <= 1e-9, F.rint(v)).otherwise(v)
    p = points.where(is_finite("lat") & is_finite("lon") & F.col("lat").between(-90.0, 90.0))
    p = p.select("tile_id", snap((x - lon0) / dlon - 0.5).alias("_c"), snap((lat0 - F.col("lat")) / dlat - 0.5).alias("_r"))
    p = p.where((F.col("_r") >= 0) & (F.col("_r") <= height - 1) & (F.col("_c") >= 0) & (F.col("_c") <= width - 1))
    br, bc = F.floor(F.col("_r") / side), F.floor(F.col("_c") / side)
    p = p.select("tile_id", br.alias("br"), bc.alias("bc"), (F.col("_r") - br * side).alias("y"), (F.col("_c") - bc * side).alias("x"))
    kind = points.schema["tile_id"].dataType.simpleString()
    meets = _chunks(p, ["tile_id", "y", "x"]).join(with_halo(blocks, bands, side), ["br", "bc"])

    def run(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v, ok = _cells(b, bands, side + 1)
                ids = [q["tile_id"] for q in b.chunk]
                y, x = (np.asarray([q[c] for q in b.chunk]) for c in "yx")
                y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
                dy, dx = y - y0, x - x0
                value, good = np.zeros((bands, len(ids))), np.ones((bands, len(ids)), bool)
                for yy, xx, weight in ((y0, x0, (1 - dy) * (1 - dx)), (y0, x0 + 1, (1 - dy) * dx), (y0 + 1, x0, dy * (1 - dx)), (y0 + 1, x0 + 1, dy * dx)):
                    at = weight > 0
                    good[:, at] &= ok[:, yy[at], xx[at]]
                    value[:, at] += weight[at] * np.where(ok[:, yy[at], xx[at]], v[:, yy[at], xx[at]], 0.0)
                band, i = np.nonzero(np.broadcast_to(good.all(axis=0), good.shape))
                yield pd.DataFrame({"tile_id": pd.Series(ids, dtype=object).iloc[i].to_numpy(), "band": band.astype(np.int32), "value": value[band, i]})

    return meets.select("chunk", "values", "valid").mapInPandas(run, f"tile_id {kind}, band int, value double")


# ---- windows -----------------------------------------------------------------------------------

def _class_prefixes(blocks: DataFrame, k: int, height: int, width: int, side: int) -> DataFrame:
    """(br, bc, codes, left, top, corner) of every block of the raster: its classes, and what lies before it.

    ``left`` counts each class's cells above a row of the block in all blocks to its left, ``top`` those left of a column in all
    blocks above, ``corner`` those in all blocks above and to the left: with the sums inside a block they give the class counts of
    all cells above and left of any place of the raster. A row or a column of blocks is summed up in one task, from edges of
    k x (side + 1) counts each.
    """
    n_r, n_c = -(-height // side), -(-width // side)
    every = blocks.sparkSession.range(n_r * n_c).select(F.floor(F.col("id") / n_c).alias("br"), F.pmod("id", F.lit(n_c)).alias("bc"))

    def edges(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                codes = np.full((side, side), -1, np.int8)
                if b.values is not None:
                    v, ok = _cells(b, 1, side)
                    ok = ok[0] & (v[0] >= 0) & (v[0] < k)
                    codes[ok] = v[0][ok].astype(np.int8)
                of = np.stack([codes == c for c in range(k)])
                zero = np.zeros((k, 1), np.int64)
                down, across = (np.concatenate([zero, np.cumsum(of.sum(axis=a), axis=1)], axis=1) for a in (2, 1))
                yield pd.DataFrame({"br": [b.br], "bc": [b.bc], "codes": [codes.tobytes()], "down": [down.tobytes()], "across": [across.tobytes()]})

    def along(pdf, by, edge):
        pdf = pdf.sort_values(by)
        own = np.stack([np.frombuffer(e, np.int64).reshape(k, side + 1) for e in pdf[edge]])
        return pdf, np.cumsum(own, axis=0) - own

    def left(pdf):
        pdf, before = along(pdf, "bc", "down")
        return pd.DataFrame({"br": pdf["br"], "bc": pdf["bc"], "across": pdf["across"], "left": [e.tobytes() for e in before], "beside": [e[:, -1].copy().tobytes() for e in before]})

    def top(pdf):
        pdf, before = along(pdf, "br", "across")
        beside = np.stack([np.frombuffer(e, np.int64) for e in pdf["beside"]])
        return pd.DataFrame({"br": pdf["br"], "bc": pdf["bc"], "left": pdf["left"], "top": [e.tobytes() for e in before],
                             "corner": [e.tobytes() for e in np.cumsum(beside, axis=0) - beside]})

    made = every.join(blocks.select("br", "bc", "values", "valid"), ["br", "bc"], "left").mapInPandas(edges, "br bigint, bc bigint, codes binary, down binary, across binary")
    lefts = made.drop("codes").groupBy("br").applyInPandas(left, "br bigint, bc bigint, across binary, left binary, beside binary")
    tops = lefts.groupBy("bc").applyInPandas(top, "br bigint, bc bigint, left binary, top binary, corner binary")
    return made.select("br", "bc", "codes").join(tops, ["br", "bc"])


def zonal_mode(tiles: DataFrame, blocks: DataFrame, half: int, k: int, height: int, width: int, side: int = SIDE) -> DataFrame:
    """(tile_id, label, confidence): modal class of the clamped window around each (row, col) centre; -1 and 0.0 when nothing is valid.

    Class counts of a window are differences of summed-area tables at its four corners, so a window costs the same
    whatever its area and however many blocks it spans. Classes are 0 to k - 1; other values count as not valid.
    """
    win = tiles.select("tile_id", F.greatest(F.col("row") - half, F.lit(0)).alias("r0"), F.least(F.col("row") + half, F.lit(height)).alias("r1"),
                       F.greatest(F.col("col") - half, F.lit(0)).alias("c0"), F.least(F.col("col") + half, F.lit(width)).alias("c1"))
    corner = lambda sign, r, c: F.struct(F.lit(sign).alias("sign"), F.col(r).cast("bigint").alias("r"), F.col(c).cast("bigint").alias("c"))
    corners = win.where("r1 > r0 and c1 > c0").select("tile_id", F.inline(F.array(corner(1, "r1", "c1"), corner(-1, "r0", "c1"), corner(-1, "r1", "c0"), corner(1, "r0", "c0"))))
    br, bc = F.floor((F.col("r") - 1) / side), F.floor((F.col("c") - 1) / side)
    corners = corners.where("r > 0 and c > 0").select("tile_id", "sign", br.alias("br"), bc.alias("bc"), (F.col("r") - br * side).alias("y"), (F.col("c") - bc * side).alias("x"))
    meets = _chunks(corners, ["tile_id", "sign", "y", "x"]).join(_class_prefixes(blocks, k, height, width, side), ["br", "bc"])
    kind = tiles.schema["tile_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                codes = np.frombuffer(b.codes, np.int8).reshape(side, side)
                left, top = (np.frombuffer(e, np.int64).reshape(k, side + 1) for e in (b.left, b.top))
                before = np.frombuffer(b.corner, np.int64)
                y, x, sign = (np.asarray([q[c] for q in b.chunk], np.int64) for c in ("y", "x", "sign"))
                counts = before[:, None] + left[:, y] + top[:, x]
                for c in range(k):
                    sums = np.zeros((side + 1, side + 1), np.int64)
                    sums[1:, 1:] = (codes == c).cumsum(axis=0).cumsum(axis=1)
                    counts[c] += sums[y, x]
                yield pd.DataFrame({"tile_id": [q["tile_id"] for q in b.chunk], "n": list((counts * sign).T)})

    found = meets.select("chunk", "codes", "left", "top", "corner").mapInPandas(run, f"tile_id {kind}, n array<bigint>")
    sums = found.groupBy("tile_id").agg(F.array(*[F.sum(F.get("n", F.lit(c))) for c in range(k)]).alias("n"))
    out = tiles.select("tile_id").join(sums, "tile_id", "left")
    total = F.coalesce(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, v: s + v), F.lit(0))
    best = F.array_max("n")
    return out.withColumn("_t", total).select(
        "tile_id", F.when(F.col("_t") > 0, F.array_position("n", best) - 1).otherwise(-1).cast("int").alias("label"),
        F.when(F.col("_t") > 0, F.round(F.try_divide(best, F.col("_t")), 4)).otherwise(0.0).alias("confidence"))
