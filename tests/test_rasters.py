"""Blocked rasters against plain arrays: reading, cutting, bilinear samples over block edges, window counts by corners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.operators import rasters as X
from tilescope.sources import readers


def runs_of(spark, arrays, cut=5):
    """Runs of at most ``cut`` cells of bands x rows x columns; NaN cells stay in, None rows are left out."""
    rows = [(b, r, c, [float(v) for v in a[r, c:c + cut]]) for b, a in enumerate(arrays) for r in range(a.shape[0]) for c in range(0, a.shape[1], cut)]
    return spark.createDataFrame(rows, "band int, r bigint, c0 bigint, v array<double>")


def test_runs_become_blocks_and_cells_again(spark, tmp_path):
    a = np.arange(2 * 7 * 11, dtype=float).reshape(2, 7, 11)
    a[0, 2, 3], a[1, 6, 10], a[0, 0, 0] = np.nan, -9, np.inf
    runs_of(spark, a, 6).write.parquet(str(tmp_path / "r"))
    blocks = readers.read_raster(spark, str(tmp_path / "r"), bands=2, side=4, nodata=-9.0)
    assert {(r.br, r.bc, r.h, r.w) for r in blocks.collect()} == {(i, j, 4 - i, 4 - (j == 2)) for i in range(2) for j in range(3)}
    cells = X.cells_of(blocks, 2, 4).collect()
    assert len(cells) == a.size
    for r in cells:
        v = a[r.band, r.r, r.c]
        assert r.valid == (np.isfinite(v) and v != -9) and (r.v == v or np.isnan(v))
    some = readers.read_raster(spark, str(tmp_path / "r"), bands=2, side=4, rows=(5, 6))
    assert {r.br for r in some.collect()} == {1} and "PushedFilters: [IsNotNull(r), GreaterThanOrEqual(r,4)" in some._jdf.queryExecution().toString()
    assert readers.read_raster(spark, str(tmp_path / "r"), 2, 4).where("false").count() == 0


def test_tiles_are_cut_where_blocks_lie(spark):
    a = np.random.default_rng(0).normal(size=(13, 22))
    blocks = X.block_runs(runs_of(spark, [a]), side=8)
    got = {(r.tr, r.tc): r for r in X.cut_tiles(blocks, 4, F.lit(13), F.lit(22), side=8).collect()}
    assert set(got) == {(i, j) for i in range(3) for j in range(5)}
    for (i, j), r in got.items():
        t = a[4 * i:4 * i + 4, 4 * j:4 * j + 4]
        assert r.px == t.ravel().tolist() and r.valid_fraction == (t > 0).mean()
    half = X.cut_tiles(blocks, 4, F.lit(13), F.lit(22), 0.5, side=8).collect()
    assert {(r.tr, r.tc) for r in half} == {k for k, r in got.items() if r.valid_fraction >= 0.5}
    assert "Exchange" not in X.cut_tiles(spark.read.parquet(written(blocks)), 4, F.lit(13), F.lit(22), side=8)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        X.cut_tiles(blocks, 3, F.lit(13), F.lit(22), side=8)


def written(df):
    import tempfile
    path = tempfile.mkdtemp(prefix="spark-") + "/b"
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("chunk", [4096, 3])
def test_bilinear_over_block_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, 9, 12))
    a[:, 4, 7] = np.nan  # at the corner of four blocks of side 4
    a[1, 0, 1] = np.nan
    r, c = rng.uniform(-0.7, 8.7, 80), rng.uniform(-0.7, 11.7, 80)
    r[:12], c[:12] = [4, 3, 3.5, 8, 0, 3, 3.5, 4, 7.5, 0, 0.5, 3], [4, 3.5, 3, 11, 0, 7, 7.5, 6, 3.5, 2, 2, 3]
    p = spark.createDataFrame([(f"p{i}", float(90.0 - (r[i] + 0.5) * 20), float((c[i] + 0.5) * 30)) for i in range(80)] + [("n", None, 1.0)], "tile_id string, lat double, lon double")
    blocks = X.block_runs(runs_of(spark, a), bands=2, side=4)
    got = {(x.tile_id, x.band): x.value for x in X.sample_bilinear(p, blocks, 0.0, 90.0, F.lit(30.0), F.lit(20.0), F.lit(12), F.lit(9), 2, side=4).collect()}
    want = {}
    for i in range(80):
        y, x = (round(v) if abs(v - round(v)) < 1e-9 else v for v in (r[i], c[i]))
        if not (0 <= y <= 8 and 0 <= x <= 11):
            continue
        y0, x0 = int(y), int(x)
        near = [(yy, xx, (1 - abs(y - yy)) * (1 - abs(x - xx))) for yy in (y0, y0 + 1) for xx in (x0, x0 + 1)]
        near = [(yy, xx, w) for yy, xx, w in near if w > 0]
        if all(np.isfinite(a[:, yy, xx]).all() for yy, xx, _ in near):
            for b in range(2):
                want[f"p{i}", b] = sum(w * a[b, yy, xx] for yy, xx, w in near)
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert X.sample_bilinear(p.where("false"), blocks, 0.0, 90.0, F.lit(30.0), F.lit(20.0), F.lit(12), F.lit(9), 2, side=4).count() == 0


@pytest.mark.parametrize("half", [1, 3, 40])
def test_window_counts_by_corners(spark, half):
    rng = np.random.default_rng(2)
    a = rng.integers(-1, 5, (14, 19)).astype(float)  # 0 to 3 are classes, -1 and 4 are not
    a[:8, 8:16] = -1  # a block without a valid cell
    runs = runs_of(spark, [a]).where("not (r < 8 and c0 = 10)")  # and with cells that are missing
    centres = [(i, int(rng.integers(-2, 17)), int(rng.integers(-2, 22))) for i in range(60)]
    t = spark.createDataFrame(centres, "tile_id bigint, row bigint, col bigint")
    got = {r.tile_id: (r.label, r.confidence) for r in X.zonal_mode(t, X.block_runs(runs, side=4), half, 4, 14, 19, side=4).collect()}
    held = a.copy()
    held[:8, 10:15] = -1
    for i, y, x in centres:
        w = held[max(0, y - half):max(0, min(14, y + half)), max(0, x - half):max(0, min(19, x + half))]
        n = [int((w == k).sum()) for k in range(4)]
        assert got[i] == ((int(np.argmax(n)), round(max(n) / sum(n), 4)) if sum(n) else (-1, 0.0))
