"""Tiles, textures, census, geography and files on hand-made inputs."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.operators import census as C
from tilescope.operators import errors as R
from tilescope.operators import geo as G
from tilescope.operators import membership as J
from tilescope.operators import pixels as N
from tilescope.operators import quality as Q
from tilescope.operators import textures as X
from tilescope.operators import tiles as T
from tilescope.sources import readers, writers


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "tile_id bigint, lat double, lon double")


def brute(a, b, r=S.SPHERE_RADIUS_M):
    p, q = np.radians(np.asarray(a, float)), np.radians(np.asarray(b, float))
    h = np.sin((p[:, None, 0] - q[None, :, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[None, :, 0]) * np.sin((p[:, None, 1] - q[None, :, 1]) / 2) ** 2
    return 2 * r * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


@pytest.mark.parametrize("block", [1024, 3])
def test_nearest_and_within_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rng = np.random.default_rng(2)
    a = [(89.9, 10), (-89.9, 200), (0, 359.99), (0, 0.01)] + [(rng.uniform(-90, 90), rng.uniform(0, 360)) for _ in range(40)]
    b = [(89.8, 190), (0.2, 0.0)] + [(rng.uniform(10, 40), rng.uniform(0, 90)) for _ in range(30)] + [(20.0, 30.0)] * 50
    want = brute(a, b).min(axis=1)
    got = {r.tile_id: r.distance_m for r in G.nearest(points(spark, a), points(spark, b)).collect()}
    assert len(got) == len(a) and all(got[i] == pytest.approx(want[i], abs=1e-3) for i in range(len(a)))
    for d in (50_000.0, 400_000.0):
        flags = {r.tile_id: r.exposed for r in G.within(points(spark, a), points(spark, b), d).collect()}
        assert [flags[i] for i in range(len(a))] == list(want < d)


@pytest.mark.parametrize("few", [3, 0])
def test_cells_settle_most_rows(spark, monkeypatch, few):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(G, "BLOCK", 16)
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G, "LEVELS", 6)
    lat, lon = rng.uniform(-60, 60, 1500), rng.uniform(0, 360, 1500)
    a = points(spark, np.stack([lat, lon], axis=1)).withColumn("g", (F.col("lon") > 180).cast("int"))
    d, edge = 400_000.0, G._chord(400_000.0, G.SPHERE_RADIUS_M)
    got = {(r.tile_id, r.g) for r in G.near_groups(a, a, "g", d).collect()}
    la, lo = np.radians(lat), np.radians(lon)
    unit = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    near = G.SPHERE_RADIUS_M * np.arccos(np.clip(unit.T @ unit, -1, 1)) < d
    side = (lon > 180).astype(int)
    assert got == {(i, g) for i in range(1500) for g in (0, 1) if near[i][side == g].any()}
    settled, cell, left = G._cover(a.select("tile_id", "lat", "lon"), a.select("g", "lat", "lon"), "g", edge)
    meets = a.select(G._cube(cell).alias("cube")).join(left.groupBy("cube", "g").agg(F.ceil(F.sum("n") / G.BLOCK).alias("copies")), "cube")
    copies = (meets.agg(F.sum("copies")).first()[0] or 0) / 1500
    assert copies < 4 and (few or copies < 1) and len(settled) > 1


def test_buffer_rule_order_and_equality(spark):
    rows = [(0, 0.0, 0.0, "test"), (1, 0.0, 1.0, "val"), (2, 0.0, 2.0, "train"), (3, 0.0, 4.0, "train"), (4, 0.0, 4.5, "holdout")]
    df = spark.createDataFrame(rows, "tile_id bigint, lat double, lon double, role string")
    gap = S.SPHERE_RADIUS_M * np.radians(1.0)
    near = {r.tile_id: r.reason for r in G.apply_buffers(df, "role", gap * 1.000001).collect()}
    assert near == {0: None, 1: "val_buffer", 2: "train_buffer", 3: "holdout_buffer", 4: None}
    kept = {r.tile_id: r.reason for r in G.apply_buffers(df, "role", gap * 0.999999).collect()}
    assert kept[1] is None and kept[2] is None


def test_block_folds_keep_blocks_whole(spark):
    df = spark.createDataFrame([(i, f"b{i % 12}", i % 3) for i in range(240)], "i bigint, block string, label int")
    out = G.block_folds(df, "block", "label", 4)
    assert out.select("block", "fold").distinct().count() == 12
    assert {r["count"] for r in out.groupBy("fold").count().collect()} == {60}


def test_constant_and_empty_tiles(spark):
    df = spark.createDataFrame([(0, [5.0] * 4), (1, [0.0, -1.0, float("nan"), float("inf")])], "tile_id bigint, px array<double>")
    rows = {r.tile_id: r for r in T.tile_stats(df).collect()}
    assert (rows[0].valid_fraction, rows[0].mean_display_dn, rows[0].std_display_dn) == (1.0, 5.0, 0.0)
    assert (rows[1].valid_fraction, rows[1].mean_display_dn, rows[1].std_display_dn) == (0.0, 0.0, 0.0)
    shown = {r.tile_id: r.d for r in df.select("tile_id", T.stretch_display("px").alias("d")).collect()}
    assert shown[0] == [0.0] * 4 and shown[1] == [None] * 4
    flat = X.intensity(np.full((1, 2, 2), 7.0))[0]
    assert flat[0] == 7.0 and list(flat[1:4]) == [0.0, 0.0, 0.0]


def test_cooccurrence_hand_values():
    patch = np.array([[0, 0, 1], [1, 2, 2], [2, 2, 3]], float) * 16
    tile = np.zeros((1, 3, 3))
    tile[0] = patch
    q = (X.stretch(tile)[0] // 16)[0].astype(int)
    m = np.zeros((16, 16))
    for r in range(3):
        for c in range(2):
            m[q[r, c], q[r, c + 1]] += 1
            m[q[r, c + 1], q[r, c]] += 1
    p = m / m.sum()
    i, j = np.indices(p.shape)
    got = X.glcm(tile)[0]
    assert got[0] == pytest.approx((p * (i - j) ** 2).sum()) and got[12] == pytest.approx(np.sqrt((p ** 2).sum()))
    assert X.glcm(np.ones((1, 6, 6)))[0][16] == 1.0


def test_texture_shapes_and_flat_tile():
    block = np.random.default_rng(0).uniform(1, 9, size=(3, 16, 16))
    assert X.classical(block).shape == (3, 13 + 32 + 20 + 10 + 12 + 1764 + 14)
    hist = X.lbp(np.ones((1, 5, 5)))[0]
    assert hist.sum() == pytest.approx(1.0) and hist[8] > 0  # interior of a flat tile: all neighbours reach it
    image = np.arange(16.0).reshape(1, 4, 4)
    small = X.haar(np.kron(image, np.ones((1, 1, 1))))
    a = np.array([[0 + 1 + 4 + 5, 2 + 3 + 6 + 7], [8 + 9 + 12 + 13, 10 + 11 + 14 + 15]]) / 2
    assert small[0, 0] == pytest.approx(abs(a.sum() / 2))
    assert np.allclose(X.resize(np.full((1, 128, 128), 0.3)), 0.3)


def test_census_matches_scalar_count(spark):
    rng = np.random.default_rng(4)
    grid = rng.choice([0, 1, 2, 3, 4, 5, 255], size=(6, 4, 4))
    mask = rng.integers(0, 2, size=(6, 8, 8))
    rows = [(i, [int(v) for v in grid[i].ravel()], bytearray(np.packbits(mask[i].ravel(), bitorder="little").tobytes())) for i in range(6)]
    df = spark.createDataFrame(rows, "tile_id bigint, grid array<int>, mask binary")
    w = mask.reshape(6, 4, 2, 4, 2).sum(axis=(2, 4))
    weight = {"baseline": np.ones_like(w), "weighted": w, "all_four": (w == 4) * 1, "any_valid": (w > 0) * 1}
    for r in C.census(df, 4, 4, 6).collect():
        m = weight[r.mode][r.tile_id]
        assert r.counts == [int(m[grid[r.tile_id] == c].sum()) for c in range(6)]
        assert r.unknown == int(m[grid[r.tile_id] == 255].sum())
    bits = df.select("tile_id", T.unpack_bits(F.col("mask"), 64).alias("b")).collect()
    assert all(r.b == list(mask[r.tile_id].ravel()) for r in bits)
    packed = spark.createDataFrame([(0, [int(v) for v in mask[0].ravel()])], "i int, b array<int>").select(T.pack_bits(F.col("b"), 64).alias("p")).first().p
    assert bytes(packed) == bytes(rows[0][2])


def test_normalisation_sees_training_tiles_only(spark):
    tiles = spark.createDataFrame([(i, [float(i + 1)] * 3) for i in range(6)], "tile_id bigint, px array<double>")
    train = spark.createDataFrame([(0,), (1,), (2,), (77,)], "tile_id bigint")
    px, report = N.sample_pixels(train, tiles, 10, 2, 0)
    bounds = N.percentile_range(px).first()
    loud = tiles.withColumn("px", F.when(F.col("tile_id") > 2, F.array(F.lit(1e9))).otherwise(F.col("px")))
    assert N.percentile_range(N.sample_pixels(train, loud, 10, 2, 0)[0]).first() == bounds and not bounds.fallback
    assert {r.tile_id: r.status for r in report.collect()} == {0: "used", 1: "used", 2: "used", 77: "missing"}
    empty = N.percentile_range(px.where("false")).first()
    assert (empty.lo, empty.hi, empty.fallback) == (0.0, 255.0, True)
    assert N.percentile_range(px.where("v = 2")).first().fallback


def test_moment_range_defaults(spark):
    df = spark.createDataFrame([(-10.0, 2.0), (-14.0, 4.0)], "m double, s double")
    r = N.moment_range(df, "m", "s").first()
    sigma = np.sqrt(np.mean([4, 16]) + np.var([-10, -14]))
    assert (r.lo, r.hi) == pytest.approx((-12 - 3 * sigma, -12 + 3 * sigma))
    assert tuple(N.moment_range(df.where("false"), "m", "s").first()) == (-30.0, 0.0)
    assert N.moment_range(df.limit(1).withColumn("s", F.lit(None).cast("double")), "m", "s").first().hi - 3 == pytest.approx(
        df.limit(1).first().m)


def test_quantile_map_clamps_and_passes_unknown_groups(spark):
    src = spark.createDataFrame([([float(v) for v in range(k, 11, 2)], 0) for k in (0, 1)], "v array<double>, label int")
    tgt = src.withColumn("v", F.transform("v", lambda v: v * 10))
    df = spark.createDataFrame([([-5.0, 2.5, 99.0], 0), ([1.0], 1)], "px array<double>, label int")
    qmap = N.fit_quantile_map_by_class(src, tgt, "v", "label", 11)
    got = [r.y for r in df.select(N.apply_quantile_map(F.col("px"), qmap, F.col("label")).alias("y")).collect()]
    assert got == [[0.0, 25.0, 100.0], [1.0]]
    assert N.fit_quantile_map_by_class(src.where("size(v) = 5"), tgt, "v", "label", 11).pairs == {}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_array_quantiles_by_radix(spark, kind):
    rng = np.random.default_rng(3)
    data = [(["a", "b", None][i % 3], rng.normal(size=int(rng.integers(0, 40))) * 10.0 ** rng.integers(-3, 4)) for i in range(40)]
    data = [(k, v.astype(np.float32 if kind == "float" else np.float64)) for k, v in data]
    data += [("a", np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 5.0, 5.0])), ("empty", np.array([np.nan])), ("one", np.array([2.5]))]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in data], f"k string, px array<{kind}>").repartition(3)
    df = df.unionByName(spark.createDataFrame([("a", None)], f"k string, px array<{kind}>"))
    qs = [0.0, 0.013, 0.5, 0.9, 1.0]
    got = {(r.k, r.q): (r.value, r.n) for r in N.array_quantiles(df.where("k is not null"), ["k"], "px", qs).collect()}
    assert {k for k, _ in got} == {"a", "b", "one"}
    for k in ("a", "b", "one"):
        v = np.concatenate([x for c, x in data if c == k]).astype(np.float64)
        v = v[np.isfinite(v)]
        for q in qs:
            assert got[k, q] == (pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), len(v))
    every = np.concatenate([x for _, x in data]).astype(np.float64)
    every = every[np.isfinite(every)]
    assert [r.value for r in N.array_quantiles(df, [], "px", qs).orderBy("q").collect()] == pytest.approx(list(np.quantile(every, qs)))
    assert N.array_quantiles(df.where("k = 'empty'"), ["k"], "px", qs).count() == 0 == N.array_quantiles(df.where("false"), [], "px", qs).count()


@pytest.mark.parametrize("value,bad", [("0", False), ("5", False), ("-1", True), ("6", True), ("1.5", True), ("true", True), ("", True), (None, True), ("99999999999", True)])
def test_label_domain(spark, value, bad):
    df = spark.createDataFrame([(value,)], "label string")
    assert (Q.check_labels(df, 6).count() == 1) is bad


def test_split_join_and_replacement_errors(spark):
    cat = spark.createDataFrame([("a", 0), ("b", 1)], "tile_id string, label int")
    ok = spark.createDataFrame([("a", "train"), ("b", "test")], "tile_id string, role string")
    assert J.apply_split(cat, ok).count() == 2
    with pytest.raises(Exception, match="differ"):
        J.apply_split(cat, ok.where("tile_id = 'a'")).collect()
    with pytest.raises(Exception, match="too few"):
        J.replacement_draw(cat.where("label = 0"), cat, 1).collect()


def test_gate_raises_in_job(spark):
    h = spark.createDataFrame([("x", None)], "name string, space string")
    with pytest.raises(Exception, match="refused"):
        Q.require_gate(h, "name", {"space": F.col("space") == "display"}).collect()


def test_private_text_rules(spark):
    texts = ["see https://x.org/a/b", "ratio 3/4 of 10", "stored in /srv/data", "C:\\temp\\x", "me@host.org: x", "a/b relative", "1/2 3/4 5/6"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i for r in Q.find_private(df, ["i"]).collect()} == {2, 3, 4}


def test_private_text_after_any_separator(spark):
    unix = ["*/srv/x", "!/etc/passwd", "#/root/a", "&/home/u", "\u201c/home/u/x\u201d", "/2024", "a /123 b", "file=/srv/a:http://h/x", "1/2 /3 4/5", "(/a)"]
    other = ["path:C:\\data\\x", "[C:\\x]", "at:me@host:x", "see http://h/x me@host:y"]
    none = ["http://me@h:8/C:\\x/y", "a/b ~/c ./d ../e 5%/f", "1/2, 3 / 4; (5/6) 7.5e3/.2", "abC:\\x", "a / b", "me@host", "\u00e9/x", "", None]
    df = spark.createDataFrame(list(enumerate(unix + other + none)), "i int, t string")
    got = sorted((r.i, r.kind) for r in Q.find_private(df, ["i"]).collect())
    assert got == [(i, "unix") for i in range(len(unix))] + [(len(unix) + i, "drive_or_host") for i in range(len(other))]


def test_safe_corr_and_draws(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    assert df.agg(R.safe_corr("x", "y").alias("r")).first().r == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert df.agg(R.safe_corr("x", F.lit(1.0)).alias("r")).first().r is None
    assert df.limit(1).agg(R.safe_corr("x", "y").alias("r")).first().r is None


def test_constant_sample_is_one_bin(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (1, 1, float("nan"))], "label int, pred int, x double")
    rows = R.binned_accuracy(df, "x", 5).collect()
    assert len(rows) == 1 and rows[0].n == 2 and rows[0].accuracy == 0.5 and rows[0].correlation is None
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            R.binned_accuracy(df, "x", bad)


def test_batch_availability_exact(spark):
    from math import comb
    df = spark.createDataFrame([(70, 3), (64, 0), (10, 10)], "n bigint, k bigint")
    for r in R.batch_availability(df, "n", "k", 32).collect():
        sizes = [32] * (r.n // 32) + ([r.n % 32] if r.n % 32 else [])
        want = sum(1 - (comb(r.n - r.k, b) if r.n - r.k >= b else 0) / comb(r.n, b) for b in sizes)
        assert r.expected == pytest.approx(want) and r.batches == len(sizes)


def test_array_files_round_trip(spark, tmp_path):
    for i in range(4):
        np.save(tmp_path / f"t{i}.npy", np.full((2, 3), i, np.float32))
    ids = spark.createDataFrame([("t1",), ("t3",), ("gone",)], "tile_id string")
    got = {r.tile_id: r for r in readers.read_tiles(spark, str(tmp_path), ids).collect()}
    assert set(got) == {"t1", "t3"} and got["t3"].px == [3.0] * 6 and (got["t1"].h, got["t1"].w, got["t1"].dtype) == (2, 3, "float32")
    assert [r.tile_id for r in readers.missing_tiles(spark, str(tmp_path), ids).collect()] == ["gone"]


def test_feature_arrays_and_key_values(spark, tmp_path):
    def raw(a):
        buf = io.BytesIO()
        np.save(buf, a)
        return bytearray(buf.getvalue())
    df = spark.createDataFrame([(raw(np.eye(2, dtype=np.float32)), raw(np.array([0, 1])), raw(np.array(["a", "b"])))], "features binary, labels binary, ids binary")
    assert {r.tile_id: r.f for r in readers.decode_feature_arrays(df).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    (tmp_path / "x.lbl").write_text('A = 1\n/* B = 2 */\nA = "x = y"\n')
    assert [(r.name, r.value) for r in readers.read_key_values(spark, str(tmp_path / "x.lbl")).collect()] == [("A", "x = y")]


def test_readers_fail_on_bad_input(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "t.csv"), "a int, b int").collect()
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "t.csv"), "a int, c string").collect()
    (tmp_path / "p.json").write_text('{"family":"l","model":"m","fold":0,"seed":0,"tile_ids":["a"],"labels":[1,2],"predictions":[1],"probabilities":[[1.0]]}')
    with pytest.raises(Exception, match="length"):
        readers.read_predictions(spark, str(tmp_path / "p.json")).collect()


def test_writers_never_overwrite_and_validate(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "train"), ("b", 7, "test")], "tile_id string, label int, split string")
    with pytest.raises(Q.CheckFailed):
        writers.write_catalog(df, str(tmp_path / "c"), 6)
    writers.write_catalog(df.where("label = 0"), str(tmp_path / "c"), 6)
    with pytest.raises(Exception):
        writers.write_catalog(df.where("label = 0"), str(tmp_path / "c"), 6)
    with pytest.raises(ValueError):
        writers.write_site_catalog(df, str(tmp_path / "s"), 6)
    writers.write_result(df, str(tmp_path / "r"))
    with pytest.raises(Exception):
        writers.write_result(df, str(tmp_path / "r"))


def test_nearest_keeps_every_left_row(spark):
    left = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "tile_id string, lat double, lon double")
    right = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "lat double, lon double")
    assert {r.tile_id: r.distance_m for r in G.nearest(left, right).collect()} == {"a": 0.0, "b": None}
    assert {r.tile_id: r.distance_m for r in G.nearest(left, right.where("false")).collect()} == {"a": None, "b": None}


def test_unknown_site_raises(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "i int, site string")
    sites = spark.createDataFrame([("x", 3)], "site string, label int")
    assert T.label_by_site(rows.where("i = 1"), sites).first().label == 3
    with pytest.raises(Exception, match="unknown site: y"):
        T.label_by_site(rows, sites).collect()


def test_ranking_refuses_unknown_scores(spark):
    from tilescope.operators import ranking as X
    df = spark.createDataFrame([(0.5, True), (float("nan"), False), (None, True)], "s double, y boolean")
    for bad in ("isnan(s)", "s is null"):
        with pytest.raises(Exception, match="finite scores"):
            X.ranking_curve(df.where(f"s = 0.5 and not isnan(s) or {bad}"), [], "s", F.col("y")).collect()


def test_resize_reflects_without_the_edge():
    w = X._axis_weights(4, 8)  # pixel centres at -0.25, 0.25, 0.75, ...
    assert np.allclose(w[0], [0.75, 0.25, 0, 0]) and np.allclose(w[1], [0.75, 0.25, 0, 0]) and np.allclose(w[-1], [0, 0, 0.25, 0.75])
    ramp = np.arange(128.0)[None, :, None] * np.ones((1, 1, 128))
    small = X.resize(ramp)[0]
    taps = np.exp(-0.5 * (np.arange(-2, 3) / 0.5) ** 2)
    taps /= taps.sum()
    smooth = lambda i: sum(t * abs(i + o) for t, o in zip(taps, range(-2, 3)))  # reflected at 0
    assert np.allclose(small[0], (smooth(0) + smooth(1)) / 2) and np.allclose(small[32], 64.5)


@pytest.mark.parametrize("kind", ["texture", "classical", "glcm"])
def test_tile_features_come_in_blocks_of_bounded_size(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    px = rng.normal(size=(301, 64))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(px)], "tile_id bigint, px array<double>").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)
    whole = X._KINDS[kind]

    def compute(block):
        assert len(block) * X.SIDE * X.SIDE <= X.BLOCK_PIXELS
        sizes.add(len(block))
        return whole(block)

    monkeypatch.setitem(X._KINDS, kind, compute)
    got = rows.select("tile_id", X.tile_features("px", 8, 8, kind).alias("f")).collect()
    want = whole(px.reshape(-1, 8, 8))
    assert sizes.value == 301 and all(np.allclose(r["f"], want[r["tile_id"]], rtol=1e-12, atol=1e-12) for r in got)


def test_cohort_scores_shuffle_each_side_once(spark):
    from tilescope.plans import catalogue

    out = catalogue.QUERIES["j04_scores_by_cohort"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tile_id") <= 3
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sum(r["rows"] for r in out.where("cohort = 'all'").collect()) == n
