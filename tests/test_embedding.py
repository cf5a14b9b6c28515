"""Neighbours, alignment, kernels and fits against brute force on small inputs."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.operators import blocks as B
from tilescope.operators import domain_gap as G
from tilescope.operators import embedding as E
from tilescope.operators import fit as L
from tilescope.operators import metrics as M
from tilescope.plans import evaluate as V


def table(spark, x, labels, start=0):
    return spark.createDataFrame([(start + i, int(y), [float(v) for v in r]) for i, (r, y) in enumerate(zip(x, labels))],
                                 "vec_id bigint, label int, f array<double>")


@pytest.mark.parametrize("k", [0, -1, True, 1.5, "2", None])
def test_bad_k_is_refused(k):
    with pytest.raises(ValueError):
        E.check_k(k)


@pytest.mark.parametrize("block", [512, 7])
def test_neighbours_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(90, 5)), rng.normal(size=(23, 5))
    x[11] = x[40]  # an exact tie goes to the lower id
    got = E.knn_join(table(spark, q, np.zeros(23), 1000), table(spark, x, np.arange(90)), 6).collect()
    unit = lambda a: a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-8)
    sims = np.round(unit(q) @ unit(x).T, 12)
    for i in range(23):
        want = sorted(range(90), key=lambda j: (-sims[i, j], j))[:6]
        assert [r.ref_id for r in sorted((r for r in got if r.vec_id == 1000 + i), key=lambda r: r["rank"])] == want


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 20)
    monkeypatch.setattr(B, "SEEDS", 300)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 10
    x, q = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.3 for n in (1200, 240))
    q[0] = 0.0
    count = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = E.knn_join(table(spark, q, np.zeros(240), 5000), table(spark, x, np.arange(1200)), 5, skipped=count).collect()
    unit = lambda a: a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-8)
    sims = np.round(unit(q) @ unit(x).T, 12)
    for i in range(240):
        want = sorted(range(1200), key=lambda j: (-sims[i, j], j))[:5]
        assert [r.ref_id for r in sorted((r for r in got if r.vec_id == 5000 + i), key=lambda r: r["rank"])] == want
    assert count[1].value > 0.5 * count[0].value > 0


def test_neighbours_cap_k_and_keep_keys_apart(spark):
    ref = table(spark, [[1, 0], [0, 1]], [0, 1]).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).where("not (fold = 1 and vec_id = 0)")
    q = table(spark, [[1, 0.1]], [0], 10).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    got = {(r.fold, r["rank"]): r.ref_id for r in E.knn_join(q, ref, 20, keys=["fold"]).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (1, 1): 1}


def test_vote_tie_goes_to_lowest_class_and_empty_training_fails(spark):
    train = table(spark, [[1, 0], [1, 0.01]], [3, 1])
    test = table(spark, [[1, 0]], [3], 50)
    assert E.knn_classify(train, test, 2).first().pred == 1
    with pytest.raises(Exception, match="nonempty"):
        E.knn_classify(train.where("false"), test, 2).collect()


def test_median_bandwidth_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    for n in (2, 41, 60):
        x = rng.normal(size=(n, 4))
        x[n // 2] = x[0]
        d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(n, 1)]
        want = 1 / np.median(d[d > 0]) if (d > 0).any() else 1.0
        got = G.median_gamma(table(spark, x, np.zeros(n)).repartition(3), 0, "vec_id", max_rows=None).first().gamma
        assert got == pytest.approx(want, rel=1e-9)
    assert G.median_gamma(table(spark, x[:1], [0]), 0, "vec_id", max_rows=None).first().gamma == 1.0


@pytest.mark.parametrize("between,most", [((0.46, 0.54), 1 << 19), ((0.46, 0.54), 3), ((0.9, 0.95), 3)])
def test_median_bandwidth_whatever_the_guess(spark, monkeypatch, between, most):
    monkeypatch.setattr(B, "BLOCK", 7)
    monkeypatch.setattr(G, "LAST_DISTANCES", most)
    monkeypatch.setattr(G, "_guess", lambda df, id_col, f: tuple(np.quantile(d[d > 0], between)))
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(40, 3)), rng.integers(0, 2, (40, 3)), np.eye(3)[[0, 1, 2, 0]], [[0.0], [1.0], [3.0]], [[0.0], [1.0], [1e6]]):
        x = np.asarray(x, float)
        d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        seen, count = [], G._count_between
        monkeypatch.setattr(G, "_count_between", lambda *a: seen.append(a) or count(*a))
        got = G.median_gamma(table(spark, x, np.zeros(len(x))).repartition(3), 0, "vec_id", max_rows=None).first().gamma
        monkeypatch.setattr(G, "_count_between", count)
        assert got == pytest.approx(1 / np.median(d[d > 0]), rel=1e-9) and len(seen) <= 6
        assert most == 3 or len(seen) == 1


def test_blocks_meet_once_and_both_forms_share_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 5)
    x, y, df = domains(spark, 0.3)
    packed = B.pack(df, [], "vec_id", "label").localCheckpoint()
    n = packed.count()
    met = [(r.block_l, r.block_r) for r in B.half_pairs(packed).select("block_l", "block_r").collect()]
    assert len({tuple(sorted(m)) for m in met}) == len(met) == n * (n + 1) // 2 > 100
    sums = []
    kernel = G.kernel_sums
    monkeypatch.setattr(G, "kernel_sums", lambda *a: sums.append(1) or kernel(*a))
    got = {r.form: r for r in G.mmd_rbf_forms(df, "domain", 0, 1, "vec_id").collect()}
    assert sums == [1] and all(got[e].mmd2 == pytest.approx(brute_mmd(x, y, got[e].gamma, e == "unbiased"), abs=1e-12) for e in ("biased", "unbiased"))


def test_kernel_is_one_product_a_tile_and_packs_travel_as_floats(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 5)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    x[7] = x[31]
    for spread in (1.0, 1e5):  # two far clouds of near rows: products alone would lose their distances
        z = x.astype(np.float64)
        z[:30] += 0 if spread == 1 else spread
        z = z.astype(np.float32).astype(np.float64)
        df = table(spark, z, np.arange(60) % 2).withColumn("f", F.col("f").cast("array<float>")).repartition(3)
        assert all(r.size == r.n * 3 * 4 for r in B.pack(df, [], "vec_id", "label", times=2).select("n", F.length("mat").alias("size")).collect())
        kern = np.exp(-0.4 * ((z[:, None] - z[None]) ** 2).sum(-1))
        got = {(r.group_a, r.group_b): r.total for r in G.kernel_sums(df, spark.range(1).select(F.lit(0.4).alias("g")), "label", "vec_id").collect()}
        assert all(got[i, j] == pytest.approx(kern[i::2, j::2].sum(), rel=1e-11) for i in (0, 1) for j in (0, 1))
    a, b = G._exponent_factors(x.astype(float), x.astype(float), 0.4)
    assert np.allclose(a @ b.T, -0.4 * ((x[:, None] - x[None]) ** 2).sum(-1), atol=1e-6) and G._exponent_factors(z, z, 0.4) is None
    packed = B.pack(df, [], "vec_id", "label").localCheckpoint()
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        assert B.half_pairs(packed).rdd.getNumPartitions() == 30  # not put together for being few bytes
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_neighbour_blocks_travel_as_floats_to_few_cells(spark):
    rng = np.random.default_rng(5)
    df = table(spark, rng.normal(size=(300, 8)), np.zeros(300, int)).withColumn("f", F.col("f").cast("array<float>")).withColumn("fold", F.col("vec_id") % 5)
    seeds = spark.sparkContext.broadcast(B.seed_rows(df, ["fold"], "vec_id"))
    packed = B.pack_near(df, ["fold"], "vec_id", "label", seeds).localCheckpoint()
    assert all(r.size == r.n * 8 * 4 for r in packed.select("n", F.length("mat").alias("size")).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        pairs = B.block_pairs(packed, packed, ["fold"], B.hottest_share(seeds))
        assert pairs.count() == sum(n * n for (n,) in packed.groupBy("fold").count().select("count").collect())
        cells = pairs.select("fold", "_gl", "_gr").agg(F.max("_gl"), F.max("_gr")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert B.hottest_share(seeds) == pytest.approx(0.2) and max(cells) < 5
    train, test = df.where("vec_id % 3 > 0"), df.where("vec_id % 3 = 0")
    f = {r.vec_id: np.asarray(r.f, float) for r in df.collect()}
    unit = {k: v / (np.linalg.norm(v) + 1e-8) for k, v in f.items()}
    for r in E.knn_join(test, train, 4, keys=["fold"]).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "ref_id"))).alias("n")).collect():
        refs = [k for k in f if k % 3 and k % 5 == r.vec_id % 5]
        assert [x.ref_id for x in r.n] == sorted(refs, key=lambda k: (-round(float(unit[r.vec_id] @ unit[k]), 12), k))[:4]


def test_grid_scales_and_weighs_a_fold_once_for_all_penalties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 240)
    df = table(spark, rng.normal(size=(240, 4)) + y[:, None] * [1, 0, -1, 2], y).withColumn("fold", F.lit(0)).withColumn(
        "role", F.when(F.col("vec_id") % 4 == 0, "test").when(F.col("vec_id") % 4 == 1, "val").otherwise("train"))
    train, test = (df.where(F.col("role") == r) for r in ("train", "test"))
    want = {}
    for scaled in (False, True):
        a, b = (E.standardize(d, train) if scaled else d for d in (train, test))
        for c in (0.1, 1.0):
            model = L.fit_logistic(a, 3, c, max_iter=50, tol=1e-5)
            m, g = L.evaluate_probe(L.score_linear(b, model), [], 3).first(), L.loss_gradient(a, model, 3, c).first()
            want[scaled, c] = (m.n, m.balanced_accuracy, m.kappa, g.loss)
    calls, weights = [], L._with_weights
    monkeypatch.setattr(L, "standardize", lambda *a: calls.append("scaled") or E.standardize(*a))
    monkeypatch.setattr(L, "_with_weights", lambda t, *a: calls.append("weighed" if "_w" not in t.columns else "kept") or weights(t, *a))
    got = L.fit_grid(df, 3, [0], [False, True], [0.1, 1.0], max_iter=50).collect()
    assert [(r.scaled, r.penalty) for r in got] == [(False, 0.1), (False, 1.0), (True, 0.1), (True, 1.0)]
    assert all((r.n, r.balanced_accuracy, r.kappa, r.loss) == pytest.approx(want[r.scaled, r.penalty], rel=1e-9) for r in got)
    assert calls.count("scaled") == 1 and calls.count("weighed") == 2


def test_neighbour_shuffle_grows_with_the_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        few = B.grid(spark, 0.2, (100_000, 300_000))
        assert few == B.grid(spark, 0.2, (1_000, 3_000)) and few[0] * few[1] <= 6 and few[1] > few[0]
        assert 1 / few[0] >= 0.5  # a reference block travels twice at most
        df = table(spark, np.random.default_rng(9).normal(size=(90, 4)), np.zeros(90, int)).withColumn("fold", F.col("vec_id") % 5)
        seeds = spark.sparkContext.broadcast(B.seed_rows(df, ["fold"], "vec_id"))
        packed = B.pack_near(df, ["fold"], "vec_id", "label", seeds).localCheckpoint()
        pairs = B.block_pairs(packed, packed, ["fold"], 0.2, (90, 90))
        assert pairs.count() == sum(n * n for (n,) in packed.groupBy("fold").count().select("count").collect())
        assert "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()  # whatever the size: a query block meets all its blocks at once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    left, right = B.grid(spark, 1.0, (2_000_000, 9_000_000))
    assert 2_000_000 / left <= B.CELL_ROWS and 9_000_000 / right <= B.CELL_ROWS


def test_neighbours_travel_in_packs_and_single_precision_loses_none(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 20)
    monkeypatch.setattr(B, "PACKS", 2, raising=False)
    rng = np.random.default_rng(12)
    x, q = rng.normal(size=(600, 16)), rng.normal(size=(100, 16))
    x[300:] = x[:300] + 1e-9 * rng.normal(size=(300, 16))  # nearer than single precision tells apart
    q[0] = 0.0  # ties with all
    packs, pairs = [], E.block_pairs
    monkeypatch.setattr(E, "block_pairs", lambda left, right, *a: packs.append((left.count(), right.count())) or pairs(left, right, *a))
    count = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = E.knn_join(table(spark, q, np.zeros(100), 5000), table(spark, x, np.arange(600)), 7, skipped=count).collect()
    unit = lambda a: a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-8)
    sims = np.round(unit(q) @ unit(x).T, 12)
    for i in range(100):
        want = sorted(range(600), key=lambda j: (-sims[i, j], j))[:7]
        found = sorted((r for r in got if r.vec_id == 5000 + i), key=lambda r: r["rank"])
        assert [r.ref_id for r in found] == want and [r.sim for r in found] == pytest.approx([sims[i, j] for j in want], abs=2e-12)
    left, right = packs[0]
    assert 0 < 4 * left * right <= count[0].value  # fewer pairs travel than blocks meet


def test_neighbours_beside_vectors_without_a_direction(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    x[[4, 20], 2] = np.nan, np.inf
    got = E.knn_join(table(spark, q, np.zeros(9), 5000), table(spark, x, np.arange(60)), 12).collect()
    unit = lambda a: a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-8)
    for i in range(9):
        sims = {j: round(float(unit(q)[i] @ unit(x[j: j + 1])[0]), 12) for j in range(60) if np.isfinite(x[j]).all()}
        assert [r.ref_id for r in sorted((r for r in got if r.vec_id == 5000 + i), key=lambda r: r["rank"])] == sorted(sims, key=lambda j: (-sims[j], j))[:12]


def test_kappa_and_absent_class(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0)] * 2, "label int, pred int")
    counts = M.pair_counts(pred, [])
    po, pe = 6 / 10, (6 * 6 + 4 * 4) / 100
    assert M.kappa(counts, [], 3).first().kappa == pytest.approx((po - pe) / (1 - pe))
    rows = {r["class"]: r for r in M.class_metrics(counts, [], 3).collect()}
    assert rows[2].recall is None and rows[2].support == 0
    assert M.macro(M.class_metrics(counts, [], 3), [], "strict").first().macro_f1 is None
    assert M.balanced_accuracy(M.class_metrics(counts, [], 3), []).first().classes_present == 2
    one = M.pair_counts(spark.createDataFrame([(0, 0)], "label int, pred int"), [])
    assert M.kappa(one, [], 2).first().kappa == 1.0


def test_seeds_average_inside_folds_and_pooling_never_mixes_seeds(spark):
    m = spark.createDataFrame([("m", 0, 0, 1.0), ("m", 0, 1, 3.0), ("m", 1, 0, 10.0)], "model string, fold int, seed int, v double")
    s = M.summarize_folds(m, ["model"], "v").first()
    assert s.mean == 6.0 and s.sd == pytest.approx(np.std([2.0, 10.0], ddof=1))
    nulls = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double")
    assert M.summarize_strict(nulls, ["k"], "v").first().mean is None
    assert M.summarize_seeds(nulls, ["k"], "v").first().mean == 1.0


@pytest.mark.parametrize("t,df,p", [(2.776445105, 4, 0.05), (12.7062047, 1, 0.05), (2.570581836, 5, 0.05), (0.0, 3, 1.0), (4.302652730, 2, 0.05)])
def test_t_probability(spark, t, df, p):
    got = spark.range(1).select(M.student_t_two_sided(F.lit(t), F.lit(df)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-8)


def domains(spark, shift, n=40, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, d)), rng.normal(size=(n, d)) + shift])
    df = table(spark, x, [i % 3 for i in range(2 * n)])
    return x[:n], x[n:], df.withColumn("domain", (F.col("vec_id") >= n).cast("int"))


def brute_mmd(x, y, gamma, unbiased):
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    n, m = len(x), len(y)
    if unbiased:
        return (k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean()
    return k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean()


@pytest.mark.parametrize("cap", [2000, None])
def test_kernel_discrepancy_matches_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(B, "BLOCK", 9)
    x, y, df = domains(spark, 0.7)
    z = np.concatenate([x, y])
    d = ((z[:, None] - z[None]) ** 2).sum(-1)[np.triu_indices(80, 1)]
    gamma = 1 / np.median(d[d > 0])
    for est in ("biased", "unbiased"):
        r = G.mmd_rbf(df, "domain", 0, 1, "vec_id", estimator=est, max_samples=cap).first()
        assert r.gamma == pytest.approx(gamma)
        assert r.mmd2 == pytest.approx(brute_mmd(x, y, gamma, est == "unbiased"), abs=1e-12)
    lin = G.mmd_linear(df, "domain", 0, 1, unbiased=True).first().mmd2
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() - x.var(0, ddof=1).sum() / 40 - y.var(0, ddof=1).sum() / 40
    assert lin == pytest.approx(want)


def test_group_resampling_equals_recomputing(spark):
    x, y, df = domains(spark, 0.5)
    r = {v["repeat"]: v.mmd2 for v in G.mmd_groups(df, "domain", 0, 1, "label", "vec_id", "source_jackknife").collect()}
    gamma = G.median_gamma(df, 0, "vec_id").first().gamma
    labels = np.arange(40) % 3
    for i in range(3):
        assert r[i] == pytest.approx(brute_mmd(x[labels != i], y, gamma, False), abs=1e-12)
    boot = G.mmd_groups(df, "domain", 0, 1, "label", "vec_id", "target_bootstrap", repeats=30)
    assert G.resampling_summary(boot).first().repeats == 30


def test_permutation_test_separates(spark):
    far = G.mmd_permutation(domains(spark, 3.0)[2], "domain", 0, 1, "vec_id", permutations=99).first()
    same = G.mmd_permutation(domains(spark, 0.0)[2], "domain", 0, 1, "vec_id", permutations=99).first()
    assert far.p_value == pytest.approx(0.01) and same.p_value > 0.05 and far.n == 40


def test_repeated_estimates_without_cap_are_equal(spark):
    r = G.mmd_repeated(domains(spark, 1.0)[2], "domain", 0, 1, "vec_id", 50, repeats=3).collect()
    assert len(r) == 3 and max(v.mmd2 for v in r) - min(v.mmd2 for v in r) < 1e-12


def test_proxy_distance_bounds(spark):
    assert G.proxy_a_distance(domains(spark, 8.0)[2], "domain", 0, 1, "vec_id").first().a_distance > 1.8
    assert G.proxy_a_distance(domains(spark, 0.0, 150)[2], "domain", 0, 1, "vec_id").first().a_distance < 0.8


def test_coral_moves_source_to_target_moments(spark):
    x, y, df = domains(spark, 2.0, n=300)
    model = E.coral_fit(df, "domain", 0, 1, reg=1e-9)
    t = np.array([r.f for r in df.where("domain = 0").select(E.coral_transform("f", model).alias("f")).collect()])
    assert np.allclose(t.mean(0), y.mean(0)) and np.allclose(np.cov(t.T), np.cov(y.T), atol=1e-6)


def test_standardize_uses_population_sd_and_keeps_constants(spark):
    df = table(spark, [[1, 5], [3, 5], [5, 5]], [0, 0, 0])
    out = np.array([r.f for r in E.standardize(df, df).orderBy("vec_id").collect()])
    assert np.allclose(out[:, 0], (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5])) and np.allclose(out[:, 1], 0)


def test_silhouette_singletons_and_one_class(spark):
    assert E.silhouette(table(spark, [[1, 0], [0, 1]], [0, 0])).first().silhouette == 0.0
    assert E.silhouette(table(spark, [[1, 0], [0, 1]], [0, 1])).first().silhouette == 0.0


def test_mahalanobis_fallbacks(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 2.0), (1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "c int, x double, y double, z double")
    got = sorted(r.score for r in E.mahalanobis(df, ["x", "y", "z"], "c").collect())
    assert got[-1] == pytest.approx(3.0)  # one row: zero mean, identity
    assert got[0] == pytest.approx(np.sqrt(1 / (2 + 1e-6)))


def classes(spark, n=90, d=3):
    rng = np.random.default_rng(5)
    y = np.arange(n) % 3
    return table(spark, rng.normal(size=(n, d)) + 2.5 * np.eye(3)[y], y)


def test_logistic_gradient_vanishes(spark):
    df = classes(spark)
    model = L.fit_logistic(df, 3, tol=1e-10)
    g = L.loss_gradient(df, model, 3).first()
    assert g.gradient_max < 1e-4 and not g.concern
    moved = L.LinearModel(model.coef + 0.1, model.intercept)
    assert L.loss_gradient(df, moved, 3).first().loss > g.loss


@pytest.mark.parametrize("rows", [100_000, 60])
def test_sgd_probe_learns_from_bounded_rows(spark, rows):
    df = classes(spark).withColumn("fold", F.lit(0))
    p = L.fit_sgd_probe(df, ["fold"], 3, 3, [0, 1], "vec_id", lr=0.1, epochs=6, batch=16, max_rows=rows)
    m = L.evaluate_probe(L.score_probes(df, p, ["fold"]), ["seed"], 3).collect()
    assert len(m) == 2 and all(r.balanced_accuracy > 0.85 for r in m)


def plain_sgd(x, y, w, k, seed, lr, epochs, batch):
    """The reference's loop over all rows in order of their ids, held in memory."""
    n, d = x.shape
    theta = np.random.default_rng(seed).uniform(-1 / np.sqrt(d), 1 / np.sqrt(d), (k, d + 1))
    speed, x = 0.0, np.hstack([x, np.ones((n, 1))])
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch]).permutation(n)
        for at in range(0, n, batch):
            i = order[at: at + batch]
            z = x[i] @ theta.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True) - np.eye(k)[y[i]]
            speed = 0.9 * speed + (p * w[i, None]).T @ x[i] / w[i].sum()
            theta = theta - lr * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * speed
    return theta


def test_sgd_probe_fits_on_every_row(spark):
    n = 110_000
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.pmod("id", F.lit(3)).cast("int").alias("label"), F.lit(0).alias("fold"), F.array(
        *[F.sin(F.col("id") * a) + (F.pmod("id", F.lit(3)) == c).cast("double") for c, a in enumerate((0.7, 1.3))]).alias("f"))
    got = L.fit_sgd_probe(df.repartition(5, "f"), ["fold"], 3, 2, [4], "vec_id", epochs=2).first()
    i = np.arange(n)
    x = np.column_stack([np.sin(i * a) + (i % 3 == c) for c, a in enumerate((0.7, 1.3))])
    want = plain_sgd(x, i % 3, np.ones(n), 3, 4, 0.01, 2, 256)
    assert np.column_stack([got.coef, got.intercept]) == pytest.approx(want, abs=1e-9)


def test_sgd_rows_are_shuffled_by_piles():
    row = np.dtype([("x", np.float32, (2,)), ("y", np.int64), ("w", np.float64)])
    rows = np.zeros(1003, row)
    rows["y"] = np.arange(1003)
    places = []
    for seed in range(200):
        kept = io.BytesIO(rows.tobytes())
        parts = list(L._minibatches(L._piles(kept, row, 1003, 100, np.random.default_rng(seed)), 16))
        assert [len(p) for p in parts] == [16] * 62 + [11]
        order = np.concatenate([p["y"] for p in parts])
        assert sorted(order) == list(range(1003))
        places.append(np.argsort(order))
    mean = np.mean(places, axis=0)  # every row may come anywhere: 501 on average, 20 its standard error
    assert abs(mean - 501).max() < 120 and np.std(places) == pytest.approx(1003 / np.sqrt(12), rel=0.02)


def test_sgd_probe_learns_from_piles(spark, monkeypatch):
    monkeypatch.setattr(L, "PILE_BYTES", 20 * 40)  # 20 of 90 rows
    df = classes(spark).withColumn("fold", F.lit(0))
    p = L.fit_sgd_probe(df, ["fold"], 3, 3, [0, 1], "vec_id", lr=0.1, epochs=6, batch=16)
    again = L.fit_sgd_probe(df.repartition(7), ["fold"], 3, 3, [0, 1], "vec_id", lr=0.1, epochs=6, batch=16)
    assert sorted(p.collect()) == sorted(again.collect())
    m = L.evaluate_probe(L.score_probes(df, p, ["fold"]), ["seed"], 3).collect()
    assert len(m) == 2 and all(r.balanced_accuracy > 0.85 for r in m)


def test_within_evaluation_fits_on_every_training_row(spark, monkeypatch):
    n, tests = 105_000, 40  # the first 40 ids test
    label = F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") % 3).cast("int")
    df = spark.range(n).select(F.col("id").alias("vec_id"), label.alias("label"), F.lit(0).alias("fold"), F.when(F.col("id") < tests, "test").otherwise("train").alias("role"), F.array(
        *[F.sin(F.col("id") * a) + (label == c).cast("double") for c, a in enumerate((0.7, 1.3))]).alias("f"))
    seen, score = [], L.score_probes
    monkeypatch.setattr(L, "score_probes", lambda test, probes, *rest: (seen.append(probes), score(test, probes, *rest))[1])
    V.within_eval(df, 5, 3, 2, [4], epochs=1)
    got = seen[0].first()
    i = np.arange(tests, n)
    y = np.where(i % 4 == 0, 0, i % 3)
    x = np.column_stack([np.sin(i * a) + (y == c) for c, a in enumerate((0.7, 1.3))])
    want = plain_sgd(x, y, (len(y) / (3 * np.bincount(y)))[y], 3, 4, 0.01, 1, 256)
    assert np.column_stack([got.coef, got.intercept]) == pytest.approx(want, abs=1e-9)


def test_baselines(spark):
    train = table(spark, np.zeros((5, 1)), [2, 1, 1, 2, 0]).withColumn("k", F.lit(1))
    test = table(spark, np.zeros((400, 1)), [0] * 400, 100).withColumn("k", F.lit(1))
    assert {r.pred for r in L.majority_baseline(train, test, ["k"]).collect()} == {1}
    share = [r["count"] for r in L.prior_baseline(train, test, ["k"], 1, "vec_id").groupBy("pred").count().orderBy("pred").collect()]
    assert len(share) == 3 and abs(share[0] / 400 - 0.2) < 0.08


def test_inference_loads_user_model(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "tile_id bigint, px array<float>")
    out = E.embed_tiles(df, lambda: (lambda x: x.sum(axis=1, keepdims=True)), 2, 2).collect()
    assert [r.f for r in sorted(out, key=lambda r: r.tile_id)] == [[4.0 * i] for i in range(10)]


def test_gap_refuses_bad_features_and_small_domains(spark):
    rows = [(i, [float(i), 1.0 if i else float("nan")], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, f array<double>, domain int")
    with pytest.raises(Exception, match="NaN"):
        G.mmd_rbf(df, "domain", 0, 1, "vec_id").collect()
    with pytest.raises(Exception, match="2 or more rows"):
        G.mmd_rbf(df.where("vec_id in (1, 2)"), "domain", 0, 1, "vec_id", estimator="unbiased").collect()


def test_bandwidth_of_tiny_and_close_vectors(spark):
    x = np.random.default_rng(3).normal(size=(40, 4)) * 1e-7 + 5.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, f array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)[np.triu_indices(40, 1)]
    assert G.median_gamma(df, 0, "vec_id").first().gamma == pytest.approx(1 / np.median(d), rel=1e-6)


def test_groups_may_be_text(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], i % 2, f"g{i % 4 // 2}") for i in range(40)],
                               "vec_id bigint, f array<double>, domain int, g string")
    assert G.mmd_groups(df, "domain", 0, 1, "g", "vec_id", "source_jackknife").count() == 2


def test_mahalanobis_with_supplied_moments(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "c int, x double, y double, z double")
    cov = [[2.0, 0.5, 0.0], [0.5, 1.0, 0.2], [0.0, 0.2, 3.0]]
    table = spark.createDataFrame([(0, [1.0, 1.0, 1.0], cov), (1, [0.0, 0.0, 0.0], [[0.0] * 3] * 3)],
                                  "c int, mean array<double>, cov array<array<double>>")
    got = {r.c: r.score for r in E.mahalanobis(df, ["x", "y", "z"], "c", moments=E.supplied_moments(table, "c")).collect()}
    d = np.array([0.0, 1.0, 2.0])
    assert got[0] == pytest.approx(np.sqrt(d @ np.linalg.inv(np.array(cov)) @ d))
    assert got[1] == pytest.approx(4.0) and got[2] is None


def test_feature_table_is_refused_in_the_job(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, f array<double>")
    ids = df.select("vec_id")
    assert E.require_features(df, 2, ids).count() == 2 and E.feature_faults(df, 2, ids).count() == 0
    for bad, reason in ((df.unionByName(df.limit(1)), "repeated"), (df.where("vec_id = 1"), "missing"), (df.withColumn("f", F.array(F.lit(1.0))), "size")):
        with pytest.raises(Exception, match=f"refused: {reason}"):
            E.require_features(bad, 2, ids).collect()


def test_covariance_in_pieces_and_far_from_zero(spark, monkeypatch):
    monkeypatch.setattr(E, "GRAM_COLUMNS", 3)
    rng = np.random.default_rng(12)
    x, k = rng.normal(size=(90, 7)) + 1e5, rng.integers(0, 3, 90)
    df = table(spark, x, k).repartition(4)
    for held in (64 << 20, 1):
        monkeypatch.setattr(E, "GRAM_BYTES", held)
        got = {(r.label, r.i): r.cov for r in E.covariance_rows(df, ["label"]).collect()}
        assert len(got) == 21
        for (label, i), row in got.items():
            assert np.allclose(row, np.cov(x[k == label].T)[i], atol=1e-9)
    whole = sorted((r.i, r.cov) for r in E.covariance_rows(df, []).collect())
    assert np.allclose([c for _, c in whole], np.cov(x.T), atol=1e-9)
    assert E.covariance_rows(df.where("false"), ["label"]).count() == 0
    assert all(v is None for v in E.covariance_rows(df.where("vec_id = 1"), ["label"]).first().cov)
