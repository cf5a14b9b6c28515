"""Bucketed ordered computations against NumPy and plain windows; any number of buckets must agree."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.operators import ordering as O
from tilescope.operators import quality as Q
from tilescope.operators import ranking as X


@pytest.fixture(params=[None, 13])
def path(request, spark):
    """Partitions as adaptive execution joins them, and many small ones."""
    names = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in names}
    if request.param:
        for n, v in names.items():
            spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def skewed(spark, n=3000):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(rng.integers(0, 400)) / 7 if i % 4 else 3.0, int(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double, i bigint")


def test_running_totals(spark, path):
    rows, df = skewed(spark)
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for desc in (False, True):
        got = {(r.k, r.v): r.cum_n for r in O.running_totals(counts, ["k"], "v", ["n"], desc).collect()}
        for (k, v), total in got.items():
            want = sum(1 for a, b, _ in rows if a == k and (b >= v if desc else b <= v))
            assert total == want


def test_running_totals_without_keys(spark, path):
    rows, df = skewed(spark)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.cum_n for r in O.running_totals(counts, [], "v", ["n"]).collect()}
    assert all(total == sum(1 for _, b, _ in rows if b <= v) for v, total in got.items())


def test_exact_quantiles_match_numpy(spark, path):
    rows, df = skewed(spark)
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = {(r.k, r.q): r.value for r in O.exact_quantiles(df, ["k"], "v", qs).collect()}
    for k in {r[0] for r in rows}:
        v = [b for a, b, _ in rows if a == k]
        for q in qs:
            assert got[(k, q)] == pytest.approx(np.quantile(v, q), abs=1e-12)
    whole = {r.q: r.value for r in O.exact_quantiles(df, [], "v", qs).collect()}
    assert [whole[q] for q in qs] == pytest.approx(list(np.quantile([r[1] for r in rows], qs)))


def test_quantiles_of_one_row_and_nothing(spark, path):
    one = spark.createDataFrame([("a", 2.5)], "k string, v double")
    assert [r.value for r in O.exact_quantiles(one, ["k"], "v", [0.1, 0.9]).collect()] == [2.5, 2.5]
    assert O.exact_quantiles(one.where("false"), ["k"], "v", [0.5]).count() == 0
    assert O.exact_quantiles(one.where("false"), [], "v", [0.5]).count() == 0


def test_with_previous(spark, path):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    rows = O.with_previous(df, ["k"], "v", ["v"], descending=True).collect()
    for r in rows:
        assert (r.prev is None and r.v in (498.0, 499.0)) or r.prev.v == r.v + 2


def test_hash_rank_is_md5_order(spark):
    df = spark.range(700).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    got = {r.id: r.rank for r in O.hash_rank(df, ["k"], 9, ["id"]).collect()}
    for k in (0, 1):
        ids = sorted((i for i in range(700) if (i % 3 == 0) == bool(k)), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_hash_sample_sizes_and_repeatability(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    a = {r.id for r in O.hash_sample(df, 40, 1, ["id"], ["k"]).collect()}
    b = {r.id for r in O.hash_sample(df.repartition(7), 40, 1, ["id"], ["k"]).collect()}
    assert a == b and len(a) == 80
    assert {r.id for r in O.hash_sample(df, 40, 2, ["id"], ["k"]).collect()} != a


def test_hash_first_takes_quotas_from_groups_of_any_size(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id")
    quota = spark.createDataFrame([(0, 300), (1, 7), (2, 5)], "k int, _quota long")
    order = {k: sorted((i for i in range(900) if (i % 10 == 0) == bool(k)), key=lambda i: hashlib.md5(f"4:{i}".encode()).hexdigest()) for k in (0, 1)}
    for ranked in (10_000, 50, 0):  # few rows at the cut, or one digit after another
        monkeypatch.setattr(O, "RANKED", ranked)
        monkeypatch.setattr(O, "DIGITS", 1 if ranked == 50 else 3)
        got = {(r.k, r.id) for r in O.hash_first(df, ["k"], quota, 4, ["id"]).collect()}
        assert got == {(0, i) for i in order[0][:300]} | {(1, i) for i in order[1][:7]}
    one = spark.range(1).select(F.lit(20).alias("_quota"))
    assert len({r.id for r in O.hash_first(df, [], one, 4, ["id"]).collect()}) == 20
    assert O.hash_first(df.where("false"), ["k"], quota, 4, ["id"]).count() == 0 == O.hash_first(df.where("false"), [], one, 4, ["id"]).count()
    twins = df.where("id = 3").unionByName(df.where("id = 3")).unionByName(df.where("id = 3"))
    assert O.hash_first(twins, ["k"], spark.createDataFrame([(0, 2)], "k int, _quota long"), 4, ["id"]).count() == 2


def test_one_key_holds_all_rows_and_the_plan_stays(spark, path):
    sizes = []
    for n in (2_000, 20_000):
        df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"), F.lit(1).alias("one"))
        out = O.running_totals(df, ["k"], "v", ["one"])
        assert out.where("cum_one <> v + 1 or all_one <> %d" % n).count() == 0
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
    assert abs(sizes[0] - sizes[1]) < 50


def test_quantile_picks_never_repeat(spark, path):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "k string, item bigint, v double")
    picks = X.quantile_picks(df, ["k"], "v", "item", [0.5, 0.5001, 0.5002]).orderBy("q").collect()
    assert [r["item"] for r in picks] == [1, 2, 3]


def test_ranking_curve_whole_ties_and_ap(spark, path):
    score, y = [3.0, 3.0, 2.0, 1.0, 1.0, 1.0], [1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(score, y)), "s double, y int")
    curve = X.ranking_curve(df, [], "s", F.col("y") == 1)
    pts = {r.threshold: (r.tp, r.fp) for r in curve.collect()}
    assert pts == {3.0: (1, 1), 2.0: (2, 1), 1.0: (3, 3)}
    ap = X.average_precision(curve, []).first()
    assert ap.ap == pytest.approx((1 / 2 + 2 / 3 + 3 / 6) / 3)
    assert (ap.tied_groups, ap.largest_tie, ap.distinct_scores) == (2, 3, 3)
    assert X.average_precision(X.ranking_curve(df, [], "s", F.lit(False)), []).first().ap is None


def test_curve_faults_are_found(spark, path):
    df = spark.createDataFrame([(float(i % 5), i % 3 == 0) for i in range(60)], "s double, y boolean").withColumn("k", F.lit(1))
    good = X.ranking_curve(df, ["k"], "s", F.col("y"))
    assert Q.check_curve(good, ["k"]).count() == 0
    bad = good.withColumn("tp", F.when(F.col("threshold") == 2, 0).otherwise(F.col("tp")))
    assert "monotone" in {r.reason for r in Q.check_curve(bad, ["k"]).collect()}
    assert {r.reason for r in Q.check_curve(good.where("threshold > 0"), ["k"]).collect()} == {"end"}


@pytest.mark.parametrize("chunk", [2, 4, 10_000])
def test_digest_takes_all_rounds_at_any_size(spark, chunk):
    df = spark.range(10).select(F.lit("g").alias("k"), F.col("id").alias("i"))
    listed = lambda parts, quote: [hashlib.sha256(("[" + ",".join(f"{quote}{p}{quote}" for p in parts[i:i + chunk]) + "]").encode()).hexdigest()
                                   for i in range(0, len(parts), chunk)]
    second = listed(listed(list(range(10)), ""), '"')
    want = hashlib.sha256(("[" + ",".join(f'"{p}"' for p in second) + "]").encode()).hexdigest()
    row = Q.digest_ids(df, ["k"], "i", chunk=chunk).first()
    assert (row.n, row.digest) == (10, want)


def test_stratified_subset_quotas(spark):
    df = spark.createDataFrame([(i, 0 if i < 70 else 1 if i < 95 else 2) for i in range(100)], "i bigint, label int")
    got = X.subsample_train(df, 33, 1, ["i"], "label").groupBy("label").count().orderBy("label").collect()
    assert [r["count"] for r in got] == [23, 8, 2]


def test_earliest_best_epoch(spark):
    h = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 9.0, 0), (1, 3, 7.0, 1), (1, 4, 7.0, 1)], "cell int, epoch int, score double, steps int")
    assert X.select_epoch(h, ["cell"]).first().epoch == 3
