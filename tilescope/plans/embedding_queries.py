"""Neighbour, classifier and domain-gap queries over the embedding table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6
from tilescope.operators import domain_gap as G
from tilescope.operators import embedding as E
from tilescope.operators import fit as L
from tilescope.operators import metrics as M
from tilescope.operators import tiles as T
from tilescope.plans import evaluate as V
from tilescope.plans.fixtures import ELEM, FOLDS, K, features, folds, tiles
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed
from tilescope.plans.tile_queries import COEF, LOGITS

NC = 10  # classes in the embedding table

UNIT = f"""WITH {FOLDS}, nrm AS (SELECT vec_id, label, sqrt(sum(x * x)) + 1e-8 AS n FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
u AS (SELECT e.vec_id, e.label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS u FROM embeddings e JOIN nrm ON e.vec_id = nrm.vec_id),
sim AS (SELECT q.fold, q.vec_id, r.vec_id AS ref_id, ru.label AS ref_label, round(list_dot_product(qu.u, ru.u), 12) AS sim
 FROM folds q JOIN folds r ON q.fold = r.fold AND q.role = 'test' AND r.role = 'train' JOIN u qu ON qu.vec_id = q.vec_id JOIN u ru ON ru.vec_id = r.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY fold, vec_id ORDER BY sim DESC, ref_id) AS rank FROM sim),
vote AS (SELECT fold, vec_id, ref_label, count(*) AS v FROM nn WHERE rank <= 20 GROUP BY ALL),
vr AS (SELECT *, row_number() OVER (PARTITION BY fold, vec_id ORDER BY v DESC, ref_label) AS rn FROM vote),
kp AS (SELECT vr.fold, vr.vec_id, e.label, vr.ref_label AS pred FROM vr JOIN embeddings e ON e.vec_id = vr.vec_id WHERE rn = 1)"""


def split(spark, sf):
    f = folds(spark, sf)
    return f.where("role = 'train'"), f.where("role = 'test'")


@query("j09_knn_neighbours", UNIT + f" SELECT fold, vec_id, ref_id, {B('rank')}, {R('sim')} FROM nn WHERE rank <= 20")
def _(spark, sf):
    train, test = split(spark, sf)
    return keyed(E.knn_join(test, train, 20, keys=["fold"]), ["fold", "vec_id", "ref_id"], ["rank"], ["sim"])


@query("e02_knn_predictions", UNIT + " SELECT fold, vec_id, label::BIGINT AS label, pred::BIGINT AS pred FROM kp")
def _(spark, sf):
    train, test = split(spark, sf)
    return keyed(E.knn_classify(train, test, 20, keys=["fold"]), ["fold", "vec_id", "label", "pred"])


KNN_METRICS = UNIT + """, oc AS (SELECT fold, k.i AS cls, sum((label = k.i AND pred = k.i)::INT) AS tp, sum((label = k.i)::INT) AS support, sum((pred = k.i)::INT) AS predicted
 FROM kp CROSS JOIN range(10) k(i) GROUP BY ALL),
fm AS (SELECT fold, avg(tp / nullif(support, 0)) FILTER (WHERE support > 0) AS ba, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) FILTER (WHERE support > 0) AS f1,
 sum(support) AS n, (sum(tp) / sum(support) - sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support))) / (1 - sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support))) AS kappa
 FROM oc GROUP BY fold)"""


@query("e02_knn_fold_metrics", KNN_METRICS + f" SELECT fold, {B('n')}, {R('ba', 'balanced_accuracy')}, {R('f1', 'macro_f1')}, {R('kappa')} FROM fm")
def _(spark, sf):
    return keyed(V.knn_fold_metrics(folds(spark, sf), 20, NC), ["fold"], ["n"], ["balanced_accuracy", "macro_f1", "kappa"])


@query("e02_knn_fold_summary", KNN_METRICS + f""" SELECT {R('avg(f1)', 'mean')}, {R('stddev_samp(f1)', 'sd')}, count(*) AS folds, {R('min(f1)', 'lowest')}, {R('max(f1)', 'highest')} FROM fm""")
def _(spark, sf):
    m = V.knn_fold_metrics(folds(spark, sf), 20, NC)
    return keyed(M.summarize_folds(m, [], "macro_f1"), [], ["folds"], ["mean", "sd", "lowest", "highest"])


@query("s04_feature_checks", """SELECT count(*) AS rows, 0::BIGINT AS repeated, sum((len(embedding) <> 64)::INT)::BIGINT AS wrong_size, 0::BIGINT AS not_finite FROM embeddings""")
def _(spark, sf):
    return keyed(E.feature_checks(features(spark, sf), 64), [], ["rows", "repeated", "wrong_size", "not_finite"])


# weights by formula, so that both engines have the same ones
@query("e01_tile_embedding", """WITH z AS (SELECT vec_id, k AS dim, tanh(sum(CAST(embedding[i + 1] AS DOUBLE) * (((i * 31 + k * 17) % 13) - 6) / 80.0)) AS v
 FROM embeddings CROSS JOIN range(64) a(i) CROSS JOIN range(16) b(k) GROUP BY vec_id, k)
SELECT dim, count(*) AS n, round(avg(v), 4) + 0.0 AS mean FROM z GROUP BY dim""")
def _(spark, sf):
    def make():
        i, k = np.arange(64)[:, None], np.arange(16)[None]
        weights = ((i * 31 + k * 17) % 13 - 6) / 80.0
        return lambda x: np.tanh(np.asarray(x, dtype=np.float64) @ weights / 255.0).astype(np.float32)
    t = E.embed_tiles(tiles(spark, sf).withColumn("px", F.transform("px", lambda v: v.cast("float"))), make, 8, 8)
    rows = t.select("tile_id", F.posexplode("f").alias("dim", "v")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v").cast("double")).alias("mean"))
    return rows.select(bi("dim").alias("dim"), "n", (F.round("mean", 4) + 0.0).alias("mean"))


@query("f02_tile_transform", f"SELECT vec_id AS tile_id, {R('list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE) * 255)))', 'energy')} FROM embeddings")
def _(spark, sf):
    def energy(pdf):
        return pdf.assign(energy=[float(np.abs(p).sum()) for p in pdf["px"]])[["tile_id", "energy"]]
    return keyed(T.map_tiles(tiles(spark, sf), energy, "tile_id bigint, energy double"), ["tile_id"], (), ["energy"])


MEANS = f"""WITH {ELEM}, cm AS (SELECT vec_id % 2 AS d, label, i, avg(v) AS m FROM elem GROUP BY ALL),
dist AS (SELECT a.label, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS distance FROM cm a JOIN cm b ON a.label = b.label AND a.i = b.i AND a.d = 0 AND b.d = 1 GROUP BY a.label)"""


@query("e03_centroid_distances", MEANS + f" SELECT k.i AS label, {R('distance')} FROM range(11) k(i) LEFT JOIN dist ON dist.label = k.i")
def _(spark, sf):
    return keyed(E.centroid_distances(features(spark, sf), "domain", 0, 1, 11), ["label"], (), ["distance"])


MOM = f"""WITH {ELEM}, dm AS (SELECT i, avg(v) FILTER (WHERE vec_id % 2 = 0) AS a, avg(v) FILTER (WHERE vec_id % 2 = 1) AS b, var_samp(v) FILTER (WHERE vec_id % 2 = 0) AS va, var_samp(v) FILTER (WHERE vec_id % 2 = 1) AS vb,
 count(*) FILTER (WHERE vec_id % 2 = 0) AS na, count(*) FILTER (WHERE vec_id % 2 = 1) AS nb FROM elem GROUP BY i)"""


@query("e04_mmd_linear", MOM + " SELECT 'biased' AS form, round(sum((a - b) * (a - b)), 6) + 0.0 AS mmd2 FROM dm UNION ALL SELECT 'unbiased', round(sum((a - b) * (a - b) - va / na - vb / nb), 6) + 0.0 FROM dm")
def _(spark, sf):
    f = features(spark, sf)
    one = lambda u: G.mmd_linear(f, "domain", 0, 1, u).select(F.lit("unbiased" if u else "biased").alias("form"), round6("mmd2").alias("mmd2"))
    return one(False).unionByName(one(True))


KERNEL = """WITH n AS (SELECT count(*) FILTER (WHERE vec_id % 2 = 0) AS ns, count(*) FILTER (WHERE vec_id % 2 = 1) AS nt FROM embeddings),
s AS (SELECT row_number() OVER (ORDER BY md5(concat_ws(':', '0', vec_id)), vec_id) AS id, vec_id % 2 AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
p AS (SELECT a.id AS i, b.id AS j, a.d AS da, b.d AS db, pow(list_distance(a.f, b.f), 2) AS d2 FROM s a CROSS JOIN s b),
g AS (SELECT 1 / median(d2) AS gamma FROM p WHERE i < j AND d2 > 0 AND i <= 2000 AND j <= 2000),
ks AS (SELECT sum(exp(-gamma * d2)) FILTER (WHERE da = 0 AND db = 0) AS ss, sum(exp(-gamma * d2)) FILTER (WHERE da = 1 AND db = 1) AS tt, sum(exp(-gamma * d2)) FILTER (WHERE da = 0 AND db = 1) AS st,
 max(gamma) AS gamma FROM p CROSS JOIN g)"""


@query("e05_mmd_rbf", KERNEL + f""" SELECT 'biased' AS form, {R('greatest(ss / (ns * ns) + tt / (nt * nt) - 2 * st / (ns * nt), 0)', 'mmd2')}, ns::BIGINT AS n FROM ks CROSS JOIN n
UNION ALL SELECT 'unbiased', round((ss - ns) / (ns * (ns - 1)) + (tt - nt) / (nt * (nt - 1)) - 2 * st / (ns * nt), 6) + 0.0, ns FROM ks CROSS JOIN n""")
def _(spark, sf):
    return G.mmd_rbf_forms(features(spark, sf), "domain", 0, 1, "vec_id").select("form", round6("mmd2").alias("mmd2"), bi("n_source").alias("n"))


@query("e06_median_bandwidth", f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
p AS (SELECT pow(list_distance(a.f, b.f), 2) AS d2 FROM s a JOIN s b ON a.vec_id < b.vec_id)
SELECT {R('1 / median(d2)', 'gamma')} FROM p WHERE d2 > 0""")
def _(spark, sf):
    return keyed(G.median_gamma(features(spark, sf), 0, "vec_id", max_rows=None), [], (), ["gamma"])


@query("e07_mmd_repeated", f"""WITH n AS (SELECT least(2000, min(c)) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY vec_id % 2)),
r AS (SELECT rep, vec_id, vec_id % 2 AS d, embedding AS f, row_number() OVER (PARTITION BY rep, vec_id % 2 ORDER BY md5(concat_ws(':', rep, vec_id)), vec_id) AS rn FROM embeddings CROSS JOIN range(100) t(rep)),
s AS (SELECT rep, vec_id, d, list_transform(f, lambda x: CAST(x AS DOUBLE)) AS f FROM r, n WHERE rn <= n),
p AS (SELECT a.rep, a.vec_id < b.vec_id AS half, a.d AS da, b.d AS db, pow(list_distance(a.f, b.f), 2) AS d2 FROM s a JOIN s b ON a.rep = b.rep),
g AS (SELECT rep, 1 / median(d2) AS gamma FROM p WHERE half AND d2 > 0 GROUP BY rep),
m AS (SELECT p.rep, greatest(avg(exp(-gamma * d2)) FILTER (WHERE da = 0 AND db = 0) + avg(exp(-gamma * d2)) FILTER (WHERE da = 1 AND db = 1)
 - 2 * avg(exp(-gamma * d2)) FILTER (WHERE da = 0 AND db = 1), 0) AS v FROM p JOIN g ON g.rep = p.rep GROUP BY p.rep)
SELECT count(*) AS repeats, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'sd')}, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')} FROM m""")
def _(spark, sf):
    r = G.mmd_repeated(features(spark, sf), "domain", 0, 1, "vec_id", max_samples=2000)
    return keyed(G.resampling_summary(r), [], ["repeats"], ["mean", "sd", "low", "high"])


@query("e08_mmd_permutation", """WITH size AS (SELECT least(500, min(c)) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY vec_id % 2)),
r AS (SELECT vec_id, vec_id % 2 AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f,
 row_number() OVER (PARTITION BY vec_id % 2 ORDER BY md5(concat_ws(':', '0', vec_id)), vec_id) AS rn FROM embeddings),
s AS (SELECT r.* FROM r, size WHERE rn <= n),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.d = b.d AS same, pow(list_distance(a.f, b.f), 2) AS d2 FROM s a CROSS JOIN s b),
g AS (SELECT 1 / median(d2) AS gamma FROM p WHERE i < j AND d2 > 0),
k AS (SELECT i, j, same, exp(-gamma * d2) AS k FROM p CROSS JOIN g),
o AS (SELECT sum(CASE WHEN same THEN k ELSE -k END) / max(n * n) AS observed FROM k CROSS JOIN size),
w AS (SELECT q.perm, s.vec_id AS id, CASE WHEN row_number() OVER (PARTITION BY q.perm ORDER BY md5(concat_ws(':', '0', q.perm, s.vec_id))) <= n THEN 1 ELSE -1 END AS w
 FROM s CROSS JOIN range(500) q(perm) CROSS JOIN size),
h AS (SELECT w.perm, k.i, sum(w.w * k.k) AS h FROM w JOIN k ON k.j = w.id GROUP BY ALL),
z AS (SELECT h.perm, sum(w.w * h.h) / max(n * n) AS v FROM h JOIN w ON w.perm = h.perm AND w.id = h.i CROSS JOIN size GROUP BY h.perm)
SELECT count(*) AS permutations, CAST(max(n) AS BIGINT) AS n, round(max(observed), 6) + 0.0 AS observed,
 round((sum((v >= observed)::INT) + 1) / 501.0::DOUBLE, 6) + 0.0 AS p_value, round(max(gamma), 6) + 0.0 AS gamma FROM z CROSS JOIN o CROSS JOIN g CROSS JOIN size""")
def _(spark, sf):
    p = G.mmd_permutation(features(spark, sf), "domain", 0, 1, "vec_id", permutations=500)
    return keyed(p, [], ["permutations", "n"], ["observed", "p_value", "gamma"])


GROUPED = """WITH s AS (SELECT vec_id, vec_id % 2 AS d, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
few AS (SELECT f, row_number() OVER (ORDER BY md5(concat_ws(':', '0', vec_id)), vec_id) AS id FROM s ORDER BY id LIMIT 2000),
g AS (SELECT 1 / median(d2) AS gamma FROM (SELECT pow(list_distance(a.f, b.f), 2) AS d2 FROM few a JOIN few b ON a.id < b.id) WHERE d2 > 0),
k AS (SELECT a.d AS da, a.label AS la, b.d AS db, b.label AS lb, sum(exp(-gamma * pow(list_distance(a.f, b.f), 2))) AS t FROM s a CROSS JOIN s b CROSS JOIN g GROUP BY ALL),
c AS (SELECT d, label, count(*) AS n FROM s GROUP BY ALL)"""


@query("e09_mmd_source_jackknife", GROUPED + f""",
gr AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS repeat FROM c WHERE d = 0),
v AS (SELECT gr.repeat, (SELECT sum(n) FROM c WHERE d = 0 AND c.label <> gr.label) AS ns, (SELECT sum(n) FROM c WHERE d = 1) AS nt,
 (SELECT sum(t) FROM k WHERE da = 0 AND db = 0 AND la <> gr.label AND lb <> gr.label) AS ss, (SELECT sum(t) FROM k WHERE da = 1 AND db = 1) AS tt,
 (SELECT sum(t) FROM k WHERE da = 0 AND db = 1 AND la <> gr.label) AS st FROM gr)
SELECT repeat, {R('greatest(ss / (ns * ns) + tt / (nt * nt) - 2 * st / (ns * nt), 0)', 'mmd2')} FROM v""")
def _(spark, sf):
    return keyed(G.mmd_groups(features(spark, sf), "domain", 0, 1, "label", "vec_id", "source_jackknife"), ["repeat"], (), ["mmd2"])


@query("e09_mmd_target_bootstrap", GROUPED + f""",
tg AS (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS pos FROM c WHERE d = 1),
draw AS (SELECT rep, ('0x' || substr(md5(concat_ws(':', '0', rep, tg.pos)), 1, 8))::BIGINT % (SELECT count(*) FROM tg) AS pos FROM range(1000) a(rep) CROSS JOIN tg),
times AS (SELECT rep, label, n, count(*) AS x FROM draw JOIN tg USING (pos) GROUP BY ALL),
nt AS (SELECT rep, sum(x * n) AS nt FROM times GROUP BY rep),
tt AS (SELECT a.rep, sum(a.x * b.x * t) AS tt FROM times a JOIN times b ON a.rep = b.rep JOIN k ON da = 1 AND db = 1 AND la = a.label AND lb = b.label GROUP BY a.rep),
st AS (SELECT b.rep, sum(b.x * t) AS st FROM times b JOIN k ON da = 0 AND db = 1 AND lb = b.label GROUP BY b.rep),
one AS (SELECT (SELECT sum(t) FROM k WHERE da = 0 AND db = 0) AS ss, (SELECT sum(n) FROM c WHERE d = 0) AS ns),
v AS (SELECT greatest(ss / (ns * ns) + tt / (nt * nt) - 2 * st / (ns * nt), 0) AS v FROM nt JOIN tt USING (rep) JOIN st USING (rep) CROSS JOIN one)
SELECT count(*) AS repeats, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'sd')}, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')} FROM v""")
def _(spark, sf):
    g = G.mmd_groups(features(spark, sf), "domain", 0, 1, "label", "vec_id", "target_bootstrap")
    return keyed(G.resampling_summary(g), [], ["repeats"], ["mean", "sd", "low", "high"])


@query("e10_proxy_a_distance")
def _(spark, sf):
    return keyed(G.proxy_a_distance(features(spark, sf), "domain", 0, 1, "vec_id"), [], ["n_test"], ["error", "a_distance"])


@query("e11_cosine_silhouette", f"""WITH nrm AS (SELECT vec_id, label, sqrt(sum(x * x)) AS n FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
u AS (SELECT e.vec_id, e.label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS u FROM embeddings e JOIN nrm ON e.vec_id = nrm.vec_id),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) AS s, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, max(s / n) FILTER (WHERE other = label) AS a, min(s / n) FILTER (WHERE other <> label) AS b FROM d GROUP BY vec_id)
SELECT {R('avg((b - a) / greatest(a, b))', 'silhouette')}, count(*) AS n FROM ab""")
def _(spark, sf):
    return keyed(E.silhouette(features(spark, sf)), [], ["n"], ["silhouette"])


@query("e12_coral_covariance", f"""WITH {ELEM}, m AS (SELECT vec_id % 2 AS d, i, avg(v) AS m FROM elem GROUP BY ALL),
c AS (SELECT e.vec_id, e.vec_id % 2 AS d, e.i, v - m AS z FROM elem e JOIN m ON m.d = e.vec_id % 2 AND m.i = e.i)
SELECT a.d AS domain, a.i AS i, b.i AS j, {R('sum(a.z * b.z) / (count(*) - 1)', 'cov')} FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.d, a.i, b.i""")
def _(spark, sf):
    c = E.covariance_rows(features(spark, sf), ["domain"])
    return keyed(c.select("domain", "i", F.posexplode("cov").alias("j", "cov")), ["domain", "i", "j"], (), ["cov"])


# with a vanishing ridge the transformed source has the target's covariance
@query("e13_coral_transform", f"""WITH {ELEM}, m AS (SELECT i, avg(v) AS m FROM elem WHERE vec_id % 2 = 1 GROUP BY i),
c AS (SELECT e.vec_id, e.i, v - m AS z FROM elem e JOIN m ON m.i = e.i WHERE e.vec_id % 2 = 1)
SELECT a.i AS i, b.i AS j, round(sum(a.z * b.z) / (count(*) - 1) * 1e3, 3) + 0.0 AS cov_e3 FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""")
def _(spark, sf):
    f = features(spark, sf)
    model = E.coral_fit(f, "domain", 0, 1, reg=1e-12)
    t = f.where("domain = 0").withColumn("f", E.coral_transform("f", model))
    c = E.covariance_rows(t, ["domain"]).select("i", F.posexplode("cov").alias("j", "cov"))
    return c.select(bi("i").alias("i"), bi("j").alias("j"), (F.round(F.col("cov") * 1e3, 3) + 0.0).alias("cov_e3"))


@query("e14_coral_distance", f"""WITH {ELEM}, m AS (SELECT vec_id % 2 AS d, i, avg(v) AS m FROM elem GROUP BY ALL),
c AS (SELECT e.vec_id, e.vec_id % 2 AS d, e.i, v - m AS z FROM elem e JOIN m ON m.d = e.vec_id % 2 AND m.i = e.i),
cov AS (SELECT a.d, a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS c FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY ALL)
SELECT {R('sum(pow(x.c - y.c, 2)) / (4 * 64 * 64) * 1e6', 'coral_distance_e6')} FROM cov x JOIN cov y ON x.d = 0 AND y.d = 1 AND x.i = y.i AND x.j = y.j""")
def _(spark, sf):
    d = E.coral_distance(features(spark, sf), "domain", 0, 1)
    return d.select(round6(F.col("coral_distance") * 1e6).alias("coral_distance_e6"))


@query("e15_standardized_features", f"""WITH {ELEM}, st AS (SELECT f AS fold, i, avg(v) AS m, stddev_pop(v) AS sd FROM elem CROSS JOIN range(5) t(f) WHERE vec_id % 5 <> f AND vec_id % 5 <> (f + 1) % 5 GROUP BY ALL)
SELECT fold, vec_id, {R('sum((v - m) / sd * (e.i + 1))', 'ramp')}, {R('max((v - m) / sd)', 'top')} FROM elem e JOIN st ON st.i = e.i GROUP BY fold, vec_id""")
def _(spark, sf):
    f = folds(spark, sf)
    z = E.standardize(f, f.where("role = 'train'"), ["fold"])
    ramp = F.aggregate(F.transform("f", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return keyed(z.select("fold", "vec_id", ramp.alias("ramp"), F.array_max("f").alias("top")), ["fold", "vec_id"], (), ["ramp", "top"])


def six(spark, sf):
    return features(spark, sf).withColumn("label", F.pmod("label", F.lit(6)))


@query("e16_logistic_regression")
def _(spark, sf):
    f = six(spark, sf)
    model = L.fit_logistic(f.where("sector > 1"), K)
    m = L.evaluate_probe(L.score_linear(f.where("sector = 0"), model), [], K)
    g = L.loss_gradient(f.where("sector > 1"), model, K)
    out = m.withColumn("loss", g.select("loss").scalar()).withColumn("gradient_small", (g.select("gradient_max").scalar() < 1e-4))
    return out.select("n", F.round("balanced_accuracy", 3).alias("balanced_accuracy"), F.round("kappa", 3).alias("kappa"),
                      F.round("loss", 4).alias("loss"), "gradient_small")


@query("e17_fit_grid")
def _(spark, sf):
    f = folds(spark, sf).withColumn("label", F.pmod("label", F.lit(6)))
    g = L.fit_grid(f, K, list(range(5)), [False, True], [0.1, 1.0], max_iter=50)
    return g.select("fold", "scaled", "penalty", bi("n").alias("n"), F.round("balanced_accuracy", 3).alias("balanced_accuracy"))


@query("e18_sgd_probe")
def _(spark, sf):
    train, test = split(spark, sf)
    probes = L.fit_sgd_probe(train, ["fold"], NC, 64, [0, 1], "vec_id", epochs=20)
    m = L.evaluate_probe(L.score_probes(test, probes, ["fold"]), ["fold", "seed"], NC)
    return keyed(m, ["fold", "seed"], ["n"], ["balanced_accuracy", "kappa"])


@query("e19_probe_scores", LOGITS + f""", pr AS (SELECT vec_id, arg_max(cls, z) AS pred FROM z GROUP BY vec_id), t AS (SELECT p.vec_id, p.pred, e.label % 6 AS label FROM pr p JOIN embeddings e ON e.vec_id = p.vec_id),
oc AS (SELECT k.i AS cls, sum((label = k.i AND pred = k.i)::INT) AS tp, sum((label = k.i)::INT) AS support, sum((pred = k.i)::INT) AS predicted FROM t CROSS JOIN range(6) k(i) GROUP BY k.i)
SELECT {B('sum(support)', 'n')}, {R('avg(tp / support)', 'balanced_accuracy')},
 {R('(sum(tp) / sum(support) - sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support))) / (1 - sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)))', 'kappa')} FROM oc""")
def _(spark, sf):
    model = L.LinearModel(np.asarray(COEF), np.arange(6) / 10.0)
    return keyed(L.evaluate_probe(L.score_linear(six(spark, sf), model), [], K), [], ["n"], ["balanced_accuracy", "kappa"])


@query("e20_loss_gradient", LOGITS + f""", w AS (SELECT label, sum(count(*)) OVER () / (6.0 * count(*)) AS w FROM (SELECT label % 6 AS label FROM embeddings) GROUP BY label),
t AS (SELECT s.vec_id, s.cls, s.p, e.label % 6 AS label, w.w FROM sm s JOIN embeddings e ON e.vec_id = s.vec_id JOIN w ON w.label = e.label % 6),
sw AS (SELECT sum(w) AS s FROM t WHERE cls = 0),
gr AS (SELECT t.cls, el.i, sum(t.w * (t.p - (t.cls = t.label)::INT) * el.v) + ((t.cls * 31 + el.i * 17) % 13 - 6) / 10.0 AS g FROM t JOIN elem el ON el.vec_id = t.vec_id GROUP BY t.cls, el.i
 UNION ALL SELECT cls, -1, sum(w * (p - (cls = label)::INT)) FROM t GROUP BY cls),
pen AS (SELECT sum(pow(((k * 31 + i * 17) % 13 - 6) / 10.0, 2)) / 2 AS pen FROM range(6) a(k) CROSS JOIN range(64) b(i))
SELECT {R('(SELECT sum(-w * ln(p)) FROM t WHERE cls = label) / s', 'nll')}, {R('pen / s', 'penalty')}, {R('(SELECT max(abs(g)) FROM gr) / s', 'gradient_max')}, true AS concern FROM sw CROSS JOIN pen""")
def _(spark, sf):
    model = L.LinearModel(np.asarray(COEF), np.arange(6) / 10.0)
    g = L.loss_gradient(six(spark, sf), model, K)
    return g.select(round6("nll").alias("nll"), round6("penalty").alias("penalty"), round6("gradient_max").alias("gradient_max"), "concern")


@query("e21_majority_baseline", f"""WITH {FOLDS}, c AS (SELECT fold, label, count(*) AS n FROM folds WHERE role = 'train' GROUP BY ALL),
m AS (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) AS rn FROM c)
SELECT t.fold, count(*) AS n, {B('any_value(m.label)', 'pred')}, {R('avg((t.label = m.label)::INT)', 'accuracy')} FROM folds t JOIN m ON m.fold = t.fold AND rn = 1 WHERE role = 'test' GROUP BY t.fold""")
def _(spark, sf):
    train, test = split(spark, sf)
    b = L.majority_baseline(train, test, ["fold"])
    return keyed(b.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.first("pred").alias("pred"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy")),
                 ["fold"], ["n", "pred"], ["accuracy"])


@query("e22_prior_baseline", f"""WITH {FOLDS}, c AS (SELECT fold, label, sum(count(*)) OVER (PARTITION BY fold ORDER BY label) / sum(count(*)) OVER (PARTITION BY fold) AS cum FROM folds WHERE role = 'train' GROUP BY fold, label),
u AS (SELECT fold, vec_id, ('0x' || substr(md5(concat_ws(':', '4', vec_id)), 1, 8))::BIGINT / 4294967296.0 AS u FROM folds WHERE role = 'test')
SELECT u.fold, u.vec_id, min(c.label)::BIGINT AS pred FROM u JOIN c ON c.fold = u.fold AND u.u < c.cum GROUP BY u.fold, u.vec_id""")
def _(spark, sf):
    train, test = split(spark, sf)
    return keyed(L.prior_baseline(train, test, ["fold"], 4, "vec_id"), ["fold", "vec_id", "pred"])


# the oracle solves the 3 x 3 system through the correlation-free inverse written out per class
@query("e23_mahalanobis", f"""WITH x AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
s AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, x) + 1e-6 AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, covar_samp(y, y) + 1e-6 AS d, covar_samp(y, z) AS e, covar_samp(z, z) + 1e-6 AS g FROM x GROUP BY label),
ch AS (SELECT *, sqrt(a) AS l11, b / sqrt(a) AS l21, c / sqrt(a) AS l31, sqrt(d - b * b / a) AS l22 FROM s),
c2 AS (SELECT *, (e - l31 * l21) / l22 AS l32 FROM ch), c3 AS (SELECT *, sqrt(g - l31 * l31 - l32 * l32) AS l33 FROM c2),
w1 AS (SELECT vec_id, (x - mx) / l11 AS w1, y - my AS dy, z - mz AS dz, l21, l22, l31, l32, l33 FROM x JOIN c3 ON x.label = c3.label),
w2 AS (SELECT *, (dy - l21 * w1) / l22 AS w2 FROM w1)
SELECT vec_id, {R('sqrt(w1 * w1 + w2 * w2 + pow((dz - l31 * w1 - l32 * w2) / l33, 2))', 'score')} FROM w2""")
def _(spark, sf):
    f = features(spark, sf).select("vec_id", "label", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return keyed(E.mahalanobis(f, ["x", "y", "z"], "label"), ["vec_id"], (), ["score"])


@query("e24_transfer_evaluation")
def _(spark, sf):
    f = features(spark, sf).select("vec_id", "label", "f", "domain")
    src, tgt = f.where("domain = 0").drop("domain"), f.where("domain = 1").drop("domain")
    return V.transfer_eval(src, tgt, 20, NC, 64, [0, 1], epochs=20).select("method", "metric", F.round("value", 4).alias("value"))


@query("e25_within_evaluation")
def _(spark, sf):
    return V.within_eval(folds(spark, sf), 20, NC, 64, [0, 1], epochs=20).select(
        "fold", "method", "seed", "metric", F.round("value", 4).alias("value"))


@query("f01_pluggable_encoder", """WITH p AS (SELECT vec_id, (i - 1) // 16 AS br, (i - 1) % 8 // 2 AS bc, CAST(embedding[i] AS DOUBLE) * 255 AS v FROM embeddings CROSS JOIN range(1, 65) t(i)),
m AS (SELECT vec_id, br, bc, avg(v) AS m FROM p GROUP BY ALL) SELECT vec_id AS tile_id, round(max(m), 2) + 0.0 AS top FROM m GROUP BY vec_id""")
def _(spark, sf):
    """A second model through the same inference operator: block means of the tile."""
    def make():
        return lambda x: np.asarray(x).reshape(-1, 4, 2, 4, 2).mean(axis=(2, 4)).reshape(-1, 16).astype(np.float32)
    t = E.embed_tiles(tiles(spark, sf).withColumn("px", F.transform("px", lambda v: v.cast("float"))), make, 8, 8)
    return t.select("tile_id", (F.round(F.array_max("f").cast("double"), 2) + 0.0).alias("top"))
