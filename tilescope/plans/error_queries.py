"""Error-analysis, ensemble, membership and training-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6
from tilescope.operators import errors as E
from tilescope.operators import membership as J
from tilescope.operators import ranking as X
from tilescope.plans.fixtures import (COORD, FOLDS, HIST, MEMBERS, PRED, K, coordinates, features, folds, histories,
                                      members, predictions, table)
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed

SUPPORT = [f"support_{c}" for c in range(K)]


@query("a24_draw_errors", f"""WITH {PRED}, r AS (SELECT seed::VARCHAR AS draw, label, pred AS baseline,
 (label + seed * (score > 25)::INT) % 6 AS sub, frac < 0.5 AS m FROM pred),
d AS (SELECT draw, sum(m::INT) AS n, {', '.join(f'sum((m AND label = {c})::INT) AS support_{c}' for c in range(K))},
 sum((m AND baseline <> label)::INT) AS be, sum((m AND sub <> label)::INT) AS se FROM r GROUP BY draw),
b AS (SELECT * FROM d UNION ALL SELECT 'mean', avg(n), {', '.join(f'avg({s})' for s in SUPPORT)}, avg(be), avg(se) FROM d)
SELECT draw, {R('n::DOUBLE', 'n')}, {', '.join(R(s + '::DOUBLE', s) for s in SUPPORT)}, {R('be::DOUBLE', 'baseline_errors')},
 {R('se::DOUBLE', 'substitute_errors')}, {R('be / n', 'baseline_rate')}, {R('se / n', 'substitute_rate')},
 {R('(se - be) / n', 'difference')} FROM b""")
def _(spark, sf):
    p = predictions(spark, sf).select(
        F.col("seed").alias("draw"), "label", F.col("pred").alias("baseline"), "frac",
        F.pmod(F.col("label") + F.col("seed") * (F.col("score") > 25).cast("int"), F.lit(6)).alias("substitute"))
    return keyed(E.draw_errors(p, F.col("frac") < 0.5, K), ["draw"], (),
                 ["n", *SUPPORT, "baseline_errors", "substitute_errors", "baseline_rate", "substitute_rate", "difference"])


@query("a25_coverage_scores", f"""WITH {PRED}, c AS (SELECT *, unnest(['all', CASE WHEN frac = 1 THEN 'complete' ELSE 'partial' END]) AS cohort FROM pred),
oc AS (SELECT model, cohort, fold, seed, k.i AS cls, sum((label = k.i AND pred = k.i)::INT) AS tp,
 sum((label = k.i)::INT) + sum((pred = k.i)::INT) AS d FROM c CROSS JOIN range(6) k(i) GROUP BY ALL),
m AS (SELECT model, cohort, fold, seed, CASE WHEN count(2.0 * tp / nullif(d, 0)) = count(*) THEN avg(2.0 * tp / nullif(d, 0)) END AS v
 FROM oc GROUP BY ALL),
f AS (SELECT model, cohort, fold, CASE WHEN count(v) = count(*) THEN avg(v) END AS v FROM m GROUP BY ALL)
SELECT model, cohort, {R('CASE WHEN count(v) = count(*) THEN avg(v) END', 'mean')},
 {R('CASE WHEN count(v) = count(*) THEN stddev_samp(v) END', 'sd')}, count(*) AS n FROM f GROUP BY model, cohort""")
def _(spark, sf):
    return keyed(E.coverage_scores(predictions(spark, sf), ["model"], "frac", K), ["model", "cohort"], ["n"], ["mean", "sd"])


LOCATED = f"""WITH {COORD}, {MEMBERS}, located AS (SELECT m.tile_id, m.member, m.label, m.pred, c.lat, c.lon
 FROM member_pred m JOIN coord c ON m.tile_id = c.tile_id)"""


def located(spark, sf):
    return J.align(members(spark, sf).select("tile_id", "member", "label", "pred"),
                   coordinates(spark, sf).select("tile_id", "lat", "lon"))


@query("j02_align_by_id", LOCATED + f""" SELECT tile_id, member AS member, label AS label, pred AS pred,
 {R('lat::DOUBLE', 'lat')}, {R('lon::DOUBLE', 'lon')} FROM located""".replace("member AS member", B("member"))
       .replace("label AS label", B("label")).replace("pred AS pred", B("pred")))
def _(spark, sf):
    return keyed(located(spark, sf), ["tile_id", "member", "label", "pred"], (), ["lat", "lon"])


@query("a26_band_accuracy", LOCATED + f""", b AS (SELECT *, CASE WHEN lat > 60 THEN 'north_polar' WHEN lat < -60 THEN 'south_polar'
 WHEN lat > 30 THEN 'north_mid' WHEN lat < -30 THEN 'south_mid' ELSE 'equatorial' END AS band,
 CASE WHEN lon >= 180 THEN 'western' ELSE 'eastern' END AS hemi, (label = pred)::INT AS hit FROM located),
g AS (SELECT band AS region, -1 AS class, count(*) AS n, avg(hit) AS accuracy FROM b GROUP BY band
 UNION ALL SELECT band, label, count(*), avg(hit) FROM b GROUP BY band, label
 UNION ALL SELECT hemi, -1, count(*), avg(hit) FROM b GROUP BY hemi
 UNION ALL SELECT 'overall', -1, count(*), avg(hit) FROM b)
SELECT region, {B('class')}, n, {R('accuracy')} FROM g""")
def _(spark, sf):
    return keyed(E.band_accuracy(located(spark, sf), K), ["region", "class"], ["n"], ["accuracy"])


@query("a27_binned_accuracy", f"""WITH {PRED}, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM pred),
g AS (SELECT i AS bin, e[i] AS low, e[i + 1] AS high, i = len(e) - 1 AS last FROM (SELECT e, unnest(range(1, len(e))) AS i FROM e)),
c AS (SELECT corr(score, (label = pred)::INT) AS correlation FROM pred)
SELECT {B('bin')}, {R('low')}, {R('high')}, count(*) AS n, {R('avg((label = pred)::INT)', 'accuracy')}, {R('avg(score)', 'mean_x')},
 {R('max(correlation)', 'correlation')} FROM g CROSS JOIN c JOIN pred p ON p.score >= g.low AND (p.score < g.high OR g.last AND p.score <= g.high)
GROUP BY bin, low, high""")
def _(spark, sf):
    return keyed(E.binned_accuracy(predictions(spark, sf), "score", 5), ["bin"], ["n"],
                 ["low", "high", "accuracy", "mean_x", "correlation"])


@query("a28_confidence_accuracy", f"""WITH {PRED}, n AS (SELECT count(*) AS t FROM pred),
th AS (SELECT 'threshold' AS kind, t::DOUBLE AS mark, t::DOUBLE AS low, NULL::DOUBLE AS high, count(p.tile_id) AS n,
 avg((label = pred)::INT) AS accuracy FROM (VALUES (0.0), (0.3), (0.5), (0.7), (0.9), (2.0)) v(t) LEFT JOIN pred p ON p.frac >= v.t GROUP BY t),
e AS (SELECT quantile_cont(frac, [0, 0.25, 0.5, 0.75, 1]) AS e FROM pred),
q AS (SELECT 'quartile' AS kind, i::DOUBLE AS mark, e[i] AS low, e[i + 1] AS high, count(p.tile_id) AS n, avg((label = pred)::INT) AS accuracy
 FROM e CROSS JOIN range(1, 5) r(i) LEFT JOIN pred p ON p.frac >= e[i] AND (p.frac < e[i + 1] OR i = 4 AND p.frac <= e[i + 1]) GROUP BY ALL)
SELECT kind, {R('mark')}, {R('low')}, {R('high')}, n, {R('accuracy')}, {R('n / t', 'share')}
FROM (SELECT * FROM th UNION ALL SELECT * FROM q) CROSS JOIN n""")
def _(spark, sf):
    c = E.confidence_accuracy(predictions(spark, sf), "frac", [0.0, 0.3, 0.5, 0.7, 0.9, 2.0])
    return keyed(c, ["kind"], ["n"], ["mark", "low", "high", "accuracy", "share"])


@query("a29_safe_correlation", """SELECT p_brand, count(*) AS n,
 round(CASE WHEN count(DISTINCT p_size) > 1 AND count(DISTINCT p_retailprice) > 1 THEN corr(p_size, p_retailprice) END, 6) + 0.0 AS r,
 NULL::DOUBLE AS flat FROM part GROUP BY p_brand""")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), round6(E.safe_corr("p_size", "p_retailprice")).alias("r"),
                                    round6(E.safe_corr("p_size", F.lit(1.0))).alias("flat"))


@query("a30_modal_value", f"""WITH {PRED}, c AS (SELECT model, fold, score::BIGINT AS code, count(*) AS n FROM pred WHERE score < 40 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY n DESC, code) AS rn, sum(n) OVER (PARTITION BY model, fold) AS t FROM c)
SELECT model, fold::BIGINT AS fold, code AS mode, round(n / t, 4) + 0.0 AS fraction, {B('t', 'valid')} FROM r WHERE rn = 1""")
def _(spark, sf):
    p = predictions(spark, sf).withColumn("code", F.col("score").cast("bigint"))
    return keyed(E.mode_lowest(p, ["model", "fold"], "code", F.col("score") < 40), ["model", "fold"], ["mode", "valid"], ["fraction"])


STRATA = f"""WITH {PRED}, s AS (SELECT model, label, fold, sum((frac < 0.2)::INT) AS lc, avg((label <> pred)::INT) FILTER (WHERE frac < 0.2) AS le,
 sum((frac >= 0.85)::INT) AS hc, avg((label <> pred)::INT) FILTER (WHERE frac >= 0.85) AS he FROM pred GROUP BY ALL)"""


@query("a31_strata_errors", STRATA + f""" SELECT model, {B('label')}, {B('fold')}, {B('lc', 'low_count')}, {R('le', 'low_error')},
 {B('hc', 'high_count')}, {R('he', 'high_error')}, least(lc, hc) >= 100 AS eligible FROM s""")
def _(spark, sf):
    s = E.strata_errors(predictions(spark, sf), ["model", "label", "fold"], "frac", 0.2, 0.85, 100)
    return s.select("model", bi("label").alias("label"), bi("fold").alias("fold"), "low_count", "high_count",
                    round6("low_error").alias("low_error"), round6("high_error").alias("high_error"), "eligible")


@query("a31_strata_contrast", STRATA + f""" SELECT model, count(*) AS strata, {R('avg(le)', 'low_error')}, {R('avg(he)', 'high_error')},
 {R('avg(le - he)', 'low_minus_high')} FROM s WHERE least(lc, hc) >= 100 GROUP BY model""")
def _(spark, sf):
    s = E.strata_errors(predictions(spark, sf), ["model", "label", "fold"], "frac", 0.2, 0.85, 100)
    return keyed(E.strata_contrast(s, ["model"]), ["model"], ["strata"], ["low_error", "high_error", "low_minus_high"])


@query("a35_part_support", f"""WITH p AS (SELECT DISTINCT l_orderkey AS tile, l_suppkey AS part FROM lineitem),
s AS (SELECT part, count(*) AS tiles, row_number() OVER (ORDER BY count(*) DESC, part) AS rn FROM p GROUP BY part),
c AS (SELECT count(DISTINCT tile) AS c FROM p WHERE part IN (SELECT part FROM s WHERE rn <= 2))
SELECT part, tiles, {B('CASE WHEN rn <= 2 THEN rn ELSE 0 END', 'place')},
 {R('tiles / (SELECT count(DISTINCT tile) FROM p)', 'fraction')}, c AS top_two_tiles FROM s CROSS JOIN c""")
def _(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"), F.col("l_suppkey").alias("part"))
    return keyed(E.part_support(p), ["part"], ["tiles", "place", "top_two_tiles"], ["fraction"])


@query("j13_part_membership", f"""WITH m AS (SELECT l_orderkey AS tile_id, unnest([l_suppkey, l_suppkey + 1000]) AS part,
 unnest([l_quantity, l_tax * 100]) AS px FROM lineitem)
SELECT part, count(*) AS rows, {R('sum(px)', 'pixels')} FROM m WHERE tile_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY part""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"), F.create_map(
        F.col("l_suppkey"), F.col("l_quantity"), F.col("l_suppkey") + 1000, F.col("l_tax") * 100).alias("parts"))
    t = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tile_id"))
    return keyed(E.part_counts(t, li).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("pixels").alias("pixels")),
                 ["part"], ["rows"], ["pixels"])


# ---- ensembles ----------------------------------------------------------------------------

@query("j03_model_alignment", f"""WITH {MEMBERS}, u AS (SELECT tile_id, member FROM member_pred WHERE NOT (label = 5 AND member = 4)
 UNION ALL SELECT tile_id, member FROM member_pred WHERE label = 2 AND member = 0),
p AS (SELECT tile_id, member, count(*) AS n FROM u GROUP BY ALL)
SELECT tile_id, count(*) AS models, {B('max(n)', 'most_rows')} FROM p GROUP BY tile_id HAVING count(*) <> 5 OR max(n) > 1""")
def _(spark, sf):
    m = members(spark, sf).select("tile_id", "member", "label")
    lost = (F.col("label") == 5) & (F.col("member") == 4)
    twice = m.where("label = 2 and member = 0")
    bad = E.align_models(m.where(~lost).unionByName(twice), 5)
    return keyed(bad, ["tile_id"], ["models", "most_rows"])


ENSEMBLE = f"""WITH {MEMBERS}, mp AS (SELECT tile_id, cls, avg(p) AS p FROM prob GROUP BY ALL),
ent AS (SELECT tile_id, -sum(least(greatest(p, 1e-10), 1.0) * ln(least(greatest(p, 1e-10), 1.0))) AS entropy, max(p) AS top FROM mp GROUP BY tile_id),
vote AS (SELECT tile_id, pred, count(*) AS n FROM member_pred GROUP BY ALL),
dis AS (SELECT tile_id, 1 - max(n) / sum(n) AS disagreement FROM vote GROUP BY tile_id),
ens AS (SELECT e.tile_id, entropy, disagreement, b.label % 6 AS label FROM ent e JOIN dis d ON e.tile_id = d.tile_id JOIN embeddings b ON b.vec_id = e.tile_id),
sc AS (SELECT *, ((entropy - min(entropy) OVER ()) / (max(entropy) OVER () - min(entropy) OVER ())
 + (disagreement - min(disagreement) OVER ()) / (max(disagreement) OVER () - min(disagreement) OVER ())) / 2 AS score FROM ens)"""


def ensemble(spark, sf):
    m = members(spark, sf)
    e = E.ensemble_entropy(m, ["tile_id", "label"], K).withColumn("entropy", F.round("entropy", 12))
    return e.join(E.disagreement(m, ["tile_id"]), "tile_id")


@query("a43_ensemble_disagreement", ENSEMBLE + f" SELECT tile_id, {R('disagreement')} FROM dis")
def _(spark, sf):
    return keyed(E.disagreement(members(spark, sf), ["tile_id"]), ["tile_id"], (), ["disagreement"])


@query("a44_ensemble_entropy", ENSEMBLE + f" SELECT tile_id, {R('entropy')}, {R('top')} FROM ent")
def _(spark, sf):
    e = E.ensemble_entropy(members(spark, sf), ["tile_id"], K).withColumn("top", F.array_max("prob"))
    return keyed(e, ["tile_id"], (), ["entropy", "top"])


@query("a45_composite_score", ENSEMBLE + f" SELECT tile_id, {R('entropy')}, {R('disagreement')}, {R('score')} FROM sc")
def _(spark, sf):
    return keyed(E.composite(ensemble(spark, sf), ["entropy", "disagreement"]), ["tile_id"], (),
                 ["entropy", "disagreement", "score"])


@query("r09_priority_topk", ENSEMBLE + f""" SELECT {B('row_number() OVER (ORDER BY round(score, 9) DESC, tile_id)', 'rank')}, tile_id, {R('score')}
 FROM sc ORDER BY round(score, 9) DESC, tile_id LIMIT 10""")
def _(spark, sf):
    c = E.composite(ensemble(spark, sf), ["entropy", "disagreement"]).withColumn("score", F.round("score", 9))
    return keyed(X.priority_topk(c.select("tile_id", "score"), "score", "tile_id", 10), ["tile_id"], ["rank"], ["score"])


@query("a41_distributions", ENSEMBLE + f""" SELECT {B('label', 'class')}, count(*) AS n, {R('avg(entropy)', 'mean_entropy')}, {R('avg(disagreement)', 'mean_disagreement')}
 FROM ens GROUP BY label UNION ALL SELECT -1, count(*), {R('avg(entropy)')}, {R('avg(disagreement)')} FROM ens""".replace(" AS avg(entropy)", "").replace(" AS avg(disagreement)", ""))
def _(spark, sf):
    d = E.distributions(ensemble(spark, sf), "label", ["entropy", "disagreement"])
    return keyed(d, ["class"], ["n"], ["mean_entropy", "mean_disagreement"])


@query("a42_contrast_ratio", f"""WITH m AS (SELECT l_shipmode, l_returnflag, avg(l_extendedprice) AS m FROM (
 SELECT l_suppkey AS l_shipmode, l_returnflag, l_extendedprice FROM lineitem) GROUP BY ALL)
SELECT l_shipmode AS supplier, {R('CASE WHEN count(*) < 2 THEN 0 ELSE coalesce((max(m) - min(m)) / nullif(avg(m), 0), 0) END', 'contrast')},
 count(*) AS classes FROM m GROUP BY l_shipmode""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "supplier")
    return keyed(E.contrast_ratio(li, ["supplier"], "l_returnflag", "l_extendedprice"), ["supplier"], ["classes"], ["contrast"])


# ---- training records -------------------------------------------------------------------------

@query("a38_batch_availability", f"""WITH {PRED}, c AS (SELECT model, fold, seed, count(*) AS n, sum((label = 5)::INT) AS k FROM pred GROUP BY ALL),
p AS (SELECT model, fold, seed, n, k, (SELECT CASE WHEN n - k < 32 THEN 0 ELSE product((n - k - i)::DOUBLE / (n - i)) END FROM range(32) r(i)) AS none_full,
 CASE WHEN n % 32 = 0 THEN 1 WHEN n - k < n % 32 THEN 0 ELSE (SELECT product((n - k - i)::DOUBLE / (n - i)) FROM range(32) r(i) WHERE i < n % 32) END AS none_rest FROM c),
e AS (SELECT *, ceil(n / 32) AS batches, floor(n / 32) * (1 - none_full) + (1 - none_rest) AS expected FROM p)
SELECT model, fold::BIGINT AS fold, seed::BIGINT AS seed, n, {B('k')}, {B('batches')}, {R('expected')},
 {R('expected / batches', 'expected_fraction')}, {R('least(k, batches) / batches', 'upper_bound')} FROM e""")
def _(spark, sf):
    c = predictions(spark, sf).groupBy("model", "fold", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 5).alias("k"))
    return keyed(E.batch_availability(c, "n", "k", 32), ["model", "fold", "seed"], ["n", "k", "batches"],
                 ["expected", "expected_fraction", "upper_bound"])


@query("a46_history_budget", f"""WITH {HIST} SELECT cell, count(*) AS epochs, {B('sum(steps)', 'steps')}, {B('sum(skipped)', 'skipped')},
 {B('sum(20 + cell % 3 * 20)', 'presentations')}, bool_and(steps + skipped = ceil((20 + cell % 3 * 20) / 32)) AS budget_ok FROM hist GROUP BY cell""")
def _(spark, sf):
    b = E.history_budget(histories(spark, sf), ["cell"], 20 + F.pmod("cell", F.lit(3)) * 20)
    return b.select("cell", "epochs", bi("steps").alias("steps"), bi("skipped").alias("skipped"),
                    bi("presentations").alias("presentations"), "budget_ok")


@query("a47_batch_composition", f"""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS label, row_number() OVER (ORDER BY md5(concat_ws(':', '3', o_orderkey)), o_orderkey) AS rn FROM orders)
SELECT (rn - 1) // 256 AS batch, count(*) AS size, {', '.join(B(f'sum((label = {c})::INT)', f'class_{c}') for c in range(K))},
 sha256('[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) || ']') AS digest FROM r GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(6)).alias("label"))
    return E.batch_composition(o, "o_orderkey", "label", 256, 3, K)


# ---- membership -----------------------------------------------------------------------------

@query("j01_catalog_split", f"""WITH {FOLDS} SELECT vec_id AS tile_id, label::BIGINT AS label, fold, role FROM folds""")
def _(spark, sf):
    catalog = features(spark, sf).select(F.col("vec_id").alias("tile_id"), "label")
    parts = None
    for f in range(5):
        splits = folds(spark, sf).where(F.col("fold") == f).select(F.col("vec_id").alias("tile_id"), "role")
        one = J.apply_split(catalog, splits).withColumn("fold", F.lit(f))
        parts = one if parts is None else parts.unionByName(one)
    return keyed(parts, ["tile_id", "label", "fold", "role"])


@query("j04_scores_by_cohort", f"""WITH {PRED} SELECT model, cohort, {B('count(*)', 'rows')}, {B('sum((label = pred)::INT)', 'correct')}
FROM (SELECT model, label, pred, unnest(['all', CASE WHEN frac = 1 THEN 'complete' ELSE 'partial' END]) AS cohort FROM pred) GROUP BY ALL""")
def _(spark, sf):
    # the five-column ID can repeat in synthetic data, so sides are reduced to one row per ID first
    p = predictions(spark, sf).repartition("tile_id")  # each side is reduced and joined where its rows are
    pred = p.groupBy("tile_id", "model", "pred").agg(F.count(F.lit(1)).alias("w"))
    truth = p.select("tile_id", "label").distinct()
    cohorts = p.select("tile_id", F.explode(F.array(F.lit("all"), F.when(F.col("frac") == 1, "complete").otherwise("partial"))).alias("cohort")).distinct()
    j = J.join_scores(pred, truth, cohorts)
    return j.groupBy("model", "cohort").agg(F.sum("w").alias("rows"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("w")).otherwise(0)).alias("correct"))


@query("p07_supported_classes", """SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE embedding[1] > 0.2)""")
def _(spark, sf):
    f = features(spark, sf)
    return keyed(J.restrict_to_source_classes(f, f.where(F.col("f")[0] > 0.2)), ["vec_id", "label"])


@query("u03_class_overlap", """WITH a AS (SELECT DISTINCT label FROM embeddings WHERE embedding[1] > 0.2), b AS (SELECT DISTINCT label FROM embeddings WHERE embedding[2] > 0.2)
SELECT coalesce(a.label, b.label)::BIGINT AS label, CASE WHEN b.label IS NULL THEN 'absent' WHEN a.label IS NULL THEN 'extra' ELSE 'supported' END AS status
FROM a FULL JOIN b ON a.label = b.label""")
def _(spark, sf):
    f = features(spark, sf)
    return keyed(J.class_overlap(f.where(F.col("f")[0] > 0.2), f.where(F.col("f")[1] > 0.2)), ["label", "status"])


@query("u01_test_union", f"""WITH {FOLDS} SELECT vec_id, count(*) AS folds FROM folds WHERE role = 'test' GROUP BY vec_id""")
def _(spark, sf):
    return J.test_union(folds(spark, sf), "vec_id")


DRAW = """WITH e AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 > 1),
b AS (SELECT label, count(*) AS need FROM embeddings WHERE vec_id % 5 = 1 GROUP BY label),
r AS (SELECT d AS draw, vec_id, label, row_number() OVER (PARTITION BY d, label ORDER BY md5(concat_ws(':', d, vec_id)), vec_id) AS rn FROM e CROSS JOIN range(5) t(d)),
removed AS (SELECT draw, vec_id, r.label FROM r JOIN b ON r.label = b.label AND rn <= need)"""


def fold0(spark, sf):
    f = folds(spark, sf).where("fold = 0").select("vec_id", "label", "role")
    return f.where("role = 'train'").drop("role"), f.where("role = 'val'").drop("role")


@query("j15_replacement_draw", DRAW + " SELECT draw, vec_id, label::BIGINT AS label FROM removed")
def _(spark, sf):
    train, boundary = fold0(spark, sf)
    return keyed(J.replacement_draw(train, boundary, 5, "label", "vec_id"), ["draw", "vec_id", "label"])


@query("u02_replaced_members", DRAW + """ SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id % 5 = 1
UNION SELECT vec_id, label FROM e WHERE vec_id NOT IN (SELECT vec_id FROM removed WHERE draw = 0)""")
def _(spark, sf):
    train, boundary = fold0(spark, sf)
    removed = J.replacement_draw(train, boundary, 1, "label", "vec_id")
    return keyed(J.replace_members(train, removed, boundary, "vec_id"), ["vec_id", "label"])


@query("u04_leave_one_site_out", """WITH s AS (SELECT s_suppkey, n_nationkey AS product, n_regionkey AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT DISTINCT site, product, t AS test_site FROM s CROSS JOIN range(5) r(t)),
r AS (SELECT *, row_number() OVER (PARTITION BY test_site ORDER BY md5(concat_ws(':', '1', product)), product) AS rn,
 ceil(count(*) OVER (PARTITION BY test_site) * 0.2) AS q FROM p WHERE site <> test_site)
SELECT s.s_suppkey, s.site::BIGINT AS site, t AS test_group, CASE WHEN s.site = t THEN 'test' WHEN r.product IS NOT NULL THEN 'val' ELSE 'train' END AS role
FROM s CROSS JOIN range(5) g(t) LEFT JOIN r ON r.test_site = t AND r.product = s.product AND r.rn <= r.q""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("product"), F.col("n_regionkey").alias("site"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("product")).join(F.broadcast(n), "product")
    return keyed(J.leave_one_group_out(s, "site", "product", list(range(5)), 0.2, 1), ["s_suppkey", "site", "test_group", "role"])


@query("u07_omit_each_group", """WITH s AS (SELECT c_custkey, c_nationkey % 7 AS label, n_regionkey AS site FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT o AS omitted, label FROM s CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3'), ('4'), ('NONE')) v(o) WHERE o <> site::VARCHAR)
SELECT omitted, count(*) AS rows, count(DISTINCT label) AS classes, count(DISTINCT label) < 7 AS class_lost FROM p GROUP BY omitted""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("site"))
    c = table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey").select(
        "c_custkey", "site", F.pmod("c_nationkey", F.lit(7)).alias("label"))
    return J.lost_classes(J.omit_each(c, "site", list(range(5))), 7)


@query("p33_correct_flags", f"""WITH {PRED} SELECT model, {B('label')}, {B('sum((label = pred)::INT)', 'correct')},
 {B('sum((label = 5 AND pred = 5)::INT)', 'hit_5')} FROM pred GROUP BY model, label""")
def _(spark, sf):
    p = E.mark_correct(predictions(spark, sf), 5)
    return p.groupBy("model", bi("label").alias("label")).agg(F.count_if("correct").alias("correct"), F.count_if("hit").alias("hit_5"))


@query("p20_probability_entropy", f"""WITH {MEMBERS} SELECT tile_id, {B('member')}, {R('-sum(least(greatest(p, 1e-10), 1.0) * ln(least(greatest(p, 1e-10), 1.0)))', 'entropy')}
FROM prob GROUP BY tile_id, member""")
def _(spark, sf):
    return keyed(members(spark, sf).withColumn("entropy", S.entropy("prob")), ["tile_id", "member"], (), ["entropy"])


@query("p21_first_argmax", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity % 4, l_linenumber % 4, l_suppkey % 4, l_partkey % 4] AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, (list_position(v, list_max(v)) - 1)::BIGINT AS top FROM g""")
def _(spark, sf):
    four = lambda c: (F.col(c) % 4).cast("double")
    li = table(spark, sf, "lineitem").withColumn("v", F.array(four("l_quantity"), four("l_linenumber"), four("l_suppkey"), four("l_partkey")))
    return keyed(li.withColumn("top", S.argmax("v")), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["top"])
