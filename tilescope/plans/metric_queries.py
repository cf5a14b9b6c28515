"""Count, metric, summary and contrast queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions.scalars import hash_unit, seeded_hash
from tilescope.operators import metrics as M
from tilescope.plans.fixtures import DENSE, K, PRED, predictions
from tilescope.plans.registry import query
from tilescope.session import small_side
from tilescope.plans.shape import B, R, keyed

CELL = ["model", "fold", "seed"]


CK = "model, fold::BIGINT AS fold, seed::BIGINT AS seed"


@query("a01_class_counts", f"""WITH {PRED}, d AS (SELECT DISTINCT model, fold FROM pred)
SELECT d.model, d.fold::BIGINT AS fold, k.i AS class, count(p.label) AS n
FROM d CROSS JOIN range(6) k(i) LEFT JOIN pred p ON p.model = d.model AND p.fold = d.fold AND p.label = k.i
GROUP BY ALL""")
def _(spark, sf):
    return keyed(M.class_counts(predictions(spark, sf), ["model", "fold"], K),
                 ["model", "fold", "class"], ["n"])


WEIGHTS = f"""WITH {PRED}, cc AS (SELECT d.model, k.i AS class, count(p.label) AS n
 FROM (SELECT DISTINCT model FROM pred) d CROSS JOIN range(6) k(i)
 LEFT JOIN pred p ON p.model = d.model AND p.label = k.i GROUP BY ALL),
iw AS (SELECT model, class, n, (1.0 / greatest(n, 1)) / avg(1.0 / greatest(n, 1)) OVER (PARTITION BY model) AS weight
 FROM cc)"""


@query("a02_inverse_frequency_weights", WEIGHTS + f""" SELECT model, class, n, {R('weight')} FROM iw""")
def _(spark, sf):
    counts = M.class_counts(predictions(spark, sf), ["model"], K)
    return keyed(M.inv_freq_weights(counts, ["model"]), ["model", "class"], ["n"], ["weight"])


@query("a03_balanced_weights", f"""WITH {PRED}, w AS (SELECT model, label, count(*) AS n,
 sum(count(*)) OVER (PARTITION BY model) / (6.0 * count(*)) AS weight FROM pred GROUP BY model, label)
SELECT model, label::BIGINT AS class, n, {R('n * weight', 'weight_sum')}, {R('weight')} FROM w""")
def _(spark, sf):
    p = predictions(spark, sf)
    weights = M.balanced_weights(M.class_counts(p, ["model"], K), ["model"], K)
    rows = M.with_class_weight(p.select("model", "label"), weights, ["model"])
    return keyed(rows.groupBy("model", F.col("label").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight_sum"), F.min("weight").alias("weight")),
        ["model", "class"], ["n"], ["weight_sum", "weight"])


@query("a04_population_weight", WEIGHTS + f"""
SELECT model, {R('sum(n * weight) / sum(n)', 'population_weight')} FROM iw GROUP BY model""")
def _(spark, sf):
    counts = M.class_counts(predictions(spark, sf), ["model"], K)
    return keyed(M.population_weight(M.inv_freq_weights(counts, ["model"]), ["model"]),
                 ["model"], (), ["population_weight"])


@query("a05_confusion_counts", DENSE + f" SELECT {CK}, label::BIGINT AS label, pred::BIGINT AS pred, {B('n')} FROM cm")
def _(spark, sf):
    return keyed(M.confusion(predictions(spark, sf), CELL, K), [*CELL, "label", "pred"], ["n"])


@query("a06_confusion_rates", DENSE + f""" SELECT {CK}, label::BIGINT AS label, pred::BIGINT AS pred, {B('n')},
 {R('n / greatest(sum(n) OVER (PARTITION BY model, fold, seed, label), 1)', 'rate')} FROM cm""")
def _(spark, sf):
    cm = M.confusion(predictions(spark, sf), CELL, K)
    return keyed(M.confusion_rates(cm, CELL), [*CELL, "label", "pred"], ["n"], ["rate"])


@query("a07_class_metrics", DENSE + f""" SELECT {CK}, cls::BIGINT AS class, {B('support')},
 {R('precision')}, {R('recall')}, {R('f1')} FROM met""")
def _(spark, sf):
    m = M.class_metrics(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    return keyed(m, [*CELL, "class"], ["support"], ["precision", "recall", "f1"])


@query("a08_macro_policies", DENSE + f""" SELECT {CK}, policy, {R('CASE policy '
 'WHEN $$all$$ THEN avg(coalesce(f1, 0)) WHEN $$supported$$ THEN avg(coalesce(f1, 0)) FILTER (WHERE support > 0) '
 'ELSE CASE WHEN count(f1) = count(*) THEN avg(f1) END END', 'macro_f1')}
 FROM met CROSS JOIN (VALUES ('all'), ('supported'), ('strict')) p(policy) GROUP BY model, fold, seed, policy""")
def _(spark, sf):
    m = M.class_metrics(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    parts = [M.macro(m, CELL, p).withColumn("policy", F.lit(p)) for p in ("all", "supported", "strict")]
    return keyed(parts[0].unionByName(parts[1]).unionByName(parts[2]), [*CELL, "policy"], (), ["macro_f1"])


@query("a09_balanced_accuracy", DENSE + f""" SELECT {CK},
 {R('coalesce(avg(recall) FILTER (WHERE support > 0), 0)', 'balanced_accuracy')},
 {R('coalesce(avg(recall) FILTER (WHERE support > 0 AND cls IN (0, 1, 2, 4)), 0)', 'supported_macro')}
 FROM met GROUP BY model, fold, seed""")
def _(spark, sf):
    m = M.class_metrics(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    every = M.balanced_accuracy(m, CELL)
    some = M.balanced_accuracy(m, CELL, [0, 1, 2, 4]).withColumnRenamed("balanced_accuracy", "supported_macro")
    return keyed(every.join(some, CELL), CELL, (), ["balanced_accuracy", "supported_macro"])


@query("a10_cohen_kappa", f"""WITH {PRED}, tot AS (SELECT model, fold, seed, count(*) AS n,
 sum((label = pred)::INT) / count(*) AS po FROM pred GROUP BY ALL),
rm AS (SELECT model, fold, seed, label AS c, count(*) AS n FROM pred GROUP BY ALL),
cmg AS (SELECT model, fold, seed, pred AS c, count(*) AS n FROM pred GROUP BY ALL),
pe AS (SELECT rm.model, rm.fold, rm.seed, sum(rm.n::DOUBLE * cmg.n) AS s FROM rm JOIN cmg
 ON rm.model = cmg.model AND rm.fold = cmg.fold AND rm.seed = cmg.seed AND rm.c = cmg.c GROUP BY ALL)
SELECT tot.model, tot.fold::BIGINT AS fold, tot.seed::BIGINT AS seed, tot.n,
 {R('(po - s / (n::DOUBLE * n)) / (1 - s / (n::DOUBLE * n))', 'kappa')}
FROM tot JOIN pe ON tot.model = pe.model AND tot.fold = pe.fold AND tot.seed = pe.seed""")
def _(spark, sf):
    k = M.kappa(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    return keyed(k, CELL, ["n"], ["kappa"])


@query("a11_outcome_counts", DENSE + f""" SELECT {CK}, cls::BIGINT AS class, {B('tp')}, {B('predicted - tp', 'fp')},
 {B('support - tp', 'fn')}, {B('predicted')} FROM pc""")
def _(spark, sf):
    o = M.outcome_counts(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    return keyed(o, [*CELL, "class"], ["tp", "fp", "fn", "predicted"])


@query("a12_top_errors", f"""WITH {PRED}, c AS (SELECT label, pred, count(*) AS n FROM pred GROUP BY ALL),
r AS (SELECT label, pred, n, n / sum(n) OVER (PARTITION BY label) AS rate FROM c)
SELECT label::BIGINT AS label, pred::BIGINT AS pred, n, {R('rate')} FROM r WHERE label <> pred
ORDER BY n DESC, r.label, r.pred LIMIT 5""")
def _(spark, sf):
    cm = M.confusion(predictions(spark, sf), [], K)
    return keyed(M.top_errors(cm, 5), ["label", "pred"], ["n"], ["rate"])


@query("a13_confusion_report", f"""WITH {PRED}, oc AS (SELECT p.model, k.i AS cls,
 sum((label = k.i AND pred = k.i)::INT) AS tp, sum((label = k.i)::INT) AS support,
 sum((pred = k.i)::INT) AS predicted FROM pred p CROSS JOIN range(6) k(i) GROUP BY ALL),
long AS (SELECT model, cls, unnest(['precision', 'recall', 'f1', 'support']) AS metric,
 unnest([coalesce(tp / nullif(predicted, 0), 0), coalesce(tp / nullif(support, 0), 0),
  coalesce(2.0 * tp / nullif(support + predicted, 0), 0), support::DOUBLE]) AS value FROM oc
 UNION ALL SELECT model, -1, 'accuracy', avg((label = pred)::INT) FROM pred GROUP BY model)
SELECT model, cls::BIGINT AS class, metric, {R('value')} FROM long""")
def _(spark, sf):
    return keyed(M.confusion_report(predictions(spark, sf), ["model"], K),
                 ["model", "class", "metric"], (), ["value"])


MACRO = DENSE + """, mac AS (SELECT model, fold, seed, avg(coalesce(f1, 0)) AS f1, avg(coalesce(recall, 0)) AS recall
 FROM met GROUP BY model, fold, seed)"""


def macro_table(spark, sf):
    m = M.class_metrics(M.pair_counts(predictions(spark, sf), CELL), CELL, K)
    return M.macro(m, CELL, "all")


@query("a14_fold_summary", MACRO + f""", pf AS (SELECT model, fold, avg(f1) AS v FROM mac GROUP BY ALL)
SELECT model, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'sd')}, count(*) AS folds,
 {R('min(v)', 'lowest')}, {R('max(v)', 'highest')} FROM pf GROUP BY model""")
def _(spark, sf):
    return keyed(M.summarize_folds(macro_table(spark, sf), ["model"], "macro_f1"),
                 ["model"], ["folds"], ["mean", "sd", "lowest", "highest"])


SCARCE = f"""WITH {PRED}, v AS (SELECT model, fold, seed, sum((label = 5 AND pred = 5 AND score > 45)::INT) /
 nullif(sum((label = 5 AND score > 45 AND frac > 0.85)::INT), 0) AS x FROM pred GROUP BY ALL)"""


def scarce(spark, sf):
    """A per-cell ratio that is undefined in some cells."""
    hit = (F.col("label") == 5) & (F.col("score") > 45)
    return predictions(spark, sf).groupBy(*CELL).agg(F.try_divide(
        F.count_if(hit & (F.col("pred") == 5)), F.count_if(hit & (F.col("frac") > 0.85))).alias("x"))


@query("a15_strict_summary", SCARCE + f""" SELECT model, fold::BIGINT AS fold,
 {R('CASE WHEN count(x) = count(*) THEN avg(x) END', 'mean')},
 {R('CASE WHEN count(x) = count(*) THEN stddev_samp(x) END', 'sd')}, count(*) AS n FROM v GROUP BY model, fold""")
def _(spark, sf):
    return keyed(M.summarize_strict(scarce(spark, sf), ["model", "fold"], "x"),
                 ["model", "fold"], ["n"], ["mean", "sd"])


@query("a16_seed_summary", SCARCE + f""" SELECT model, fold::BIGINT AS fold, {R('avg(x)', 'mean')},
 {R('stddev_samp(x)', 'sd')}, count(x) AS n FROM v GROUP BY model, fold""")
def _(spark, sf):
    return keyed(M.summarize_seeds(scarce(spark, sf), ["model", "fold"], "x"),
                 ["model", "fold"], ["n"], ["mean", "sd"])


@query("a17_pooled_metrics", f"""WITH {PRED}, oc AS (SELECT p.model, p.seed, k.i AS cls,
 sum((label = k.i AND pred = k.i)::INT) AS tp, sum((label = k.i)::INT) AS support,
 sum((pred = k.i)::INT) AS predicted FROM pred p CROSS JOIN range(6) k(i) GROUP BY ALL),
ps AS (SELECT model, seed, avg(coalesce(tp / nullif(predicted, 0), 0)) AS p, avg(coalesce(tp / nullif(support, 0), 0)) AS r,
 avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS f FROM oc GROUP BY ALL)
SELECT model, {R('avg(p)', 'macro_precision')}, {R('avg(r)', 'macro_recall')}, {R('avg(f)', 'macro_f1')},
 count(*) AS seeds FROM ps GROUP BY model""")
def _(spark, sf):
    return keyed(M.pooled_metrics(M.pair_counts(predictions(spark, sf), CELL), ["model"], K),
                 ["model"], ["seeds"], [f"macro_{m}" for m in M.METRICS])


@query("j12_paired_arms", MACRO + f""" SELECT a.fold::BIGINT AS fold, a.seed::BIGINT AS seed,
 {R('a.f1', 'value_a')}, {R('b.f1', 'value_b')} FROM mac a JOIN mac b USING (fold, seed)
 WHERE a.model = 'A' AND b.model = 'N'""")
def _(spark, sf):
    return keyed(M.paired(macro_table(spark, sf), ["fold", "seed"], "model", "A", "N", "macro_f1"),
                 ["fold", "seed"], (), ["value_a", "value_b"])


@query("a18_paired_contrast", MACRO + f""", d AS (SELECT a.fold, avg((a.f1 - b.f1) * 100) AS v
 FROM mac a JOIN mac b USING (fold, seed) WHERE a.model = 'A' AND b.model = 'R' GROUP BY a.fold)
SELECT {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'sd')}, count(*) AS folds FROM d""")
def _(spark, sf):
    return keyed(M.contrast(macro_table(spark, sf), "model", "A", "R", "macro_f1"), [], ["folds"], ["mean", "sd"])


@query("a19_unpaired_contrast", MACRO + f""" SELECT fold::BIGINT AS fold,
 {R("avg(f1) FILTER (WHERE model = 'A')", 'single')}, {R("avg(f1) FILTER (WHERE model <> 'A')", 'many_mean')},
 {R("avg(f1) FILTER (WHERE model = 'A') - avg(f1) FILTER (WHERE model <> 'A')", 'diff')} FROM mac GROUP BY fold""")
def _(spark, sf):
    return keyed(M.contrast_unpaired(macro_table(spark, sf), "model", "A", ["N", "R"], "macro_f1"),
                 ["fold"], (), ["single", "many_mean", "diff"])


@query("a20_pairwise_contrasts", MACRO + f""", pf AS (SELECT model, fold, avg(f1) AS v FROM mac GROUP BY ALL)
SELECT a.model AS family_a, b.model AS family_b, {R('avg(a.v - b.v)', 'mean')}, {R('stddev_samp(a.v - b.v)', 'sd')},
 {B('sum((a.v - b.v > 1e-12)::INT)', 'positive')}, {B('sum((a.v - b.v < -1e-12)::INT)', 'negative')},
 {B('sum((abs(a.v - b.v) <= 1e-12)::INT)', 'ties')}
FROM pf a JOIN pf b ON a.fold = b.fold AND a.model < b.model GROUP BY ALL""")
def _(spark, sf):
    pf = macro_table(spark, sf).groupBy("model", "fold").agg(F.avg("macro_f1").alias("v"))
    return keyed(M.pairwise_contrasts(pf, "model", "v"), ["family_a", "family_b"],
                 ["positive", "negative", "ties"], ["mean", "sd"])


@query("a21_interaction", MACRO + f""", c AS (SELECT model, fold,
 avg(f1) FILTER (WHERE seed % 2 = 0 AND seed <= 4) AS v00, avg(f1) FILTER (WHERE seed % 2 = 0 AND seed > 4) AS v01,
 avg(f1) FILTER (WHERE seed % 2 = 1 AND seed <= 4) AS v10, avg(f1) FILTER (WHERE seed % 2 = 1 AND seed > 4) AS v11
 FROM mac GROUP BY ALL)
SELECT model, fold::BIGINT AS fold, {R('v10 - v00', 'first_at_0')}, {R('v11 - v01', 'first_at_1')},
 {R('v01 - v00', 'second_at_0')}, {R('v11 - v10', 'second_at_1')},
 {R('(v11 - v01) - (v10 - v00)', 'interaction')} FROM c""")
def _(spark, sf):
    t = (macro_table(spark, sf).withColumn("f1_", F.col("seed") % 2)
         .withColumn("f2_", (F.col("seed") > 4).cast("int")))
    return keyed(M.interaction(t, ["model", "fold"], "f1_", "f2_", "macro_f1"), ["model", "fold"], (),
                 ["first_at_0", "first_at_1", "second_at_0", "second_at_1", "interaction"])


# p for 4 degrees of freedom has the closed form 1 - s (1 + c^2/2) with tan(theta) = |t|/2
@query("a22_paired_t", MACRO + f""", d AS (SELECT b.model, a.fold, avg(a.f1 - b.f1) AS v
 FROM mac a JOIN mac b USING (fold, seed) WHERE a.model = 'A' AND b.model <> 'A' GROUP BY ALL),
s AS (SELECT model, avg(v) AS mean, count(*) AS n, avg(v) / (stddev_samp(v) / sqrt(count(*))) AS t FROM d GROUP BY model)
SELECT model, {R('mean')}, n, {R('t')}, n - 1 AS df,
 {R('1 - (abs(t) / sqrt(4 + t * t)) * (1 + 0.5 * 4 / (4 + t * t))', 'p')} FROM s""")
def _(spark, sf):
    m = macro_table(spark, sf)
    a = m.where("model = 'A'").select("fold", "seed", F.col("macro_f1").alias("a"))
    d = (m.where("model <> 'A'").join(a, ["fold", "seed"]).groupBy("model", "fold")
         .agg(F.avg(F.col("a") - F.col("macro_f1")).alias("d")))
    t = M.paired_t(d, ["model"], "d").withColumn("p", M.student_t_two_sided(F.col("t"), F.col("df")))
    return keyed(t, ["model"], ["n", "df"], ["mean", "t", "p"])


@query("a23_control_summary", MACRO + f""", ref AS (SELECT fold, avg(f1) AS a FROM mac WHERE model = 'A' GROUP BY fold),
rep AS (SELECT fold, avg(f1) AS b FROM mac WHERE model = 'N' GROUP BY fold),
j AS (SELECT a, b FROM ref JOIN rep USING (fold))
SELECT 'reference' AS quantity, {R('avg(a)', 'mean')}, {R('stddev_samp(a)', 'sd')}, count(*) AS folds FROM j
UNION ALL SELECT 'replacement', round(avg(b), 6) + 0.0, round(stddev_samp(b), 6) + 0.0, count(*) FROM j
UNION ALL SELECT 'difference', round(avg(a - b), 6) + 0.0, round(stddev_samp(a - b), 6) + 0.0, count(*) FROM j""")
def _(spark, sf):
    m = macro_table(spark, sf).withColumnRenamed("seed", "draw")
    c = M.control_summary(m.where("model = 'A'"), m.where("model = 'N'"), "macro_f1")
    return keyed(c, ["quantity"], ["folds"], ["mean", "sd"])


@query("a39_weighted_loss", WEIGHTS + f""", r AS (SELECT p.model, p.fold, iw.weight,
 0.05 + 0.9 * ((('0x' || substr(md5(concat_ws(':', '7', tile_id)), 1, 8))::BIGINT) / 4294967296.0) AS pl
 FROM pred p JOIN iw ON iw.model = p.model AND iw.class = p.label)
SELECT model, fold::BIGINT AS fold, {R('sum(-weight * ln(pl))', 'numerator')}, {R('sum(weight)', 'weight_sum')},
 count(*) AS n, {R('sum(-weight * ln(pl)) / sum(weight)', 'loss')},
 {R('sum(-weight * ln(pl)) / count(*)', 'loss_per_row')} FROM r GROUP BY model, fold""")
def _(spark, sf):
    p = predictions(spark, sf)
    w = M.inv_freq_weights(M.class_counts(p, ["model"], K), ["model"])
    rows = M.with_class_weight(p, w, ["model"]).withColumn(
        "pl", 0.05 + 0.9 * hash_unit(seeded_hash(7, "tile_id")))
    loss = M.weighted_loss(rows, ["model", "fold"], "pl", "weight")
    return keyed(loss.withColumn("loss_per_row", F.col("numerator") / F.col("n")), ["model", "fold"], ["n"],
                 ["numerator", "weight_sum", "loss", "loss_per_row"])


@query("a40_single_example_leverage", f"""WITH {PRED}, one AS (SELECT DISTINCT model, fold, seed FROM pred),
rare AS (SELECT model, fold, seed, min(tile_id) AS keep FROM pred WHERE label = 5 GROUP BY ALL),
sub AS (SELECT p.* FROM pred p LEFT JOIN rare r ON p.model = r.model AND p.fold = r.fold AND p.seed = r.seed
 WHERE p.label <> 5 OR p.tile_id = r.keep),
rec AS (SELECT s.model, s.fold, s.seed, s.label, avg((s.label = s.pred)::INT) AS r,
 sum((s.label = 5 AND s.pred = 5)::INT) AS hit FROM sub s GROUP BY ALL),
m AS (SELECT model, fold, seed, sum(r) / 6 AS v, sum(hit) AS correct FROM rec GROUP BY ALL)
SELECT {CK}, {B('correct')}, {R('v', 'macro_recall')}, {R('v - correct / 6', 'if_incorrect')},
 {R('v + (1 - correct) / 6', 'if_correct')}, {R('1.0 / 6', 'leverage')} FROM m""")
def _(spark, sf):
    p = predictions(spark, sf)
    rare = p.where("label = 5").groupBy(*CELL).agg(F.min("tile_id").alias("keep"))
    sub = p.join(small_side(rare), CELL, "left").where((F.col("label") != 5) | (F.col("tile_id") == F.col("keep")))
    m = M.class_metrics(M.pair_counts(sub, CELL), CELL, K)
    return keyed(M.leverage(m, CELL, 5, K), CELL, ["correct"],
                 ["macro_recall", "if_incorrect", "if_correct", "leverage"])


@query("e26_run_summary", MACRO + f""" SELECT model, count(*) AS runs, {R('avg(recall)', 'macro_recall_mean')},
 {R('avg(f1)', 'macro_f1_mean')}, {R('coalesce(stddev_samp(recall), 0)', 'macro_recall_sd')},
 {R('coalesce(stddev_samp(f1), 0)', 'macro_f1_sd')} FROM mac GROUP BY model""")
def _(spark, sf):
    s = M.summarize_runs(macro_table(spark, sf), ["model"], ["macro_recall", "macro_f1"])
    return keyed(s, ["model"], ["runs"],
                 ["macro_recall_mean", "macro_f1_mean", "macro_recall_sd", "macro_f1_sd"])


@query("f03_reduce_metrics", MACRO + f""" SELECT model, metric, {R('median(value)', 'value')} FROM (
 SELECT model, fold, seed, unnest(['recall', 'f1']) AS metric, unnest([recall, f1]) AS value FROM mac)
 GROUP BY model, metric""")
def _(spark, sf):
    from tilescope.plans.evaluate import reduce_metrics
    m = macro_table(spark, sf).select(*CELL, F.expr(
        "stack(2, 'recall', macro_recall, 'f1', macro_f1) as (metric, value)"))
    return keyed(reduce_metrics(m, ["model"], F.median), ["model", "metric"], (), ["value"])
