"""Ranking, selection and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6
from tilescope.operators import metrics as M
from tilescope.operators import ranking as X
from tilescope.operators.ordering import hash_sample
from tilescope.plans.fixtures import (HIST, MEMBERS, PRED, RANKED, histories, members, predictions,
                                      ranked_documents, table)
from tilescope.plans.metric_queries import MACRO, macro_table
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed

CURVE = f"""WITH {PRED}, g AS (SELECT model, fold, score AS threshold, count(*) AS size, sum((label = 5)::INT) AS hits
 FROM pred GROUP BY ALL),
curve AS (SELECT *, sum(size) OVER w AS retrieved, sum(hits) OVER w AS tp,
 sum(hits) OVER (PARTITION BY model, fold) AS positives, sum(size) OVER (PARTITION BY model, fold) AS n
 FROM g WINDOW w AS (PARTITION BY model, fold ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


def score_curve(spark, sf):
    return X.ranking_curve(predictions(spark, sf), ["model", "fold"], "score", F.col("label") == 5, "tile_id")


@query("r01_ranking_curve", CURVE + f""" SELECT model, fold::BIGINT AS fold, {R('threshold')}, {B('tp')},
 {B('retrieved - tp', 'fp')}, {R('tp / retrieved', 'precision')}, {R('tp / positives', 'recall')} FROM curve""")
def _(spark, sf):
    return keyed(score_curve(spark, sf), ["model", "fold"], ["tp", "fp"], ["threshold", "precision", "recall"])


DOC_CURVE = f"""WITH {RANKED}, g AS (SELECT lang, source, n_chars AS threshold, count(*) AS size, sum(quality) AS hits
 FROM ranked GROUP BY ALL),
curve AS (SELECT *, sum(size) OVER w AS retrieved, sum(hits) OVER w AS tp,
 sum(hits) OVER (PARTITION BY lang, source) AS positives, sum(size) OVER (PARTITION BY lang, source) AS n
 FROM g WINDOW w AS (PARTITION BY lang, source ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query("r02_average_precision", DOC_CURVE + f""" SELECT lang, source, {B('max(n)', 'n')}, {B('max(positives)', 'positives')},
 {R('max(positives) / max(n)', 'prevalence')},
 {R('sum(hits * tp / retrieved) / nullif(max(positives), 0)', 'ap')}, count(*) AS distinct_scores,
 {B('sum((size > 1)::INT)', 'tied_groups')}, {B('max(size)', 'largest_tie')} FROM curve GROUP BY lang, source""")
def _(spark, sf):
    keys = ["lang", "source"]
    c = X.ranking_curve(ranked_documents(spark, sf), keys, "n_chars", F.col("quality") == 1)
    return keyed(X.average_precision(c, keys), keys,
                 ["n", "positives", "distinct_scores", "tied_groups", "largest_tie"], ["prevalence", "ap"])


@query("r03_single_positive", f"""WITH {PRED}, s AS (SELECT l_suppkey AS grp, l_quantity AS score,
 (l_partkey % 500 = 7) AS pos, l_orderkey * 10 + l_linenumber AS item FROM lineitem),
t AS (SELECT grp, sum(pos::INT) AS k FROM s GROUP BY grp),
p AS (SELECT grp, score, max(item) FILTER (WHERE pos) AS item FROM s WHERE pos GROUP BY ALL)
SELECT p.grp, {B('p.item', 'hit_item')}, {B('sum((s.score > p.score)::INT) + 1', 'rank_first')},
 {B('sum((s.score >= p.score)::INT)', 'rank_last')}, {B('sum((s.score = p.score)::INT)', 'tie_size')}
FROM p JOIN t ON t.grp = p.grp AND t.k = 1 JOIN s ON s.grp = p.grp GROUP BY p.grp, p.item""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("score"),
        (F.pmod("l_partkey", F.lit(500)) == 7).alias("pos"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    c = X.ranking_curve(li, ["grp"], "score", F.col("pos"), "item")
    return keyed(X.single_positive(c, ["grp"]), ["grp"], ["hit_item", "rank_first", "rank_last", "tie_size"])


# scores are rounded so that both engines see the same ties
OVR = f"""WITH {MEMBERS}, s AS (SELECT member, cls, round(p, 9) AS score, (label = cls)::INT AS y FROM prob),
g AS (SELECT member, cls, score, count(*) AS size, sum(y) AS hits FROM s GROUP BY ALL),
curve AS (SELECT *, sum(size) OVER w AS retrieved, sum(hits) OVER w AS tp,
 sum(hits) OVER (PARTITION BY member, cls) AS positives, sum(size) OVER (PARTITION BY member, cls) AS n
 FROM g WINDOW w AS (PARTITION BY member, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT member, cls, max(n) AS n, max(positives) AS positives,
 sum(hits * tp / retrieved) / nullif(max(positives), 0) AS ap FROM curve GROUP BY member, cls)"""


def ovr(spark, sf):
    m = members(spark, sf).withColumn("prob", F.transform("prob", lambda p: F.round(p, 9)))
    return X.ovr_average_precision(m, ["member"])


@query("r04_one_vs_rest_ap", OVR + f""" SELECT member AS member, cls AS class, {B('n')}, {B('positives')}, {R('ap')} FROM ap""")
def _(spark, sf):
    return keyed(ovr(spark, sf), ["member", "class"], ["n", "positives"], ["ap"])


# the five members are two arms, of two and of three seeds; regions are thirds of the tiles
ARMS = f"""WITH {MEMBERS}, s AS (SELECT tile_id % 3 AS fold, least(member // 2, 1) AS arm, member - 2 * least(member // 2, 1) AS seed, cls, round(p, 9) AS score, (label = cls)::INT AS y
 FROM prob),
g AS (SELECT fold, arm, seed, cls, score, count(*) AS size, sum(y) AS hits FROM s GROUP BY ALL),
curve AS (SELECT *, sum(size) OVER w AS retrieved, sum(hits) OVER w AS tp, sum(hits) OVER (PARTITION BY fold, arm, seed, cls) AS positives
 FROM g WINDOW w AS (PARTITION BY fold, arm, seed, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
one AS (SELECT fold, arm, seed, cls, sum(hits * tp / retrieved) / nullif(max(positives), 0) AS ap FROM curve GROUP BY ALL),
ap AS (SELECT * FROM one UNION ALL SELECT fold, arm, seed, -1, CASE WHEN count(ap) = count(*) THEN avg(ap) END FROM one GROUP BY ALL)"""


def arms(spark, sf):
    m = members(spark, sf).withColumn("prob", F.transform("prob", lambda p: F.round(p, 9)))
    arm = F.least(F.floor(F.col("member") / 2), F.lit(1)).cast("bigint")
    m = m.withColumn("fold", F.pmod("tile_id", F.lit(3))).withColumn("arm", arm).withColumn("seed", F.col("member") - 2 * F.col("arm"))
    return X.ovr_average_precision(m, ["fold", "arm", "seed"])


@query("r05_ap_summary", ARMS + f""", f AS (SELECT arm, cls, fold, CASE WHEN count(ap) = count(*) THEN avg(ap) END AS v FROM ap GROUP BY ALL)
SELECT {B('arm')}, {B('cls', 'class')}, {B('fold')}, {R('v', 'mean')}, CAST(NULL AS DOUBLE) AS sd FROM f
UNION ALL SELECT arm, cls, NULL, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) + 0.0, round(CASE WHEN count(v) = count(*) THEN stddev_samp(v) END, 6) + 0.0
FROM f GROUP BY arm, cls""")
def _(spark, sf):
    return keyed(X.ap_summary(arms(spark, sf), ["arm"]), ["arm", "class", "fold"], (), ["mean", "sd"])


@query("r05_ap_contrasts", ARMS + f""", d AS (SELECT a.cls, a.fold, count(*) AS pairs, CASE WHEN count(a.ap - b.ap) = count(*) THEN avg(a.ap - b.ap) END AS paired
 FROM ap a JOIN ap b ON a.arm = 1 AND b.arm = 0 AND a.fold = b.fold AND a.seed = b.seed AND a.cls = b.cls GROUP BY ALL),
u AS (SELECT cls, fold, arm, CASE WHEN count(ap) = count(*) THEN avg(ap) END AS v FROM ap GROUP BY ALL)
SELECT d.cls::BIGINT AS class, d.fold::BIGINT AS fold, pairs, {R('paired')}, {R('x.v - y.v', 'unpaired')}
FROM d JOIN u x ON x.arm = 1 AND d.cls = x.cls AND d.fold = x.fold JOIN u y ON y.arm = 0 AND d.cls = y.cls AND d.fold = y.fold""")
def _(spark, sf):
    return keyed(X.ap_contrasts(arms(spark, sf), "arm", 1, 0), ["class", "fold"], ["pairs"], ["paired", "unpaired"])


@query("r06_retrieval_curve", DOC_CURVE + f""" SELECT lang, source, {B('retrieved')}, {B('tp')},
 {R('tp / positives', 'recall')} FROM curve WHERE hits > 0""")
def _(spark, sf):
    keys = ["lang", "source"]
    c = X.ranking_curve(ranked_documents(spark, sf), keys, "n_chars", F.col("quality") == 1)
    return keyed(X.retrieval_curve(c, keys), keys, ["retrieved", "tp"], ["recall"])


@query("r07_earliest_best_epoch", f"""WITH {HIST}, r AS (SELECT cell, epoch, score,
 row_number() OVER (PARTITION BY cell ORDER BY score DESC, epoch) AS rn FROM hist WHERE steps > 0)
SELECT cell, epoch, {B('score')} FROM r WHERE rn = 1""")
def _(spark, sf):
    return keyed(X.select_epoch(histories(spark, sf), ["cell"]), ["cell"], ["epoch", "score"])


@query("r08_rate_choice", f"""WITH c AS (SELECT o_custkey % 50 AS fold, o_orderpriority AS arm,
 o_orderkey % 7 * 0.001 + 0.001 AS rate, max(o_totalprice) AS score FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, arm ORDER BY score DESC, rate) AS rn,
 count(*) OVER (PARTITION BY fold, arm) AS candidates FROM c)
SELECT fold, arm, {R('rate::DOUBLE', 'rate')}, {R('score')}, candidates FROM r WHERE rn = 1""")
def _(spark, sf):
    cells = table(spark, sf, "orders").groupBy(
        F.pmod("o_custkey", F.lit(50)).alias("fold"), F.col("o_orderpriority").alias("arm"),
        (F.pmod("o_orderkey", F.lit(7)) * F.lit(0.001) + F.lit(0.001)).alias("rate")).agg(
        F.max("o_totalprice").alias("score"))
    return keyed(X.select_rate(cells, ["fold", "arm"], "rate", "score"), ["fold", "arm"], ["candidates"],
                 ["rate", "score"])


@query("r10_median_pick", f"""WITH m AS (SELECT lang, source, median(n_chars) AS med, count(*) AS candidates
 FROM documents GROUP BY ALL),
r AS (SELECT d.lang, d.source, d.doc_id, m.med, m.candidates, row_number() OVER (PARTITION BY d.lang, d.source
 ORDER BY abs(d.n_chars - m.med), d.doc_id) AS rn FROM documents d JOIN m ON d.lang = m.lang AND d.source = m.source)
SELECT lang, source, doc_id, {R('med', 'median')}, candidates FROM r WHERE rn = 1""")
def _(spark, sf):
    keys = ["lang", "source"]
    p = X.median_pick(table(spark, sf, "documents").select(*keys, "doc_id", "n_chars"), keys, "n_chars", "doc_id")
    return keyed(p, keys, ["doc_id", "candidates"], ["median"])


@query("r11_quantile_picks", f"""WITH m AS (SELECT model, unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS q, unnest(marks) AS mark
 FROM (SELECT l_returnflag AS model, quantile_cont(l_extendedprice, [0.1, 0.3, 0.5, 0.7, 0.9]) AS marks
       FROM lineitem GROUP BY 1)),
r AS (SELECT m.model, m.q, l.l_orderkey * 10 + l.l_linenumber AS item, m.mark, row_number() OVER (
 PARTITION BY m.model, m.q ORDER BY abs(l_extendedprice - mark), l.l_orderkey * 10 + l.l_linenumber) AS rn
 FROM m JOIN lineitem l ON l.l_returnflag = m.model)
SELECT model, {R('q::DOUBLE', 'q')}, item, {R('mark')} FROM r WHERE rn = 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        F.col("l_extendedprice").alias("price"))
    p = X.quantile_picks(li, ["model"], "price", "item", [0.1, 0.3, 0.5, 0.7, 0.9])
    return keyed(p, ["model"], ["item"], ["q", "mark"])


@query("r12_hash_sample", f"""WITH {PRED}, r AS (SELECT model, fold, tile_id, row_number() OVER (
 PARTITION BY model, fold ORDER BY md5(concat_ws(':', '11', tile_id)), tile_id) AS rn FROM pred)
SELECT model, fold::BIGINT AS fold, tile_id FROM r WHERE rn <= 20""")
def _(spark, sf):
    s = hash_sample(predictions(spark, sf).select("model", "fold", "tile_id"), 20, 11, ["tile_id"], ["model", "fold"])
    return keyed(s, ["model", "fold", "tile_id"])


SUBSET = """WITH c AS (SELECT l_orderkey % 6 AS label, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT label, n, 5000.0::DOUBLE * n / sum(n) OVER () AS s FROM c),
q AS (SELECT label, floor(s)::BIGINT + (row_number() OVER (ORDER BY s - floor(s) DESC, label)
  <= 5000 - sum(floor(s)) OVER ())::INT AS quota FROM s),"""


@query("r13_stratified_subset", SUBSET + f"""
r AS (SELECT l_orderkey % 6 AS label, l_orderkey AS item, l_linenumber AS line, l_partkey AS part, row_number() OVER (
 PARTITION BY l_orderkey % 6 ORDER BY md5(concat_ws(':', '5', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
 l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT r.label, count(*) AS n, {B('sum(item)', 'item_sum')}, {B('sum(part)', 'part_sum')}
FROM r JOIN q ON q.label = r.label AND r.rn <= q.quota GROUP BY r.label""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             F.pmod("l_orderkey", F.lit(6)).alias("label"))
    s = X.subsample_train(li, 5000, 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "label")
    return keyed(s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("item_sum"),
                                        F.sum("l_partkey").alias("part_sum")), ["label"],
                 ["n", "item_sum", "part_sum"])


@query("r14_column_winners", MACRO + f""", s AS (SELECT model, fold, avg(f1) * 100 AS f1, avg(recall) * 100 AS recall
 FROM mac GROUP BY model, fold),
l AS (SELECT model, fold, unnest(['f1', 'recall']) AS metric, unnest([f1, recall]) AS value FROM s),
w AS (SELECT *, round_even(value, 2) AS shown FROM l)
SELECT model, fold::BIGINT AS fold, metric, {R('shown')}, shown = max(shown) OVER (PARTITION BY fold || metric) AS winner FROM w""")
def _(spark, sf):
    s = macro_table(spark, sf).groupBy("model", "fold").agg(
        (F.avg("macro_f1") * 100).alias("f1"), (F.avg("macro_recall") * 100).alias("recall"))
    long = s.select("model", "fold", F.expr("stack(2, 'f1', f1, 'recall', recall) as (metric, value)")).withColumn(
        "col", F.concat(F.col("fold").cast("string"), "metric"))
    w = X.column_winners(long, "col", "value")
    return w.select("model", bi("fold").alias("fold"), "metric", round6("shown").alias("shown"), "winner")
