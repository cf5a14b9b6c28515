"""Map-census, distance-join, raster and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.functions.scalars import as_bigint as bi
from tilescope.operators import census as C
from tilescope.operators import geo as G
from tilescope.operators import quality as Q
from tilescope.operators import rasters as X
from tilescope.operators import tiles as T
from tilescope.plans.fixtures import (CELLS, CENSUS, COORD, ELEM, MEMBERS, K, coordinates, features, fold_role, grids,
                                      members, sql_haversine, table, written_runs)
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed


def packed_grids(spark, sf):
    return grids(spark, sf).withColumn("mask", T.pack_bits(F.col("mask"), 64))


def counted(spark, sf):
    return C.census(packed_grids(spark, sf), 4, 4, K)


def with_modal(rows):
    base = rows.where("mode = 'baseline'").select("tile_id", C.modal_class("counts").alias("modal"))
    return rows.join(base, "tile_id")


@query("p32_cell_weights", f"WITH {CELLS} SELECT tile_id, (R * 4 + C)::BIGINT AS cell, wt::BIGINT AS weight FROM cells")
def _(spark, sf):
    g = grids(spark, sf).select("tile_id", F.posexplode(C.cell_weight(F.col("mask"), 4, 4)).alias("cell", "weight"))
    return keyed(g, ["tile_id", "cell", "weight"])


@query("a32_map_census", f"""WITH {CENSUS} SELECT c.tile_id, c.mode, cls AS class, {B('n')}, {B('unknown_n', 'unknown')}, {B('known_n', 'known')}
FROM tile_class c JOIN tile_unknown u ON c.tile_id = u.tile_id AND c.mode = u.mode""")
def _(spark, sf):
    r = counted(spark, sf).select("tile_id", "mode", F.posexplode("counts").alias("class", "n"), "unknown", "known")
    return keyed(r, ["tile_id", "mode", "class"], ["n", "unknown", "known"])


@query("a32_weight_histogram", f"""WITH {CELLS} SELECT e.vec_id AS tile_id, w.i AS weight, count(c.tile_id) AS cells FROM embeddings e CROSS JOIN range(5) w(i)
LEFT JOIN cells c ON c.tile_id = e.vec_id AND c.wt = w.i GROUP BY ALL""")
def _(spark, sf):
    return keyed(C.weight_histogram(packed_grids(spark, sf), 4, 4, K), ["tile_id", "weight"], ["cells"])


GROUPS = """, grp AS (SELECT vec_id AS tile_id, 'catalog' AS grp FROM embeddings UNION ALL
 SELECT vec_id, f || ':' || CASE WHEN vec_id % 5 = f THEN 'test' WHEN vec_id % 5 = (f + 1) % 5 THEN 'val' ELSE 'train' END FROM embeddings CROSS JOIN range(5) r(f)),
rows AS (SELECT g.grp, c.mode, c.tile_id, c.cls, c.n, m.modal FROM tile_class c JOIN grp g ON g.tile_id = c.tile_id JOIN tile_modal m ON m.tile_id = c.tile_id)"""


def grouped(spark, sf):
    f = features(spark, sf)
    names = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat_ws(":", i.cast("string"), fold_role(i)))
    roles = f.select(F.col("vec_id").alias("tile_id"), names.alias("groups"))
    return C.with_groups(with_modal(counted(spark, sf)), roles)


@query("a33_census_summary", f"""WITH {CENSUS}{GROUPS}, gu AS (SELECT grp, mode, count(*) AS images, sum(known_n) AS known_total, sum(unknown_n) AS unknown_total
 FROM tile_unknown u JOIN grp g ON g.tile_id = u.tile_id GROUP BY ALL)
SELECT r.grp, r.mode, cls AS class, any_value(images) AS images, {B('any_value(known_total)', 'known_total')}, {B('any_value(unknown_total)', 'unknown_total')},
 {B('sum(n)', 'cells')}, {B('sum((n > 0)::INT)', 'containing')}, {B('sum((modal = cls)::INT)', 'modal_images')}
FROM rows r JOIN gu ON gu.grp = r.grp AND gu.mode = r.mode GROUP BY r.grp, r.mode, cls""")
def _(spark, sf):
    return keyed(C.census_summary(grouped(spark, sf), ["grp"], K), ["grp", "mode", "class"],
                 ["images", "known_total", "unknown_total", "cells", "containing", "modal_images"])


@query("a33_modal_matrix", f"""WITH {CENSUS}{GROUPS} SELECT grp, mode, {B('modal')}, cls AS class, {B('sum(n)', 'cells')} FROM rows GROUP BY grp, mode, modal, cls""")
def _(spark, sf):
    return keyed(C.modal_matrix(grouped(spark, sf), ["grp"], K), ["grp", "mode", "modal", "class"], ["cells"])


@query("a34_presence_share", f"""WITH {CENSUS} SELECT c.mode, cls AS class, {B('sum((n > 0)::INT)', 'containing')}, {B('sum((modal = cls)::INT)', 'modal_images')},
 {B('sum(n)', 'cells')}, {B('sum(CASE WHEN modal <> cls THEN n ELSE 0 END)', 'cells_elsewhere')},
 {R('sum(CASE WHEN modal <> cls THEN n ELSE 0 END) / nullif(sum(n), 0)', 'share_elsewhere')}
FROM tile_class c JOIN tile_modal m ON c.tile_id = m.tile_id GROUP BY c.mode, cls""")
def _(spark, sf):
    p = C.presence_share(C.census_summary(with_modal(counted(spark, sf)), [], K), ["mode"])
    return keyed(p, ["mode", "class"], ["containing", "modal_images", "cells", "cells_elsewhere"], ["share_elsewhere"])


@query("q14_masked_counts", f"""WITH {CENSUS}, w AS (SELECT tile_id, cls, max(n) FILTER (WHERE mode = 'baseline') AS b, max(n) FILTER (WHERE mode = 'weighted') AS m FROM tile_class GROUP BY ALL),
k AS (SELECT tile_id, known_n + (tile_id % 11 = 0)::INT AS known FROM tile_unknown WHERE mode = 'baseline')
SELECT w.tile_id, bool_or(m > b) AS masked_above, sum(b) <> any_value(known) AS total_differs FROM w JOIN k ON k.tile_id = w.tile_id
GROUP BY w.tile_id HAVING bool_or(m > b) OR sum(b) <> any_value(known)""")
def _(spark, sf):
    # the weighted mode counts up to four per cell, so it breaks the rule on purpose
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("counts")))
    w = counted(spark, sf).groupBy("tile_id").agg(at("baseline").alias("b"), at("weighted").alias("m"),
                                                  F.max(F.when(F.col("mode") == "baseline", F.col("known"))).alias("known"))
    w = w.withColumn("known", F.col("known") + (F.col("tile_id") % 11 == 0).cast("int"))
    return Q.check_monotone(w, ["tile_id"], "b", "m", "known")


MAPROWS = f"""WITH {CENSUS}, {MEMBERS}, mr AS (SELECT p.tile_id, p.member, p.label, p.pred, u.mode, u.known_n AS known, u.unknown_n AS unknown, ct.n AS true_n, cp.n AS pred_n, c2.n AS two
 FROM member_pred p JOIN tile_unknown u ON u.tile_id = p.tile_id JOIN tile_class ct ON ct.tile_id = p.tile_id AND ct.mode = u.mode AND ct.cls = p.label
 JOIN tile_class cp ON cp.tile_id = p.tile_id AND cp.mode = u.mode AND cp.cls = p.pred JOIN tile_class c2 ON c2.tile_id = p.tile_id AND c2.mode = u.mode AND c2.cls = 2)"""


def mapped(spark, sf):
    return C.map_rows(members(spark, sf).drop("prob"), counted(spark, sf), 2)


@query("j05_map_rows", MAPROWS + f""" SELECT tile_id, {B('member')}, mode, {B('label')}, {B('pred')}, {B('known')}, {B('unknown')},
 {R('true_n / nullif(known, 0)', 'true_fraction')}, {R('pred_n / nullif(known, 0)', 'pred_fraction')}, (known > 0 AND two = known) AS single_class FROM mr""")
def _(spark, sf):
    m = mapped(spark, sf)
    return m.select("tile_id", bi("member").alias("member"), "mode", bi("label").alias("label"), bi("pred").alias("pred"),
                    bi("known").alias("known"), bi("unknown").alias("unknown"), S.round6("true_fraction").alias("true_fraction"),
                    S.round6("pred_fraction").alias("pred_fraction"), "single_class")


@query("a36_map_cohorts", MAPROWS + f""" SELECT {B('member')}, mode, count(*) AS images, {B('sum((label = pred)::INT)', 'correct')}, {B('sum((known = 0)::INT)', 'undefined')},
 {B('sum((label <> pred)::INT)', 'errors')}, {B('sum((label <> pred AND pred_n > 0)::INT)', 'errors_present')}, {B('sum((known > 0 AND two = known)::INT)', 'single_class')},
 {B('sum((known > 0 AND two = known AND label = pred)::INT)', 'single_class_correct')} FROM mr GROUP BY member, mode""")
def _(spark, sf):
    return keyed(C.map_cohort(mapped(spark, sf), ["member"]), ["member", "mode"],
                 ["images", "correct", "undefined", "errors", "errors_present", "single_class", "single_class_correct"])


SUBSET = MAPROWS + """, s AS (SELECT tile_id FROM tile_class c WHERE mode = 'all_four' AND cls = 2 AND n > 0 AND n = (SELECT known_n FROM tile_unknown u WHERE u.tile_id = c.tile_id AND u.mode = 'all_four'))"""


def single_class_tiles(spark, sf):
    rows = counted(spark, sf).withColumn("single_class", (F.col("known") > 0) & (F.col("counts")[2] == F.col("known")))
    return C.subset_from_map(rows, ["tile_id"], ["all_four"])


@query("j14_map_subset", SUBSET + " SELECT tile_id FROM s")
def _(spark, sf):
    return single_class_tiles(spark, sf)


@query("a37_subset_outcomes", SUBSET + f""", p AS (SELECT m.*, tile_id % 5 AS region, m.tile_id IN (SELECT tile_id FROM s) AS sub FROM member_pred m)
SELECT {B('member')}, {B('region')}, {B('sum((sub AND pred = 2)::INT)', 'subset_correct')}, {B('sum((label = 2 AND pred = 2)::INT)', 'tp')},
 {B('sum((label <> 2 AND pred = 2)::INT)', 'fp')}, {B('sum((pred = 2)::INT)', 'predicted')} FROM p GROUP BY GROUPING SETS ((member, region), (member))""")
def _(spark, sf):
    p = members(spark, sf).drop("prob").withColumn("region", F.pmod("tile_id", F.lit(5)))
    o = C.subset_outcomes(p, single_class_tiles(spark, sf), "member", "region", 2)
    return keyed(o, ["member", "region"], ["subset_correct", "tp", "fp", "predicted"])


# ---- distances -------------------------------------------------------------------------------------

D = sql_haversine("a.lat", "a.lon", "b.lat", "b.lon")


def fold0_sides(spark, sf):
    c = coordinates(spark, sf)
    test = F.pmod("tile_id", F.lit(5)) == 0
    return c.where(test), c.where(~test)


@query("j06_nearest_centre", f"""WITH {COORD} SELECT a.tile_id, round(min({D}) / 1000, 4) + 0.0 AS km FROM coord a JOIN coord b ON a.tile_id % 5 = 0 AND b.tile_id % 5 <> 0 GROUP BY a.tile_id""")
def _(spark, sf):
    n = G.nearest(*fold0_sides(spark, sf))
    return n.select("tile_id", (F.round(F.col("distance_m") / 1000, 4) + 0.0).alias("km"))


@query("j07_exposed_centres", f"""WITH {COORD} SELECT a.tile_id, bool_or({D} < 108639.61) AS exposed FROM coord a JOIN coord b ON a.tile_id % 5 = 0 AND b.tile_id % 5 <> 0 GROUP BY a.tile_id""")
def _(spark, sf):
    return G.within(*fold0_sides(spark, sf), 108639.61).select("tile_id", "exposed")


HOLD = "degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(6.0)) + cos(radians(lat)) * cos(radians(6.0)) * cos(radians(lon - 161.0)))))) <= 5"
BUFFERS = f"""WITH {COORD}, ar AS (SELECT *, CASE WHEN {HOLD} THEN -1 ELSE floor(lon / 72)::INT END AS area FROM coord),
nr AS (SELECT a.tile_id, list(DISTINCT b.area) AS near FROM ar a JOIN ar b ON {D} < 108639.61 GROUP BY a.tile_id),
o AS (SELECT ar.tile_id, ar.label, f AS fold, near, CASE WHEN area = -1 THEN 'holdout' WHEN area = f THEN 'test' WHEN area = (f + 1) % 5 THEN 'val' ELSE 'train' END AS original
 FROM ar JOIN nr ON nr.tile_id = ar.tile_id CROSS JOIN range(5) t(f)),
b AS (SELECT tile_id, label, fold, original, CASE WHEN original <> 'holdout' AND list_contains(near, -1) THEN 'holdout_buffer'
 WHEN original = 'val' AND list_contains(near, fold) THEN 'val_buffer'
 WHEN original = 'train' AND (list_contains(near, fold) OR list_contains(near, (fold + 1) % 5)) THEN 'train_buffer' END AS reason FROM o)"""


@query("u05_sector_folds", BUFFERS + " SELECT fold, coalesce(reason, original) AS status, count(*) AS n FROM b GROUP BY ALL")
def _(spark, sf):
    f = G.sector_folds(coordinates(spark, sf), 5, 108639.61)
    return f.groupBy(bi("fold").alias("fold"), F.coalesce("reason", "original").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("j08_buffer_exclusion", BUFFERS + " SELECT tile_id, original AS role, reason FROM b WHERE fold = 0")
def _(spark, sf):
    c = coordinates(spark, sf).withColumn("role", S.sector_role("lat", "lon", 5, 0))
    return G.apply_buffers(c, "role", 108639.61).select("tile_id", "role", "reason")


@query("u06_block_folds")
def _(spark, sf):
    c = coordinates(spark, sf).withColumn("block", S.spatial_block("lat", "lon", block_m=1_000_000.0))
    return keyed(G.block_folds(c, "block", "label", 5).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")), ["fold", "label"], ["n"])


# ---- rasters -----------------------------------------------------------------------------------------

RASTER = f"""WITH {ELEM}, {COORD}, n AS (SELECT count(*)::DOUBLE AS h FROM embeddings),
pt AS (SELECT tile_id, lon / 5.625 - 0.5 AS c0, (90 - lat) / (180 / h) - 0.5 AS r0, h FROM coord CROSS JOIN n),
sp AS (SELECT tile_id, CASE WHEN abs(c0 - round_even(c0, 0)) <= 1e-9 THEN round_even(c0, 0) ELSE c0 END AS c, CASE WHEN abs(r0 - round_even(r0, 0)) <= 1e-9 THEN round_even(r0, 0) ELSE r0 END AS r, h FROM pt),
ok AS (SELECT *, r - floor(r) AS dr, c - floor(c) AS dc FROM sp WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND 63),
nb AS (SELECT tile_id, floor(r)::BIGINT + i AS rr, floor(c)::BIGINT + j AS cc, CASE i WHEN 0 THEN 1 - dr ELSE dr END * CASE j WHEN 0 THEN 1 - dc ELSE dc END AS w FROM ok CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)),
hit AS (SELECT nb.tile_id, w, v FROM nb LEFT JOIN elem ON vec_id = rr AND elem.i = cc AND v > -0.2 WHERE w > 0)"""


def raster(spark, sf):
    shown = lambda band: F.transform(S.as_doubles("f"), lambda v: F.when(v > -0.2, v * 2 + 1 if band else v).otherwise(float("nan")))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), shown(b).alias("v")) for b in (0, 1)])
    return written_runs(spark, features(spark, sf).select(F.col("vec_id").alias("r"), F.lit(0).cast("bigint").alias("c0"), F.inline(bands)))


@query("j10_bilinear_samples", RASTER + f""" SELECT tile_id, b AS band, {R('CASE b WHEN 0 THEN sum(w * v) ELSE sum(w * (v * 2 + 1)) END', 'value')}
FROM hit CROSS JOIN range(2) t(b) GROUP BY tile_id, b HAVING count(v) = count(*)""")
def _(spark, sf):
    height = F.lit(float(table(spark, sf, "embeddings").count()))
    blocks = X.block_runs(raster(spark, sf), bands=2, side=16)
    s = X.sample_bilinear(coordinates(spark, sf), blocks, 0.0, 90.0, F.lit(5.625), F.lit(180.0) / height, F.lit(64), height, 2, side=16)
    return keyed(s, ["tile_id", "band"], (), ["value"])


ZONES = f"""WITH {ELEM}, {COORD}, lab AS (SELECT vec_id AS r, i AS c, floor(abs(v) * 1000)::BIGINT % 8 - 1 AS code FROM elem), n AS (SELECT count(*) AS h FROM embeddings),
w AS (SELECT tile_id, floor((90 - lat) * h / 180.0)::BIGINT AS rc, floor(lon * 64 / 360.0)::BIGINT AS cc, h FROM coord CROSS JOIN n),
cn AS (SELECT tile_id, code, count(*) AS n FROM w JOIN lab ON r >= greatest(0, rc - 3) AND r < least(h, rc + 3) AND c >= greatest(0, cc - 3) AND c < least(64, cc + 3) WHERE code BETWEEN 0 AND 5 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, code) AS rn, sum(n) OVER (PARTITION BY tile_id) AS t FROM cn)"""


@query("j11_zonal_mode", ZONES + """ SELECT w.tile_id, coalesce(code, -1) AS label, coalesce(round(n / t, 4), 0) + 0.0 AS confidence FROM w LEFT JOIN rk ON rk.tile_id = w.tile_id AND rn = 1""")
def _(spark, sf):
    height = table(spark, sf, "embeddings").count()
    codes = F.transform(S.as_doubles("f"), lambda v: (F.pmod(F.floor(F.abs(v) * 1000), F.lit(8)) - 1).cast("double"))
    labels = written_runs(spark, features(spark, sf).select(F.col("vec_id").alias("r"), F.lit(0).cast("bigint").alias("c0"), F.lit(0).alias("band"), codes.alias("v")))
    t = coordinates(spark, sf).withColumn("row", F.floor((90 - F.col("lat")) * height / 180.0)).withColumn("col", F.floor(F.col("lon") * 64 / 360.0))
    return keyed(X.zonal_mode(t, X.block_runs(labels, side=16), 3, K, height, 64, side=16), ["tile_id", "label"], (), ["confidence"])
