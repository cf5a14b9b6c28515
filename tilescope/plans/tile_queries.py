"""Scalar, tile and pixel-distribution queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6
from tilescope.operators import pixels as N
from tilescope.operators import rasters
from tilescope.operators import textures as X
from tilescope.operators import tiles as T
from tilescope.operators.embedding import vector_stats
from tilescope.plans.fixtures import COORD, ELEM, PIX, coordinates, features, grids, table, tiles, written_runs
from tilescope.plans.registry import query
from tilescope.plans.shape import R, keyed


@query("p01_to_db", f"SELECT event_id, {R('10 * log10(greatest(value, 1e-4))', 'db')} FROM events")
def _(spark, sf):
    return keyed(table(spark, sf, "events").withColumn("db", S.to_db("value")), ["event_id"], (), ["db"])


@query("p02_from_db", f"SELECT event_id, {R('pow(10, (value - 50) / 100)', 'linear')} FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("linear", S.from_db((F.col("value") - 50) / 10))
    return keyed(e, ["event_id"], (), ["linear"])


HOLES = "CASE WHEN user_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN user_id % 7 = 1 THEN '-Infinity'::DOUBLE WHEN user_id % 7 = 2 THEN 'Infinity'::DOUBLE ELSE value END"


def holes():
    m = F.pmod("user_id", F.lit(7))
    return (F.when(m == 0, float("nan")).when(m == 1, float("-inf")).when(m == 2, float("inf")).otherwise(F.col("value")))


@query("p03_fill_nonfinite", f"WITH e AS (SELECT event_id, {HOLES} AS v FROM events) SELECT event_id, {R('CASE WHEN isfinite(v) THEN v ELSE 0 END', 'v')} FROM e")
def _(spark, sf):
    return keyed(table(spark, sf, "events").withColumn("v", S.fill_nonfinite(holes())), ["event_id"], (), ["v"])


@query("p04_scale_clip", f"SELECT event_id, {R('least(greatest((value - 10) / (90.0 - 10 + 1e-8), 0), 1)', 'v')} FROM events")
def _(spark, sf):
    return keyed(table(spark, sf, "events").withColumn("v", S.scale_clip("value", 10.0, 90.0)), ["event_id"], (), ["v"])


@query("p08_quantize", f"""WITH b AS (SELECT max(value) AS m FROM events)
SELECT event_id, {R('round_even(value / m * 15, 0) / 15', 'level')} FROM events CROSS JOIN b""")
def _(spark, sf):
    e = table(spark, sf, "events")
    top = e.agg(F.max("value")).scalar()
    return keyed(e.withColumn("level", S.quantize(F.col("value") / top, 16)), ["event_id"], (), ["level"])


STATS = f"""WITH {PIX}, st AS (SELECT tile_id, any_value(label) AS label, round(sum((v > 0)::INT) / 64.0::DOUBLE, 4) AS valid_fraction,
 round(coalesce(avg(v) FILTER (WHERE v > 0), 0), 4) AS mean_dn, round(coalesce(stddev_pop(v) FILTER (WHERE v > 0), 0), 4) AS std_dn FROM pix GROUP BY tile_id)"""


@query("p05_tile_statistics", STATS + " SELECT tile_id, valid_fraction, mean_dn AS mean_display_dn, std_dn AS std_display_dn FROM st")
def _(spark, sf):
    return T.tile_stats(tiles(spark, sf)).select("tile_id", "valid_fraction", "mean_display_dn", "std_display_dn")


@query("p06_quality_filter", STATS + """ SELECT CASE WHEN valid_fraction < 0.5 THEN 'low_valid_fraction'
 WHEN NOT tile_id * 7 % 70 BETWEEN 10 AND 50 THEN 'bad_incidence_angle' ELSE 'kept' END AS reason, count(*) AS n FROM st GROUP BY 1""")
def _(spark, sf):
    st = T.tile_stats(tiles(spark, sf)).withColumn("angle", F.pmod(F.col("tile_id") * 7, F.lit(70)).cast("double"))
    return T.quality_filter(st, "valid_fraction", "angle", 0.5, 10.0, 50.0)[1]


STRETCH = f"""WITH {PIX}, qs AS (SELECT tile_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pix GROUP BY tile_id),
st AS (SELECT p.tile_id, r, c, least(greatest((v - lo) / greatest(hi - lo, 1e-8), 0), 1) AS u FROM pix p JOIN qs ON p.tile_id = qs.tile_id)"""


@query("p09_stretch_uint8", STRETCH + " SELECT tile_id, (r * 8 + c)::BIGINT AS pos, round_even(u * 255, 0)::BIGINT AS v FROM st")
def _(spark, sf):
    t = tiles(spark, sf).select("tile_id", F.posexplode(T.stretch_uint8(F.col("px"))).alias("pos", "v"))
    return keyed(t, ["tile_id", "pos", "v"])


@query("p10_stretch_display", f"""WITH {PIX}, qs AS (SELECT tile_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pix WHERE v > 0 GROUP BY tile_id)
SELECT p.tile_id, count(*) FILTER (WHERE v > 0) AS valid, {R('sum(least(greatest((v - lo) / (hi - lo), 0), 1)) FILTER (WHERE v > 0)', 'total')}
FROM pix p JOIN qs ON p.tile_id = qs.tile_id GROUP BY p.tile_id""")
def _(spark, sf):
    t = tiles(spark, sf).withColumn("d", F.filter(T.stretch_display("px"), lambda v: v.isNotNull()))
    return keyed(t.withColumn("valid", F.size("d")).withColumn("total", T.array_sum("d")), ["tile_id"], ["valid"], ["total"])


@query("p11_wrap_longitude", f"""WITH {COORD} SELECT tile_id, {R('((lon * 3 - 500) % 360 + 360) % 360', 'lon')} FROM coord""")
def _(spark, sf):
    return keyed(coordinates(spark, sf).withColumn("lon", S.wrap_lon(F.col("lon") * 3 - 500)), ["tile_id"], (), ["lon"])


@query("p11_recenter_raster", f"""WITH {ELEM} SELECT vec_id AS r, (i + 32) % 64 AS c, {R('v')} FROM elem""")
def _(spark, sf):
    cells = features(spark, sf).select(F.col("vec_id").alias("r"), F.posexplode("f").alias("c", "v"))
    return keyed(T.recenter_raster(cells, 64), ["r", "c"], (), ["v"])


@query("p12_great_circle", f"""WITH {COORD} SELECT tile_id, {R('2574700.0 * acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(6.0)) + cos(radians(lat)) * cos(radians(6.0)) * cos(radians(lon - 161.0))))) / 1000', 'km')} FROM coord""".replace(', 6) + 0.0 AS km', ', 3) + 0.0 AS km'))
def _(spark, sf):
    c = coordinates(spark, sf).withColumn("km", S.haversine("lat", "lon", F.lit(6.0), F.lit(161.0)) / 1000)
    return c.select("tile_id", (F.round("km", 3) + 0.0).alias("km"))


@query("p13_degree_resolution", f"""WITH {COORD} SELECT tile_id, {R('100 / CASE WHEN 111320.0 * cos(radians(lat)) < 1000 THEN 111320.0 ELSE 111320.0 * cos(radians(lat)) END', 'lon_deg')},
 {R('100 / 111320.0', 'lat_deg')} FROM coord""")
def _(spark, sf):
    lon, lat = S.deg_resolution("lat", 100.0)
    return keyed(coordinates(spark, sf).select("tile_id", lon.alias("lon_deg"), lat.alias("lat_deg")), ["tile_id"], (), ["lon_deg", "lat_deg"])


HOLD = "degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(6.0)) + cos(radians(lat)) * cos(radians(6.0)) * cos(radians(lon - 161.0)))))) <= 5"


@query("p14_sector_role", f"""WITH {COORD} SELECT tile_id, f AS fold, CASE WHEN {HOLD} THEN 'holdout' WHEN floor(lon / 72) = f THEN 'test'
 WHEN floor(lon / 72) = (f + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM coord CROSS JOIN range(5) t(f)""")
def _(spark, sf):
    c = coordinates(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return c.select("tile_id", bi("fold").alias("fold"), S.sector_role("lat", "lon", 5, "fold").alias("role"))


@query("p15_hemispheric_role", f"""WITH {COORD} SELECT tile_id, CASE WHEN {HOLD} THEN 'holdout' WHEN lon >= 180 THEN 'train' WHEN abs(lat) <= 30 THEN 'val' ELSE 'test' END AS role FROM coord""")
def _(spark, sf):
    return coordinates(spark, sf).select("tile_id", S.assign_split("lat", "lon").alias("role"))


@query("p16_spatial_block", f"""WITH {COORD}, b AS (SELECT tile_id, lon, floor((radians(lat) + pi() / 2) * 2574700.0 / 250000) AS band FROM coord),
c AS (SELECT *, greatest(1, round_even(2 * pi() * 2574700.0 * greatest(cos(-pi() / 2 + (band + 0.5) * 250000 / 2574700.0), 1e-6) / 250000, 0)) AS nb FROM b)
SELECT tile_id, concat_ws(':', band::BIGINT, nb::BIGINT, floor(lon / 360 * nb)::BIGINT) AS block FROM c""")
def _(spark, sf):
    return coordinates(spark, sf).select("tile_id", S.spatial_block("lat", "lon").alias("block"))


@query("p17_tile_grid", f"""WITH d AS (SELECT count(*) AS h FROM embeddings), t AS (SELECT i AS tile_id, i // 8 * 8 AS r, i % 8 * 8 AS c FROM d, range(h // 8 * 8) g(i))
SELECT tile_id, r AS row, c AS col, round(90.0 - (r + 4.0) / 10.0, 4)::DOUBLE AS center_lat, round((c + 4.0) / 10.0, 4)::DOUBLE AS center_lon FROM t""")
def _(spark, sf):
    height = table(spark, sf, "embeddings").count()
    g = T.tile_grid(spark, height, 64, 8, 10.0)
    return g.select("tile_id", bi("row").alias("row"), bi("col").alias("col"), "center_lat", "center_lon")


@query("p17_metric_centres", f"""WITH s AS (SELECT degrees(stride / 2574700.0) AS st, ring FROM (SELECT vec_id AS ring, 40000.0::DOUBLE AS stride FROM embeddings)),
l AS (SELECT ring, -90 + st / 2 + ring * st AS lat, least(360, st / greatest(cos(radians(-90 + st / 2 + ring * st)), 1e-6)) AS step FROM s WHERE -90 + st / 2 + ring * st < 90)
SELECT ring, {R('lat')}, ceil((360 - step / 2) / step)::BIGINT AS n, {R('step / 2 + (ceil((360 - step / 2) / step) - 1) * step', 'last_lon')} FROM l""")
def _(spark, sf):
    rings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ring"))
    m = T.metric_centres(rings, 40000.0)
    return keyed(m.groupBy("ring").agg(F.first("lat").alias("lat"), F.count(F.lit(1)).alias("n"), F.max("lon").alias("last_lon")),
                 ["ring"], ["n"], ["lat", "last_lon"])


CUT = f"""WITH {ELEM}, h AS (SELECT count(*) // 8 * 8 AS h FROM embeddings),
t AS (SELECT vec_id // 8 AS tr, i // 8 AS tc, count(*) AS n, sum((v > 0)::INT) / 64.0::DOUBLE AS valid_fraction, sum(v * (vec_id % 8 * 8 + i % 8)) AS ramp
 FROM elem CROSS JOIN h WHERE vec_id < h GROUP BY ALL)"""


def cut_tiles(spark, sf, min_valid=None):
    runs = features(spark, sf).select(F.lit(0).alias("band"), F.col("vec_id").alias("r"), F.lit(0).cast("bigint").alias("c0"), S.as_doubles("f").alias("v"))
    height = F.lit(table(spark, sf, "embeddings").count())
    return rasters.cut_tiles(rasters.block_runs(written_runs(spark, runs), side=16), 8, height, F.lit(64), min_valid, side=16)


def with_ramp(t):
    return t.withColumn("n", F.size("px")).withColumn("ramp", F.aggregate(F.transform("px", lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x))


@query("p18_cut_raster", CUT + f" SELECT tr, tc, n, {R('valid_fraction')}, {R('ramp')} FROM t")
def _(spark, sf):
    return keyed(with_ramp(cut_tiles(spark, sf)), ["tr", "tc"], ["n"], ["valid_fraction", "ramp"])


@query("p18_cut_valid_raster", CUT + f" SELECT tr, tc, n, {R('valid_fraction')}, {R('ramp')} FROM t WHERE valid_fraction >= 0.5")
def _(spark, sf):
    return keyed(with_ramp(cut_tiles(spark, sf, 0.5)), ["tr", "tc"], ["n"], ["valid_fraction", "ramp"])


@query("p19_site_labels", """SELECT s_suppkey, n_name AS site, n_regionkey::BIGINT AS class, r_name AS continent FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    sites = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("site"), bi("n_regionkey").alias("class"), F.col("r_name").alias("continent"))
    return T.label_by_site(table(spark, sf, "supplier"), sites, "s_nationkey").select("s_suppkey", "site", "class", "continent")


COEF = [[((c * 31 + d * 17) % 13 - 6) / 10.0 for d in range(64)] for c in range(6)]
LOGITS = f"""WITH {ELEM}, z AS (SELECT vec_id, k AS cls, sum(v * (((k * 31 + i * 17) % 13 - 6) / 10.0)) + k / 10.0 AS z FROM elem CROSS JOIN range(6) t(k) GROUP BY vec_id, k),
sm AS (SELECT vec_id, cls, z, exp(z) / sum(exp(z)) OVER w AS p, max(z) OVER w AS top FROM z WINDOW w AS (PARTITION BY vec_id))"""


def scored(spark, sf):
    w = F.array(*[F.array(*[F.lit(v) for v in row]) for row in COEF])
    b = F.array(*[F.lit(c / 10.0) for c in range(6)])
    return features(spark, sf).withColumn("logits", S.linear_logits("f", w, b)).withColumn(
        "prob", S.softmax("logits")).withColumn("pred", S.argmax("logits"))


@query("p22_linear_scores", LOGITS + f""" SELECT vec_id, cls AS class, {R('z', 'logit')}, {R('p')}, z = top AS chosen FROM sm""")
def _(spark, sf):
    s = scored(spark, sf).select("vec_id", "pred", F.posexplode(F.arrays_zip("logits", "prob")).alias("class", "s"))
    return s.select("vec_id", bi("class").alias("class"), round6("s.logits").alias("logit"), round6("s.prob").alias("p"), (F.col("class") == F.col("pred")).alias("chosen"))


@query("p23_unit_vectors", f"""WITH {ELEM} SELECT vec_id, i AS dim, {R('v / (sqrt(sum(v * v) OVER (PARTITION BY vec_id)) + 1e-8)', 'u')} FROM elem""")
def _(spark, sf):
    f = features(spark, sf).select("vec_id", F.posexplode(S.l2norm("f")).alias("dim", "u"))
    return keyed(f, ["vec_id", "dim"], (), ["u"])


# ---- texture features -------------------------------------------------------------------------

@query("p24_intensity_features", f"""WITH {PIX}, m AS (SELECT tile_id, avg(v) AS mu, stddev_pop(v) AS sd FROM pix GROUP BY tile_id),
a AS (SELECT p.tile_id, any_value(mu) AS mu, any_value(sd) AS sd, avg(pow(v - mu, 3)) / any_value(pow(sd, 3)) AS skew, avg(pow(v - mu, 4)) / any_value(pow(sd, 4)) - 3 AS kurt,
 min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.99) AS q99 FROM pix p JOIN m ON p.tile_id = m.tile_id GROUP BY p.tile_id)
SELECT tile_id, {R('mu', 'mean')}, {R('sd')}, {R('skew')}, {R('kurt')}, {R('lo')}, {R('hi')}, {R('q05')}, {R('q50')}, {R('q99')} FROM a""")
def _(spark, sf):
    names = ["mean", "sd", "skew", "kurt", "lo", "hi", "q01", "q05", "q25", "q50", "q75", "q95", "q99"]
    t = tiles(spark, sf).withColumn("x", X.tile_features("px", 8, 8, "intensity"))
    keep = ["mean", "sd", "skew", "kurt", "lo", "hi", "q05", "q50", "q99"]
    return keyed(t.select("tile_id", *[F.col("x")[names.index(c)].alias(c) for c in keep]), ["tile_id"], (), keep)


@query("p25_histogram_features", STRETCH + f""", b AS (SELECT tile_id, least(floor(u * 32), 31)::BIGINT AS bin, count(*) / 2.0::DOUBLE AS density FROM st GROUP BY ALL)
SELECT tile_id, bin, {R('density')} FROM b""")
def _(spark, sf):
    t = tiles(spark, sf).select("tile_id", F.posexplode(X.tile_features("px", 8, 8, "histogram")).alias("bin", "density"))
    return keyed(t.where("density > 0"), ["tile_id", "bin"], (), ["density"])


@query("p26_cooccurrence_features", STRETCH + f""", q AS (SELECT tile_id, r, c, round_even(u * 255, 0)::INT // 16 AS g FROM st),
o AS (SELECT o, dr, dc FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 0, 4), (3, 4, 0)) v(o, dr, dc)),
pr AS (SELECT a.tile_id, o, a.g AS i, b.g AS j FROM q a CROSS JOIN o JOIN q b ON a.tile_id = b.tile_id AND b.r = a.r + dr AND b.c = a.c + dc),
sy AS (SELECT tile_id, o, i, j FROM pr UNION ALL SELECT tile_id, o, j, i FROM pr),
pm AS (SELECT tile_id, o, i, j, count(*) / sum(count(*)) OVER (PARTITION BY tile_id, o) AS p FROM sy GROUP BY tile_id, o, i, j),
mu AS (SELECT tile_id, o, sum(p * i) AS mu FROM pm GROUP BY ALL),
f AS (SELECT pm.tile_id, pm.o, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity,
 sqrt(sum(p * p)) AS energy, sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) * (i - mu)) AS correlation FROM pm JOIN mu ON pm.tile_id = mu.tile_id AND pm.o = mu.o GROUP BY ALL)
SELECT tile_id, o::BIGINT AS offset_id, {R('contrast')}, {R('dissimilarity')}, {R('homogeneity')}, {R('energy')}, {R('correlation')} FROM f""")
def _(spark, sf):
    names = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]
    t = tiles(spark, sf).withColumn("x", X.tile_features("px", 8, 8, "glcm")).withColumn("offset_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return keyed(t.select("tile_id", "offset_id", *[F.element_at("x", F.col("offset_id") + 4 * k + 1).alias(n) for k, n in enumerate(names)]),
                 ["tile_id", "offset_id"], (), names)


def feature_summary(spark, sf, kind):
    t = tiles(spark, sf).select(X.tile_features("px", 8, 8, kind).alias("f"))
    s = vector_stats(t, []).select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "s"))
    sd = F.sqrt(F.col("s.var") * (F.col("n") - 1) / F.col("n"))
    return keyed(s.select("dim", "n", F.col("s.mean").alias("mean"), sd.alias("sd")), ["dim"], ["n"], ["mean", "sd"])


def _corners() -> str:
    """(k, dr, dc, w): the pixels around each of eight places at radius 1 and their bilinear weights."""
    rows = []
    for k in range(8):
        r, c = -round(math.sin(math.pi * k / 4), 5), round(math.cos(math.pi * k / 4), 5)
        r0, c0 = math.floor(r), math.floor(c)
        for dr, wr in ((0, 1 - (r - r0)), (1, r - r0)):
            for dc, wc in ((0, 1 - (c - c0)), (1, c - c0)):
                if wr * wc > 0:
                    rows.append(f"({k}, {r0 + dr}, {c0 + dc}, {wr * wc!r}::DOUBLE)")
    return ", ".join(rows)


@query("p27_local_binary_patterns", STRETCH + f""", q AS (SELECT tile_id, r, c, (round_even(u * 255, 0)::INT // 16)::DOUBLE AS g FROM st),
k(k, dr, dc, w) AS (VALUES {_corners()}),
b AS (SELECT q.tile_id, q.r, q.c, k.k, sum(k.w * coalesce(n.g, 0)) - any_value(q.g) >= -1e-9 AS bit FROM q CROSS JOIN k
 LEFT JOIN q n ON n.tile_id = q.tile_id AND n.r = q.r + k.dr AND n.c = q.c + k.dc GROUP BY q.tile_id, q.r, q.c, k.k),
p AS (SELECT x.tile_id, x.r, x.c, sum(x.bit::INT) AS ones, sum((x.bit <> y.bit)::INT) AS changes FROM b x
 JOIN b y ON x.tile_id = y.tile_id AND x.r = y.r AND x.c = y.c AND y.k = (x.k + 7) % 8 GROUP BY ALL),
h AS (SELECT tile_id, dim, sum((CASE WHEN changes <= 2 THEN ones ELSE 9 END = dim)::INT) / 64.0::DOUBLE AS v FROM p CROSS JOIN range(10) d(dim) GROUP BY ALL)
SELECT dim, count(*) AS n, {R('avg(v)', 'mean')}, {R('stddev_pop(v)', 'sd')} FROM h GROUP BY dim""")
def _(spark, sf):
    return feature_summary(spark, sf, "lbp")


@query("p28_gradient_textures")
def _(spark, sf):
    return feature_summary(spark, sf, "texture")


@query("p29_classical_features")
def _(spark, sf):
    return feature_summary(spark, sf, "classical")


@query("p30_roughness_threshold", f"""WITH {COORD} SELECT tile_id, {R('2.176 / (8 * cos(radians(abs(lat) * 0.8))) * 10', 'ku_mm')}, {R('5.547 / (8 * cos(radians(abs(lat) * 0.8))) * 10', 'c_mm')} FROM coord""")
def _(spark, sf):
    a = F.abs("lat") * 0.8
    return keyed(coordinates(spark, sf).select("tile_id", S.rayleigh_mm(2.176, a).alias("ku_mm"), S.rayleigh_mm(5.547, a).alias("c_mm")), ["tile_id"], (), ["ku_mm", "c_mm"])


@query("p31_unpacked_mask", f"WITH {ELEM} SELECT vec_id AS tile_id, i AS cell, (v > 0)::BIGINT AS bit FROM elem")
def _(spark, sf):
    g = grids(spark, sf).withColumn("packed", T.pack_bits(F.col("mask"), 64))
    return keyed(g.select("tile_id", F.posexplode(T.unpack_bits(F.col("packed"), 64)).alias("cell", "bit")), ["tile_id", "cell", "bit"])


# ---- pixel distributions --------------------------------------------------------------------------

CHOSEN = f"""WITH {PIX}, tr AS (SELECT vec_id AS tile_id FROM embeddings WHERE vec_id % 5 > 1 ORDER BY md5(concat_ws(':', '9', vec_id)), vec_id LIMIT 200),
ranked AS (SELECT p.tile_id, r * 8 + c AS pos, v, row_number() OVER (PARTITION BY p.tile_id ORDER BY md5(concat_ws(':', '9', p.tile_id, r * 8 + c))) AS rn
 FROM pix p JOIN tr ON p.tile_id = tr.tile_id WHERE v > 0),
samp AS (SELECT * FROM ranked WHERE rn <= 20)"""


def train_sample(spark, sf):
    t = tiles(spark, sf)
    train = features(spark, sf).where("sector > 1").select(F.col("vec_id").alias("tile_id"))
    return N.sample_pixels(train, t, 200, 20, 9)


@query("n01_pixel_sample", CHOSEN + f" SELECT tile_id, pos::BIGINT AS pos, {R('v')} FROM samp")
def _(spark, sf):
    return keyed(train_sample(spark, sf)[0], ["tile_id", "pos"], (), ["v"])


@query("n01_sample_report", CHOSEN + " SELECT tile_id, 'used' AS status FROM tr")
def _(spark, sf):
    return train_sample(spark, sf)[1]


@query("n02_percentile_range", CHOSEN + f" SELECT {R('quantile_cont(v, 0.01)', 'lo')}, {R('quantile_cont(v, 0.99)', 'hi')}, false AS fallback FROM samp")
def _(spark, sf):
    r = N.percentile_range(train_sample(spark, sf)[0])
    return r.select(round6("lo").alias("lo"), round6("hi").alias("hi"), "fallback")


@query("n03_moment_range", STATS + f""" SELECT {R('avg(mean_dn) - 3 * sqrt(avg(std_dn * std_dn) + var_pop(mean_dn))', 'lo')}, {R('avg(mean_dn) + 3 * sqrt(avg(std_dn * std_dn) + var_pop(mean_dn))', 'hi')} FROM st""")
def _(spark, sf):
    return keyed(N.moment_range(T.tile_stats(tiles(spark, sf)), "mean_display_dn", "std_display_dn"), [], (), ["lo", "hi"])


@query("n04_normalized_tiles", CHOSEN + f""", b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM samp)
SELECT tile_id, {R('sum(least(greatest((v - lo) / (hi - lo + 1e-8), 0), 1))', 'total')}, {R('max(least(greatest((v - lo) / (hi - lo + 1e-8), 0), 1))', 'top')} FROM pix CROSS JOIN b GROUP BY tile_id""")
def _(spark, sf):
    t = N.normalize(tiles(spark, sf), N.percentile_range(train_sample(spark, sf)[0]))
    return keyed(t.select("tile_id", T.array_sum("px").alias("total"), F.array_max("px").alias("top")), ["tile_id"], (), ["total", "top"])


SIDES = f"""WITH {PIX}, src AS (SELECT v, label % 3 AS g FROM pix WHERE tile_id % 2 = 0), tgt AS (SELECT v * v / 100 AS v, label % 3 AS g FROM pix WHERE tile_id % 2 = 1)"""


def sides(spark, sf):
    px = tiles(spark, sf).select("tile_id", (F.col("label") % 3).alias("g"), S.as_doubles("px").alias("v"))
    odd = F.pmod("tile_id", F.lit(2)) == 1
    return px.where(~odd), px.where(odd).withColumn("v", F.transform("v", lambda v: v * v / 100))


QMAP = SIDES + """, qm AS (SELECT i AS k, s, t FROM (SELECT unnest(range(101)) AS i, unnest((SELECT quantile_cont(v, list_transform(range(101), lambda x: x / 100.0)) FROM src)) AS s,
 unnest((SELECT quantile_cont(v, list_transform(range(101), lambda x: x / 100.0)) FROM tgt)) AS t))"""
LEVELS_SQL = "[" + ", ".join(repr(i / 100) for i in range(101)) + "]"
QMAP = QMAP.replace("list_transform(range(101), lambda x: x / 100.0)", LEVELS_SQL)


@query("n05_quantile_map", QMAP + f" SELECT k, {R('s', 'source')}, {R('t', 'target')} FROM qm")
def _(spark, sf):
    p = N.quantile_pairs(*sides(spark, sf), "v", 101)
    return keyed(p.withColumn("k", F.round(F.col("q") * 100)), ["k"], (), ["source", "target"])


@query("n06_remapped_tiles", QMAP + f""", seg AS (SELECT a.s AS s0, b.s AS s1, a.t AS t0, b.t AS t1 FROM qm a JOIN qm b ON b.k = a.k + 1),
m AS (SELECT p.tile_id, CASE WHEN p.v >= (SELECT max(s) FROM qm) THEN (SELECT max(t) FROM qm) WHEN p.v <= (SELECT min(s) FROM qm) THEN (SELECT min(t) FROM qm)
 ELSE t0 + (v - s0) / (s1 - s0) * (t1 - t0) END AS y FROM pix p LEFT JOIN seg ON p.v >= s0 AND p.v < s1)
SELECT tile_id, {R('sum(y)', 'total')}, {R('min(y)', 'lowest')}, {R('max(y)', 'highest')} FROM m GROUP BY tile_id""")
def _(spark, sf):
    src, tgt = sides(spark, sf)
    t = tiles(spark, sf).withColumn("y", N.apply_quantile_map(F.col("px"), N.fit_quantile_map(src, tgt, "v", 101)))
    return keyed(t.select("tile_id", T.array_sum("y").alias("total"), F.array_min("y").alias("lowest"), F.array_max("y").alias("highest")),
                 ["tile_id"], (), ["total", "lowest", "highest"])


DB_MAP = f"""WITH {PIX}, pos AS (SELECT tile_id, abs(v) + 1 AS v FROM pix), src AS (SELECT 10 * log10(v) AS v FROM pos WHERE tile_id % 2 = 0),
tgt AS (SELECT 10 * log10(v) + 2 AS v FROM pos WHERE tile_id % 2 = 1),
qm AS (SELECT unnest(range(101)) AS k, unnest((SELECT quantile_cont(v, {LEVELS_SQL}) FROM src)) AS s, unnest((SELECT quantile_cont(v, {LEVELS_SQL}) FROM tgt)) AS t)"""


@query("n06_tile_through_db", DB_MAP + f""", seg AS (SELECT a.s AS s0, b.s AS s1, a.t AS t0, b.t AS t1 FROM qm a JOIN qm b ON b.k = a.k + 1),
m AS (SELECT tile_id, pow(10, CASE WHEN d >= (SELECT max(s) FROM qm) THEN (SELECT max(t) FROM qm) WHEN d <= (SELECT min(s) FROM qm) THEN (SELECT min(t) FROM qm)
 ELSE t0 + (d - s0) / (s1 - s0) * (t1 - t0) END / 10) AS y FROM (SELECT tile_id, 10 * log10(v) AS d FROM pos) p LEFT JOIN seg ON d >= s0 AND d < s1)
SELECT tile_id, {R('sum(y)', 'total')}, {R('max(y)', 'highest')} FROM m GROUP BY tile_id""")
def _(spark, sf):
    t = tiles(spark, sf).select("tile_id", F.transform("px", lambda v: F.abs(v.cast("double")) + 1).alias("px"))
    px = t.select("tile_id", F.transform("px", lambda v: S.to_db(v)).alias("v"))
    odd = F.pmod("tile_id", F.lit(2)) == 1
    qmap = N.fit_quantile_map(px.where(~odd), px.where(odd).withColumn("v", F.transform("v", lambda v: v + 2)), "v", 101)
    y = t.withColumn("y", N.remap_tile("px", qmap))
    return keyed(y.select("tile_id", T.array_sum("y").alias("total"), F.array_max("y").alias("highest")), ["tile_id"], (), ["total", "highest"])


@query("n07_class_quantile_map", SIDES + f""", s AS (SELECT g, unnest(range(11)) AS k, unnest(q) AS source FROM (SELECT g, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM src GROUP BY g)),
t AS (SELECT g, unnest(range(11)) AS k, unnest(q) AS target FROM (SELECT g, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM tgt GROUP BY g))
SELECT s.g::BIGINT AS g, s.k, {R('source')}, {R('target')} FROM s JOIN t ON s.g = t.g AND s.k = t.k""")
def _(spark, sf):
    p = N.quantile_pairs(*sides(spark, sf), "v", 11, ["g"], 10)
    return keyed(p.withColumn("k", F.round(F.col("q") * 10)), ["g", "k"], (), ["source", "target"])
