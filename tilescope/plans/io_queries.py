"""Source and sink queries: tables are written in the reader's format to scratch space and read back.

Records with vectors hold a bounded number of rows each, cut by row position inside a partition.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6
from tilescope.operators import embedding as E
from tilescope.operators import quality as Q
from tilescope.operators import tiles as T
from tilescope.operators.rasters import cells_of
from tilescope.plans.fixtures import (CELLS, COORD, ELEM, PIX, PRED, coordinates, features, fold_role, grids, predictions,
                                      table, tiles)
from tilescope.plans.ranking_queries import CURVE, score_curve
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed
from tilescope.session import new_scratch_path
from tilescope.sources import readers, writers
from tilescope.sources.files import write_files

CHUNK = 25_000


def chunked(df, size=CHUNK):
    return df.withColumn("_chunk", F.floor(F.monotonically_increasing_id() / size))


def catalog_rows(spark, sf):
    s = T.tile_stats(tiles(spark, sf))
    c = coordinates(spark, sf).select("tile_id", "lat", "lon")
    return s.join(c, "tile_id").select(
        F.col("tile_id").cast("string").alias("tile_id"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"),
        "valid_fraction", "mean_display_dn", "std_display_dn", F.pmod("label", F.lit(6)).cast("int").alias("label"),
        S.assign_split("lat", "lon").alias("split"))


STAT_ROWS = f"""WITH {PIX}, {COORD}, st AS (SELECT tile_id, any_value(label) % 6 AS label, round(sum((v > 0)::INT) / 64.0::DOUBLE, 4) AS vf FROM pix GROUP BY tile_id),
hold AS (SELECT tile_id, lat, lon, degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(6.0)) + cos(radians(lat)) * cos(radians(6.0)) * cos(radians(lon - 161.0)))))) <= 5 AS h FROM coord),
cat AS (SELECT s.tile_id::VARCHAR AS tile_id, label, vf, lat, lon, CASE WHEN h THEN 'holdout' WHEN lon >= 180 THEN 'train' WHEN abs(lat) <= 30 THEN 'val' ELSE 'test' END AS split FROM st s JOIN hold ON hold.tile_id = s.tile_id)"""


@query("s01_read_catalog", STAT_ROWS + f" SELECT tile_id, {B('label')}, {R('lat::DOUBLE', 'center_lat')}, {R('lon::DOUBLE', 'center_lon')}, vf AS valid_fraction, split FROM cat")
def _(spark, sf):
    path = new_scratch_path(spark, "catalog")
    docs = chunked(catalog_rows(spark, sf)).groupBy("_chunk").agg(F.collect_list(F.struct(
        "tile_id", "center_lat", "center_lon", "valid_fraction", "mean_display_dn", "std_display_dn", "label", "split")).alias("tiles"))
    docs.select(F.lit("1").alias("schema_version"), F.lit("display").alias("intensity_space"), F.lit(6).alias("num_classes"), "tiles").write.option(
        "maxRecordsPerFile", 1).json(path)
    _, catalog = readers.read_catalog(spark, path)
    return catalog.select("tile_id", bi("label").alias("label"), round6("center_lat").alias("center_lat"), round6("center_lon").alias("center_lon"),
                          "valid_fraction", "split")


@query("s02_read_splits", """SELECT f AS fold, vec_id::VARCHAR AS tile_id, CASE WHEN vec_id % 5 = f THEN 'test' WHEN vec_id % 5 = (f + 1) % 5 THEN 'buffer_excluded' ELSE 'train' END AS role,
 CASE WHEN vec_id % 5 = (f + 1) % 5 THEN 'val_buffer' END AS exclusion_reason FROM embeddings CROSS JOIN range(5) r(f)""")
def _(spark, sf):
    path = new_scratch_path(spark, "splits")
    rows = chunked(features(spark, sf).select("vec_id", "sector")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "role", fold_role(F.col("fold")))
    rows = rows.withColumn("role", F.when(F.col("role") == "val", "buffer_excluded").otherwise(F.col("role")))
    tid = F.col("vec_id").cast("string")
    docs = rows.groupBy("fold", "_chunk").agg(
        F.map_from_entries(F.collect_list(F.struct(tid, "role"))).alias("assignments"),
        F.map_from_entries(F.collect_list(F.when(F.col("role") == "buffer_excluded", F.struct(tid, F.lit("val_buffer"))))).alias("why"))
    docs.select(F.lit("0").alias("catalog_sha256"), F.struct(F.col("fold").alias("test_fold"), F.col("why").alias("exclusion_reasons")).alias("policy"),
                "assignments").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_splits(spark, path).select(bi("fold").alias("fold"), "tile_id", "role", "exclusion_reason")


@query("s03_read_tiles", f"WITH {PIX} SELECT tile_id::VARCHAR AS tile_id, 8::BIGINT AS h, 8::BIGINT AS w, 'float32' AS dtype, round(sum(v::FLOAT::DOUBLE), 4) + 0.0 AS total FROM pix WHERE tile_id % 3 <> 0 GROUP BY tile_id")
def _(spark, sf):
    # two of three files are asked for by name; the others are not opened
    path = new_scratch_path(spark, "tiles")
    files = readers.encode_tiles(tiles(spark, sf))
    write_files(files.select(F.concat("tile_id", F.lit(".npy")).alias("name"), "content"), path)
    t = readers.read_tiles(spark, path, files.select("tile_id").where("tile_id % 3 <> 0"))
    return t.select("tile_id", bi("h").alias("h"), bi("w").alias("w"), "dtype",
                    (F.round(F.aggregate("px", F.lit(0.0), lambda s, x: s + x.cast("double")), 4) + 0.0).alias("total"))


@query("q20_tile_integrity", """SELECT vec_id::VARCHAR AS tile_id, CASE label WHEN 1 THEN 'missing' WHEN 2 THEN 'shape' ELSE 'hash' END AS status FROM embeddings WHERE label IN (1, 2, 3)""")
def _(spark, sf):
    t = tiles(spark, sf)
    # planted faults: absent files, transposed shapes, another digest in the catalog
    files = readers.encode_tiles(t.where("label <> 1").withColumn("h", F.when(F.col("label") == 2, 4).otherwise(F.col("h"))).withColumn(
        "w", F.when(F.col("label") == 2, 16).otherwise(F.col("w"))))
    digests = readers.encode_tiles(t).select("tile_id", F.sha2("content", 256).alias("d")).join(
        t.select(F.col("tile_id").cast("string").alias("tile_id"), "label"), "tile_id")
    catalog = digests.select("tile_id", F.when(F.col("label") == 3, "0").otherwise(F.col("d")).alias("tile_sha256"))
    return Q.check_tiles(readers.decode_tiles(files), catalog, 8, 8)


@query("s05_read_predictions", f"WITH {PRED} SELECT model, fold::BIGINT AS fold, seed::BIGINT AS seed, tile_id, label::BIGINT AS label, pred::BIGINT AS pred, {R('frac')} FROM pred")
def _(spark, sf):
    path = new_scratch_path(spark, "predictions")
    keys = ["model", "fold", "seed"]
    rows = chunked(predictions(spark, sf)).groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("tile_id", "label", "pred", "frac")).alias("r"))
    rows.select(F.lit("linear").alias("family"), *keys, F.col("r.tile_id").alias("tile_ids"), F.col("r.label").alias("labels"), F.col("r.pred").alias("predictions"),
                F.transform("r", lambda x: F.array(x["frac"], 1.0 - x["frac"])).alias("probabilities")).write.option("compression", "gzip").json(path)
    p = readers.read_predictions(spark, path).withColumn("frac", F.col("prob")[0])
    return keyed(p, ["model", "fold", "seed", "tile_id", "label", "pred"], (), ["frac"])


@query("s06_read_grids", f"WITH {CELLS} SELECT tile_id::VARCHAR AS tile_id, {B('any_value(label)', 'modal_label')}, {B('sum(code * (R * 4 + C + 1))', 'checksum')}, {B('sum(wt)', 'bits')} FROM cells GROUP BY tile_id")
def _(spark, sf):
    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                p, buf = pdf.iloc[at: at + 128], io.BytesIO()
                np.savez(buf, tile_ids=p["tile_id"].astype(str).to_numpy(dtype="U"), grids=np.stack(list(p["grid"])).astype(np.uint8),
                         masks=np.stack([np.frombuffer(m, np.uint8) for m in p["mask"]]), roles=np.zeros((len(p), 5), np.int8),
                         modal_labels=p["label"].to_numpy(np.int8))
                yield pd.DataFrame({"name": [f"{p['tile_id'].iloc[0]}.npz"], "content": [buf.getvalue()]})
    g = grids(spark, sf).withColumn("mask", T.pack_bits(F.col("mask"), 64))
    path = new_scratch_path(spark, "grids")
    write_files(g.mapInPandas(archive, "name string, content binary"), path)
    back = readers.read_grids(spark, path)
    checksum = F.aggregate(F.transform("grid", lambda v, i: v * (i + 1)), F.lit(0), lambda s, x: s + x)
    bits = F.aggregate(T.unpack_bits(F.col("mask"), 64), F.lit(0), lambda s, x: s + x)
    return keyed(back.select("tile_id", "modal_label", checksum.alias("checksum"), bits.alias("bits")), ["tile_id"], ["modal_label", "checksum", "bits"])


@query("s07_read_table", f"SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 4 <> 0 THEN p_size::BIGINT END AS p_size, p_retailprice > 1200 AS costly, {R('p_retailprice')} FROM part")
def _(spark, sf):
    path = new_scratch_path(spark, "table")
    part = table(spark, sf, "part")
    part.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("p_size"), (F.col("p_retailprice") > 1200).alias("costly"),
                "p_retailprice").write.option("header", True).csv(path)
    t = readers.read_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, costly boolean, p_retailprice double")
    return t.select("p_partkey", "p_name", "p_brand", bi("p_size").alias("p_size"), "costly", round6("p_retailprice").alias("p_retailprice"))


@query("s08_key_value_labels", """SELECT s_suppkey, 'NAME' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'NATION', s_nationkey::VARCHAR FROM supplier
UNION ALL SELECT s_suppkey, 'NOTE', 'a = b' FROM supplier""")
def _(spark, sf):
    text = F.concat(F.lit('/* X = 1 */\nNATION = 99\n# Y = 2\n NAME = "'), F.col("s_name"), F.lit('"\nplain line\nNOTE = a = b\nNATION = '), F.col("s_nationkey").cast("string"))
    path = new_scratch_path(spark, "labels")
    write_files(table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".lbl")).alias("name"), text.alias("content")), path)
    rows = readers.read_key_values(spark, path)
    return rows.select(F.regexp_extract("source", "^[0-9]+", 0).cast("bigint").alias("s_suppkey"), "name", "value")


@query("s09_read_raster", f"WITH {ELEM} SELECT vec_id AS r, i AS c, 0::BIGINT AS band, {R('CASE WHEN i % 9 = 4 THEN -99 ELSE v END', 'v')}, i % 9 <> 4 AS valid FROM elem")
def _(spark, sf):
    path = new_scratch_path(spark, "raster")
    v = F.transform("f", lambda x, i: F.when(i % 9 == 4, -99.0).otherwise(x.cast("double")))
    features(spark, sf).select(F.lit(0).alias("band"), F.col("vec_id").alias("r"), F.lit(0).cast("bigint").alias("c0"), v.alias("v")).write.parquet(path)
    cells = cells_of(readers.read_raster(spark, path, side=16, nodata=-99.0), side=16)
    return cells.select("r", "c", "band", round6("v").alias("v"), "valid")


# a record is one run of 64 turns, so no record grows with its conversation
@query("s10_read_histories", """SELECT conv_id AS cell, turn // 64 AS part, row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) AS epoch,
 (length(text) % 50)::BIGINT AS score, turn AS steps FROM conversations""")
def _(spark, sf):
    path = new_scratch_path(spark, "histories")
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("cell"), F.floor(F.col("turn") / 64).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.pmod(F.length("text"), F.lit(50)).alias("score")))).alias("r"))
    c.select("cell", "part", F.col("r.score").alias("score"), F.col("r.turn").alias("steps")).write.json(path)
    h = readers.read_histories(spark, path, {"cell": "bigint", "part": "bigint"}, {"score": "int", "steps": "bigint"})
    return keyed(h, ["cell", "part", "epoch"], ["score", "steps"])


@query("w01_write_catalog", STAT_ROWS + f" SELECT split, count(*) AS total, 0::BIGINT AS unlabeled, {', '.join(B(f'sum((label = {c})::INT)', f'class_{c}') for c in range(6))} FROM cat GROUP BY split")
def _(spark, sf):
    path = new_scratch_path(spark, "out")
    writers.write_catalog(catalog_rows(spark, sf), path, 6)
    return spark.read.parquet(f"{path}/header")


@query("w02_write_site_catalog", """SELECT s_suppkey::VARCHAR AS tile_id, n_regionkey::BIGINT AS label, n_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf):
    path = new_scratch_path(spark, "out")
    sites = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("site"), F.col("n_regionkey").alias("label"))
    rows = table(spark, sf, "supplier").join(sites, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("tile_id"), "label", "site")
    writers.write_site_catalog(rows, path, 5)
    return spark.read.parquet(f"{path}/tiles").select("tile_id", bi("label").alias("label"), "site")


@query("w03_write_features", "SELECT 'control' AS model, 'titles' AS stem, count(*) AS n_features, 64::BIGINT AS feature_dim FROM embeddings")
def _(spark, sf):
    path = new_scratch_path(spark, "out")
    writers.write_features(features(spark, sf).select("vec_id", "label", "f"), path, "titles", "control", {"source": "embeddings"})
    _, meta = readers.read_features(spark, path, "titles")
    return meta.select("model", "stem", "n_features", bi("feature_dim").alias("feature_dim"))


@query("s04_read_features", """WITH f AS (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 50 = 7),
 reasons AS (SELECT DISTINCT vec_id, unnest(CASE vec_id % 50 WHEN 7 THEN ['repeated'] WHEN 8 THEN ['size'] WHEN 9 THEN ['not_finite'] WHEN 10 THEN ['unexpected'] ELSE [] END) AS reason FROM f)
SELECT vec_id, reason FROM reasons UNION ALL SELECT -1 - vec_id, 'missing' FROM embeddings WHERE vec_id % 50 = 11""")
def _(spark, sf):
    """A landed table with planted faults, read back and held against the expected IDs."""
    path, part = new_scratch_path(spark, "out"), F.pmod("vec_id", F.lit(50))
    clean = features(spark, sf).select("vec_id", F.col("label").cast("int").alias("label"), F.transform("f", lambda v: v.cast("float")).alias("f"))
    planted = clean.withColumn("f", F.when(part == 8, F.slice("f", 1, 63)).when(part == 9, F.transform("f", lambda v, i: F.when(i == 5, F.lit(float("nan")).cast("float")).otherwise(v))).otherwise(F.col("f")))
    writers.write_features(planted.unionByName(planted.where(part == 7)), path, "planted", "control", {"source": "embeddings"})
    rows, _ = readers.read_features(spark, path, "planted")
    expected = clean.where(part != 10).select("vec_id").unionByName(clean.where(part == 11).select((-1 - F.col("vec_id")).alias("vec_id")))
    return E.feature_faults(rows, 64, expected)


@query("w04_write_result", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) + 0.0 AS mean FROM customer GROUP BY 1")
def _(spark, sf):
    path = new_scratch_path(spark, "out")
    writers.write_result(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), round6(F.avg("c_acctbal")).alias("mean")), path)
    return spark.read.schema("segment string, n bigint, mean double").json(path)


@query("w05_write_curves", CURVE + f" SELECT fold::BIGINT AS class, model, {R('threshold')}, {B('tp')} FROM curve")
def _(spark, sf):
    path = new_scratch_path(spark, "out")
    writers.write_curves(score_curve(spark, sf).withColumnRenamed("fold", "class").select("class", "model", "threshold", "tp"), path)
    return keyed(spark.read.parquet(path), ["class", "model"], ["tp"], ["threshold"])


@query("w06_sanitized_numbers", """SELECT event_id, CASE WHEN user_id % 5 > 1 THEN value END AS v, CASE WHEN user_id % 5 > 1 THEN value * 2 END AS inner_v, (user_id % 5 <= 1)::BIGINT AS nulls FROM events""")
def _(spark, sf):
    m = F.pmod("user_id", F.lit(5))
    v = F.when(m == 0, float("nan")).when(m == 1, float("inf")).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_id", v.alias("v"), F.struct((v * 2).alias("x"), F.array(v, F.lit(1.0)).alias("a")).alias("s"))
    c = writers.sanitize(e)
    return c.select("event_id", "v", F.col("s.x").alias("inner_v"), F.size(F.filter("s.a", lambda x: x.isNull())).cast("bigint").alias("nulls"))
