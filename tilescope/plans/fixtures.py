"""Inputs derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.session import new_scratch_path

K = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- predictions (from lineitem) --------------------------------------------------

def predictions(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    label = F.pmod("l_orderkey", F.lit(6)).cast("int")
    return li.select(
        F.col("l_returnflag").alias("model"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("fold"),
        F.col("l_linenumber").alias("seed"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("tile_id"),
        label.alias("label"),
        F.when(F.col("l_partkey") % 3 == 0, label)
        .otherwise(F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(6)).cast("int")).alias("pred"),
        F.col("l_quantity").alias("score"), (F.col("l_discount") * 10).alias("frac"))


PRED = """pred AS (
 SELECT l_returnflag AS model, l_suppkey % 5 AS fold, l_linenumber AS seed,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CAST(round(l_extendedprice * 100) AS BIGINT)) AS tile_id,
  l_orderkey % 6 AS label,
  CASE WHEN l_partkey % 3 = 0 THEN l_orderkey % 6 ELSE (l_orderkey + l_linenumber) % 6 END AS pred,
  l_quantity AS score, l_discount * 10 AS frac FROM lineitem)"""

# confusion counts, dense over 6 x 6, keyed by (model, fold, seed)
DENSE = f"""WITH {PRED},
cnt AS (SELECT model, fold, seed, label, pred, count(*) AS n FROM pred GROUP BY ALL),
cells AS (SELECT DISTINCT model, fold, seed FROM pred),
cm AS (SELECT c.model, c.fold, c.seed, a.i AS label, b.i AS pred, coalesce(cnt.n, 0) AS n
 FROM cells c CROSS JOIN range(6) a(i) CROSS JOIN range(6) b(i)
 LEFT JOIN cnt ON cnt.model = c.model AND cnt.fold = c.fold AND cnt.seed = c.seed
  AND cnt.label = a.i AND cnt.pred = b.i),
pc AS (SELECT model, fold, seed, cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
 FROM (SELECT model, fold, seed, label AS cls, CASE WHEN label = pred THEN n ELSE 0 END AS tp,
              n AS support, 0 AS predicted FROM cm
       UNION ALL SELECT model, fold, seed, pred, 0, 0, n FROM cm) GROUP BY ALL),
met AS (SELECT *, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall,
 2.0 * tp / nullif(support + predicted, 0) AS f1 FROM pc)"""


# ---- features and folds -----------------------------------------------------------

def features(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.pmod("vec_id", F.lit(5)).cast("int").alias("sector"),
                    F.pmod("vec_id", F.lit(2)).cast("int").alias("domain"),
                    F.col("embedding").alias("f"))


def fold_role(fold, sector="sector"):
    return (F.when(F.col(sector) == fold, "test")
            .when(F.col(sector) == F.pmod(fold + 1, F.lit(5)), "val").otherwise("train"))


def folds(spark, sf) -> DataFrame:
    """Every feature row once per fold, with its role there."""
    return (features(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
            .withColumn("role", fold_role(F.col("fold"))))


FOLDS = """folds AS (SELECT vec_id, label, embedding AS f, fold,
 CASE WHEN vec_id % 5 = fold THEN 'test' WHEN vec_id % 5 = (fold + 1) % 5 THEN 'val' ELSE 'train' END AS role
 FROM embeddings CROSS JOIN range(5) r(fold))"""

ELEM = """elem AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v
 FROM embeddings CROSS JOIN range(1, 65) r(i))"""


# ---- 8x8 tiles ---------------------------------------------------------------------

def tiles(spark, sf) -> DataFrame:
    """Raw value v*255 per pixel; valid means above zero."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("tile_id"), "label", F.lit(8).alias("h"), F.lit(8).alias("w"),
                    F.transform("embedding", lambda v: v.cast("double") * 255.0).alias("px"))


PIX = """pix AS (SELECT vec_id AS tile_id, label, (i - 1) // 8 AS r, (i - 1) % 8 AS c,
 CAST(embedding[i] AS DOUBLE) * 255.0 AS v FROM embeddings CROSS JOIN range(1, 65) t(i))"""


# ---- map grids ----------------------------------------------------------------------

def grids(spark, sf) -> DataFrame:
    """4x4 class codes (255 unknown) and an 8x8 validity mask per tile."""
    e = table(spark, sf, "embeddings").withColumn("d", S.as_doubles("embedding"))

    def code(k):
        base = F.floor(k / 4).cast("int") * 16 + F.pmod(k, F.lit(4)) * 2 + 1
        at = lambda o: F.element_at("d", base + o)
        mean = (at(0) + at(1) + at(8) + at(9)) / 4.0
        c = F.pmod(F.floor(F.abs(mean) * 1000.0), F.lit(7)).cast("int")
        return F.when(c == 6, F.lit(255)).otherwise(c)

    return e.select(F.col("vec_id").alias("tile_id"), "label",
                    F.transform(F.sequence(F.lit(0), F.lit(15)), code).alias("grid"),
                    F.transform("d", lambda v: (v > 0).cast("int")).alias("mask"))


CELLS = """cell0 AS (SELECT vec_id AS tile_id, label, R, C,
  CAST(embedding[R * 16 + C * 2 + 1] AS DOUBLE) AS p0, CAST(embedding[R * 16 + C * 2 + 2] AS DOUBLE) AS p1,
  CAST(embedding[R * 16 + C * 2 + 9] AS DOUBLE) AS p2, CAST(embedding[R * 16 + C * 2 + 10] AS DOUBLE) AS p3
 FROM embeddings CROSS JOIN range(4) a(R) CROSS JOIN range(4) b(C)),
cells AS (SELECT tile_id, label, R, C,
  CASE WHEN CAST(floor(abs((p0 + p1 + p2 + p3) / 4.0) * 1000.0) AS BIGINT) % 7 = 6 THEN 255
       ELSE CAST(floor(abs((p0 + p1 + p2 + p3) / 4.0) * 1000.0) AS BIGINT) % 7 END AS code,
  (p0 > 0)::INT + (p1 > 0)::INT + (p2 > 0)::INT + (p3 > 0)::INT AS wt FROM cell0)"""

CENSUS = CELLS + """,
modes AS (SELECT tile_id, label, code, mode, CASE mode WHEN 'baseline' THEN 1 WHEN 'weighted' THEN wt
  WHEN 'all_four' THEN (wt = 4)::INT ELSE (wt > 0)::INT END AS n
 FROM cells CROSS JOIN (VALUES ('baseline'), ('weighted'), ('all_four'), ('any_valid')) m(mode)),
tile_class AS (SELECT e.vec_id AS tile_id, m.mode, k.i AS cls, coalesce(sum(q.n), 0) AS n
 FROM embeddings e CROSS JOIN (VALUES ('baseline'), ('weighted'), ('all_four'), ('any_valid')) m(mode)
 CROSS JOIN range(6) k(i) LEFT JOIN modes q ON q.tile_id = e.vec_id AND q.mode = m.mode AND q.code = k.i
 GROUP BY ALL),
tile_unknown AS (SELECT tile_id, mode, sum(CASE WHEN code = 255 THEN n ELSE 0 END) AS unknown_n,
 sum(CASE WHEN code = 255 THEN 0 ELSE n END) AS known_n FROM modes GROUP BY ALL),
tile_modal AS (SELECT tile_id, arg_min(cls, -n * 10 + cls) AS modal, max(n) AS top
 FROM tile_class WHERE mode = 'baseline' GROUP BY ALL)"""


# ---- coordinates ---------------------------------------------------------------------

def coordinates(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("tile_id"), "label",
                    (F.pmod(F.col("vec_id") * 37, F.lit(1800)) / 10.0 - 90.0).alias("lat"),
                    (F.pmod(F.col("vec_id") * 73, F.lit(3600)) / 10.0).alias("lon"))


COORD = """coord AS (SELECT vec_id AS tile_id, label, (vec_id * 37 % 1800) / 10.0 - 90.0 AS lat,
 (vec_id * 73 % 3600) / 10.0 AS lon FROM embeddings)"""


def sql_haversine(a_lat, a_lon, b_lat, b_lon, radius="2574700.0") -> str:
    return (f"(2.0 * asin(sqrt(least(greatest(pow(sin((radians({a_lat}) - radians({b_lat})) / 2), 2) + "
            f"cos(radians({a_lat})) * cos(radians({b_lat})) * "
            f"pow(sin(radians({a_lon} - {b_lon}) / 2), 2), 0.0), 1.0))) * {radius})")


# ---- ensemble members ------------------------------------------------------------------

def members(spark, sf) -> DataFrame:
    """Five member models per tile: softmax of ten times a window of six vector elements."""
    e = table(spark, sf, "embeddings")
    return (e.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4))))
            .select(F.col("vec_id").alias("tile_id"), "member",
                    F.pmod("label", F.lit(6)).cast("int").alias("label"),
                    S.softmax(F.transform(F.slice("embedding", F.col("member") * 6 + 1, F.lit(6)),
                                          lambda v: v.cast("double") * 10.0)).alias("prob"))
            .withColumn("pred", S.argmax("prob")))


MEMBERS = """logit AS (SELECT vec_id AS tile_id, m AS member, label % 6 AS label, k AS cls,
  CAST(embedding[m * 6 + k + 1] AS DOUBLE) * 10.0 AS z
 FROM embeddings CROSS JOIN range(5) a(m) CROSS JOIN range(6) b(k)),
prob AS (SELECT tile_id, member, label, cls, exp(z - max(z) OVER w) / sum(exp(z)) OVER w
   * exp(max(z) OVER w) AS p FROM logit WINDOW w AS (PARTITION BY tile_id, member)),
member_pred AS (SELECT tile_id, member, any_value(label) AS label, arg_max(cls, z) AS pred
 FROM logit GROUP BY tile_id, member)"""


# ---- histories ---------------------------------------------------------------------------

def histories(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("cell"), F.col("turn").alias("epoch"),
                    F.pmod(F.length("text"), F.lit(50)).alias("score"), F.lit(1).alias("steps"),
                    F.pmod("turn", F.lit(2)).cast("int").alias("skipped"))


HIST = """hist AS (SELECT conv_id AS cell, turn AS epoch, length(text) % 50 AS score, 1 AS steps,
 turn % 2 AS skipped FROM conversations)"""


# ---- ranking input ---------------------------------------------------------------------------

def ranked_documents(spark, sf) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(l, "doc_id")


RANKED = """ranked AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def written_runs(spark, runs) -> DataFrame:
    """Raster runs (band, r, c0, v) written as a raster's Parquet files are, and read again."""
    path = new_scratch_path(spark, "raster")
    runs.select("band", "r", "c0", "v").write.parquet(path)
    return spark.read.parquet(path)
