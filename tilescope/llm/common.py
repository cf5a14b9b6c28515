"""Shared helpers: kept tables, running totals without hot groups, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescope.session import new_scratch_path

WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep(df: DataFrame, name: str, codec: str = "none") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage like a checkpoint, but in columns and with a size that join planning sees. Most
    kept tables are narrow numbers and digests, which codecs hardly shrink; without one, many small
    tasks do not pile up the codec's buffers outside the heap. Texts take ``zstd``. Spark removes the folder when the
    application ends; ``drop`` removes it earlier.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a kept table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than space and tab to carriage return; null text: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_doc``, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_key(*parts: Column) -> Column:
    """md5 of the parts as text, joined by ``|``; a null part reads ``~``."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def before(df: DataFrame, groups: list[str], key: str, sums: list[str], rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over rows of the same group whose md5 ``key`` is smaller.

    ``df`` is a kept table, unique on (groups, key). Each group is cut into buckets by the leading 32
    bits of the key, as many as the counted rows ask for; bucket totals give offsets, windows run
    inside buckets, so that no task holds a group. Results do not depend on the number of buckets.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(8 * partitions, math.ceil(df.count() / rows_per_bucket))
    rows = df.withColumn("_b", F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n, 32))
    by = [*groups, "_b"]
    totals = rows.groupBy(*by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    same = [rows[c].eqNullSafe(offsets[c]) for c in groups] + [rows["_b"] == offsets["_b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = rows.join(offsets, on).select(rows["*"], *[offsets[f"_o_{s}"] for s in sums])
    return joined.select("*", *[
        (F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums
    ]).drop("_b", *[f"_o_{s}" for s in sums])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over undirected ``edges`` (u, v), for nodes that are not it.

    Alternating large-star and small-star rounds: every round links each node's larger, then its
    smaller neighbours to the smallest one, until all edges point to their component's smallest id.
    Edges never grow in number. Minima are aggregated before they are joined, so a node with very
    many neighbours is one row there and its edges can be split over tasks.
    """
    def minima(e):
        return keep(e.groupBy("u").agg(F.min("v").alias("m")), "minima")

    def signature(e):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both)
        large = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        low2 = minima(large)
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = signature(after)
        for t in (now, low, large, low2):
            drop(t)
        now, mark, last = after, seen, mark
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
