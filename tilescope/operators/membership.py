"""Joins by ID, fold membership, set algebra and replacement draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescope.operators.ordering import hash_first, hash_rank
from tilescope.operators.quality import assert_empty, check_coverage
from tilescope.session import small_side


def apply_split(catalog: DataFrame, splits: DataFrame, key: str = "tile_id") -> DataFrame:
    """Join roles by ID after checking that both sides hold exactly the same IDs.

    The check runs on its own (ID columns only): inside the join, a later filter could prune the
    rows that should fail.
    """
    assert_empty(check_coverage(catalog.select(key), splits.select(key), key), "split and catalog IDs differ")
    return catalog.join(splits.select(key, "role"), key)


def align(df: DataFrame, meta: DataFrame, key: str = "tile_id") -> DataFrame:
    """Inner join by ID; unmatched rows drop out on both sides."""
    return df.join(meta, key)


def join_scores(pred: DataFrame, truth: DataFrame, cohorts: DataFrame, key: str = "tile_id") -> DataFrame:
    """Predictions with truth and every cohort the item belongs to (one row per cohort)."""
    return pred.join(truth, key).join(cohorts, key)


def restrict_to_source_classes(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Keep test rows whose class occurs in training; the class list is at most K rows."""
    return test.join(small_side(train.select(label).distinct()), label, "left_semi")


def class_overlap(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Each class of ``a`` or ``b`` with status supported / absent / extra."""
    x = a.select(label).distinct().withColumn("_a", F.lit(True))
    y = b.select(label).distinct().withColumn("_b", F.lit(True))
    return x.join(y, label, "full_outer").select(
        label, F.when(F.col("_b").isNull(), "absent").when(F.col("_a").isNull(), "extra")
        .otherwise("supported").alias("status"))


def test_union(splits: DataFrame, key: str = "tile_id") -> DataFrame:
    """IDs that test in any fold, with how many folds they test in."""
    return splits.where("role = 'test'").groupBy(key).agg(F.count(F.lit(1)).alias("folds"))


def replace_members(train: DataFrame, removed: DataFrame, added: DataFrame, key: str = "tile_id") -> DataFrame:
    """(train - removed) + added."""
    cols = train.columns
    return train.join(removed.select(key), key, "left_anti").select(cols).unionByName(added.select(cols)).distinct()


def replacement_draw(eligible: DataFrame, boundary: DataFrame, draws: int, label: str = "label",
                     key: str = "tile_id") -> DataFrame:
    """Per draw, as many eligible IDs of each class as the boundary set adds: (draw, key, label).

    Those first in the draw's seeded md5 order, by ``hash_first``: no draw ranks the rows it does not take.
    """
    need = boundary.groupBy(label).agg(F.count(F.lit(1)).alias("_need"))
    have = eligible.groupBy(label).agg(F.count(F.lit(1)).alias("_have"))
    short = need.join(have, label, "left").where(F.coalesce("_have", F.lit(0)) < F.col("_need"))
    assert_empty(short, "too few eligible rows in a class")  # K rows; a lazy check could be optimised away
    pool = eligible.select(key, label).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    quota = need.select(label, F.col("_need").alias("_quota"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return hash_first(pool, ["draw", label], quota, F.col("draw").cast("string"), [key]).select("draw", key, label)


def leave_one_group_out(df: DataFrame, group: str, product: str, groups: list, val_share: float,
                        seed) -> DataFrame:
    """One manifest per group: its rows test; whole source products, taken in hash order until
    ``val_share`` of the other products is held out, validate; the rest train.

    The design replicates rows once per group by definition; product roles are decided on the small
    product table.
    """
    products = df.select(group, product).distinct().withColumn(
        "test_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    others = hash_rank(products.where(F.col(group) != F.col("test_group")), ["test_group"], seed, [product])
    size = others.groupBy("test_group").agg(F.ceil(F.count(F.lit(1)) * val_share).alias("_quota"))
    val = others.join(size, "test_group").where("rank <= _quota").select("test_group", group, product, F.lit("val").alias("_v"))
    rows = df.withColumn("test_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    return rows.join(small_side(val), ["test_group", group, product], "left").withColumn(
        "role", F.when(F.col(group) == F.col("test_group"), "test").otherwise(F.coalesce("_v", F.lit("train")))).drop("_v")


def omit_each(df: DataFrame, group: str, groups: list) -> DataFrame:
    """A copy of the pool per omitted group, and one with nothing omitted (``NONE``)."""
    names = F.array(*[F.lit(str(g)) for g in groups], F.lit("NONE"))
    return df.withColumn("omitted", F.explode(F.filter(names, lambda g: g != F.col(group).cast("string"))))


def lost_classes(pools: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Per omitted group: rows, classes left, and whether a class was lost."""
    counts = pools.groupBy("omitted", label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("omitted").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")).withColumn(
        "class_lost", F.col("classes") < k)
