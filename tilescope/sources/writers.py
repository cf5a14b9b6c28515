"""Writers: validated, never overwriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.operators.quality import assert_empty, check_labels


def catalog_counts(df: DataFrame, k: int, split: str = "split") -> DataFrame:
    """Rows per split with class counts ``class_0..`` and unlabeled rows."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == -1).alias("unlabeled"),
                                 *[F.count_if(F.col("label") == c).alias(f"class_{c}") for c in range(k)])


def write_catalog(df: DataFrame, path: str, k: int, require_labels: bool = True) -> None:
    """Tiles partitioned by split, and the per-split counts beside them; bad labels refuse the write."""
    assert_empty(check_labels(df, k, allow_unlabeled=not require_labels).select("tile_id", "label"), "invalid labels")
    df.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/tiles")
    written = df.sparkSession.read.parquet(f"{path}/tiles")
    catalog_counts(written, k).write.mode("errorifexists").parquet(f"{path}/header")


def write_site_catalog(df: DataFrame, path: str, k: int) -> None:
    """Unsplit source-domain catalog; a split column is refused."""
    if "split" in df.columns:
        raise ValueError("site catalogs carry no split; use a split manifest")
    assert_empty(check_labels(df, k).select("tile_id", "label"), "invalid labels")
    df.write.mode("errorifexists").parquet(f"{path}/tiles")


def write_features(df: DataFrame, path: str, stem: str, model: str, provenance: dict[str, str]) -> None:
    """Feature rows and one metadata row computed from what was written."""
    df.write.mode("errorifexists").parquet(f"{path}/{stem}")
    back = df.sparkSession.read.parquet(f"{path}/{stem}")
    entries = [F.lit(x) for kv in provenance.items() for x in kv]
    back.agg(F.count(F.lit(1)).alias("n_features"), F.max(F.size("f")).alias("feature_dim")).select(
        F.lit(model).alias("model"), F.lit(stem).alias("stem"), "n_features", "feature_dim",
        F.create_map(*entries).alias("provenance")).write.mode("errorifexists").json(f"{path}/{stem}_meta")


def write_result(df: DataFrame, path: str) -> None:
    """A new destination only; an existing path is an error."""
    sanitize(df).write.mode("errorifexists").json(path)


def write_curves(curves: DataFrame, path: str) -> None:
    """All curve points, one folder per class."""
    curves.write.mode("errorifexists").partitionBy("class").parquet(path)


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), rebuilt)
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL at any depth."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
