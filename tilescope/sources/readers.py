"""Readers: every schema is explicit and malformed input fails the job."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.operators.rasters import SIDE, block_runs
from tilescope.sources.files import read_contents

TILE_FIELDS = ("tile_id string, tile_sha256 string, center_lat double, center_lon double, valid_fraction double, "
               "mean_display_dn double, std_display_dn double, label int, label_confidence double, "
               "mean_incidence_angle double, split string")
SITE_FIELDS = ("tile_id string, label int, site string, terrain_class string, continent string, "
               "source_product_id string, valid_fraction double, mean_sigma0_db double, std_sigma0_db double")
HEADER_FIELDS = ("schema_version string, benchmark_track string, domain string, tile_size int, num_classes int, "
                 "class_names array<string>, labels_available boolean, intensity_space string, split_policy string")
SPLIT_SCHEMA = ("catalog_sha256 string, policy struct<test_fold:int,test_site:string,exclusion_reasons:map<string,string>>, "
                "counts map<string,int>, assignments map<string,string>")


def _strict(spark: SparkSession, schema: str):
    return spark.read.schema(schema).option("mode", "FAILFAST")


def read_catalog(spark: SparkSession, path: str, tile_fields: str = TILE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(header rows, tile rows) of one or more catalog documents."""
    doc = _strict(spark, f"{HEADER_FIELDS}, tiles array<struct<{tile_fields}>>").option("multiLine", True).json(path)
    return doc.drop("tiles"), doc.select(F.inline("tiles"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(source, fold, test_site, tile_id, role, exclusion_reason) from split manifests."""
    doc = _strict(spark, SPLIT_SCHEMA).option("multiLine", True).json(path)
    rows = doc.select(F.col("_metadata.file_name").alias("source"), F.col("policy.test_fold").alias("fold"),
                      F.col("policy.test_site").alias("test_site"), F.col("policy.exclusion_reasons").alias("_why"),
                      F.explode("assignments").alias("tile_id", "role"))
    return rows.withColumn("exclusion_reason", F.try_element_at("_why", F.col("tile_id"))).drop("_why")


TILE_SCHEMA = "tile_id string, h int, w int, dtype string, sha256 string, px array<float>"


def decode_tiles(files: DataFrame) -> DataFrame:
    """Decode (tile_id, content) array files to pixels, with shape, dtype and content digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tile_id, content in zip(pdf["tile_id"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                h, w = a.shape if a.ndim == 2 else (0, 0)
                rows.append((tile_id, h, w, str(a.dtype), hashlib.sha256(content).hexdigest(),
                             a.ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["tile_id", "h", "w", "dtype", "sha256", "px"])
    return files.select("tile_id", "content").mapInPandas(run, TILE_SCHEMA)


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """Pixels to (tile_id, content) array files in float32."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for px, h, w in zip(pdf["px"], pdf["h"], pdf["w"]):
                buf = io.BytesIO()
                np.save(buf, np.asarray(px, dtype=np.float32).reshape(h, w))
                out.append(buf.getvalue())
            yield pd.DataFrame({"tile_id": pdf["tile_id"], "content": out})
    return tiles.select(F.col("tile_id").cast("string").alias("tile_id"), "px", "h", "w").mapInPandas(
        run, "tile_id string, content binary")


def tile_paths(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, path) of the tile files; names only, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("tile_id"), "path")


def read_tiles(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Decoded tiles; ``ids`` (tile_id) selects names, and only the files of those are opened."""
    if ids is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
        return decode_tiles(files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("tile_id"), "content"))
    return decode_tiles(read_contents(tile_paths(spark, path).join(ids.select("tile_id"), "tile_id", "left_semi")))


def missing_tiles(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Wanted IDs without a file; lists names only, no content is read."""
    return ids.select("tile_id").join(tile_paths(spark, path).select("tile_id"), "tile_id", "left_anti")


FEATURE_SCHEMA = "tile_id string, label int, f array<float>"


def read_features(spark: SparkSession, path: str, stem: str, id_type: str = "bigint", id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(feature rows, one metadata row) of a landed feature table; columns ``id_col``, ``label`` and ``f`` by declared types."""
    return (spark.read.schema(f"`{id_col}` {id_type}, label int, f array<float>").parquet(f"{path}/{stem}"),
            _strict(spark, "model string, stem string, n_features bigint, feature_dim int, provenance map<string,string>")
            .json(f"{path}/{stem}_meta"))


def decode_feature_arrays(files: DataFrame) -> DataFrame:
    """One-off ingestion of (features, labels, ids) array triples held as binary columns, file by file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lambda b: np.load(io.BytesIO(b), allow_pickle=False)
        for pdf in batches:
            for f, y, ids in zip(pdf["features"], pdf["labels"], pdf["ids"]):
                f, y, ids = load(f), load(y), load(ids)
                if not len(f) == len(y) == len(ids):
                    raise ValueError("feature, label and ID arrays differ in length")
                yield pd.DataFrame({"tile_id": ids.astype(str), "label": y.astype(np.int32), "f": list(f.astype(np.float32))})
    return files.mapInPandas(run, FEATURE_SCHEMA)


PREDICTION_SCHEMA = ("family string, model string, fold int, seed int, tile_ids array<string>, labels array<int>, "
                     "predictions array<int>, probabilities array<array<double>>")


def explode_vectors(records: DataFrame, keys: list[str], vectors: dict[str, str], position: str) -> DataFrame:
    """Parallel vectors to rows with their 0-based position; unequal lengths raise."""
    sizes = [F.size(v) for v in vectors]
    same = sizes[0] == sizes[0]
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    fail = F.raise_error(F.lit("vectors of one record differ in length")).cast("boolean")
    ok = records.where(F.when(same, True).otherwise(fail))
    rows = ok.select(*keys, F.posexplode(F.arrays_zip(*vectors)).alias(position, "_z"))
    return rows.select(*keys, position, *[F.col(f"_z.{v}").alias(name) for v, name in vectors.items()])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction, keeping vector order in ``pos``; gzip is read natively."""
    records = _strict(spark, PREDICTION_SCHEMA).json(path)
    return explode_vectors(records, ["family", "model", "fold", "seed"], {
        "tile_ids": "tile_id", "labels": "label", "predictions": "pred", "probabilities": "prob"}, "pos")


def read_histories(spark: SparkSession, path: str, cell: dict[str, str], metrics: dict[str, str]) -> DataFrame:
    """One row per epoch, counted from one; ``cell`` and ``metrics`` map names to types."""
    schema = ", ".join([*[f"{c} {t}" for c, t in cell.items()], *[f"{m} array<{t}>" for m, t in metrics.items()]])
    rows = explode_vectors(_strict(spark, schema).json(path), list(cell), {m: m for m in metrics}, "_pos")
    return rows.select(*cell, (F.col("_pos") + 1).alias("epoch"), *metrics)


GRID_SCHEMA = "tile_id string, grid array<int>, mask binary, roles array<int>, modal_label int"


def decode_grids(files: DataFrame) -> DataFrame:
    """Decode (content) archives of tile_ids, grids, masks, roles and modal_labels to one row per tile."""
    members = {"tile_ids", "grids", "masks", "roles", "modal_labels"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if set(z.files) != members:
                        raise ValueError(f"archive members differ: {sorted(z.files)}")
                    n = len(z["tile_ids"])
                    yield pd.DataFrame({
                        "tile_id": z["tile_ids"].astype(str), "grid": list(z["grids"].reshape(n, -1).astype(np.int32)),
                        "mask": [m.tobytes() for m in z["masks"]], "roles": list(z["roles"].astype(np.int32)),
                        "modal_label": z["modal_labels"].astype(np.int32)})
    return files.select("content").mapInPandas(run, GRID_SCHEMA)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    return decode_grids(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV with a checked header; empty means NULL."""
    return _strict(spark, schema).option("header", True).option("enforceSchema", False).option("nullValue", "").csv(path)


def parse_key_values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) from ``NAME = VALUE`` lines: comments skipped, quotes stripped, the last one wins."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("_line", "_text"))
    parts = F.split("_text", "=", 2)
    lines = lines.where(F.col("_text").contains("=") & ~F.trim("_text").startswith("/*") & ~F.trim("_text").startswith("#"))
    pairs = lines.select(key, "_line", F.trim(parts[0]).alias("name"),
                         F.regexp_replace(F.trim(parts[1]), '^"|"$', "").alias("value")).where("name <> ''")
    return pairs.groupBy(key, "name").agg(F.max_by("value", "_line").alias("value"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Label files are small: one row per file keeps line order."""
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("source"), "value")
    return parse_key_values(docs, "source", "value")


def read_raster(spark: SparkSession, path: str, bands: int = 1, side: int = SIDE, nodata: float | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Blocks (``operators.rasters``) of a Parquet table of raster runs (band, r, c0, v array).

    ``rows`` reads the block rows of raster rows from the first to before the second; the scan skips the others.
    """
    runs = spark.read.schema("band int, r bigint, c0 bigint, v array<double>").parquet(path)
    if rows is not None:
        runs = runs.where((F.col("r") >= rows[0] // side * side) & (F.col("r") < -(-rows[1] // side) * side))
    return block_runs(runs, bands, side, nodata)
