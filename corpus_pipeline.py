"""The corpus pipeline: five stages from raw documents to pieces, each written and read again as Parquet.

Language ID drops documents of no decided language; line dedup takes lines that many sites share out
of the texts; near-dedup by SimHash and exact five-word similarity keeps one document of each group; mixing repeats or drops documents
by the sources' target weights, in training order; SentencePiece encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.llm import language, lines, mixing, pieces, similar
from tilescope.llm.common import keep, read
from tilescope.session import ship_code


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return language.keep_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without shared lines; ``n_chars`` follows the text.

    A line must stand on 10 sites and in 10 texts; copies and near copies by their five-word runs count once, so that groups
    of copies and near copies on many sites reach near-dedup whole. Pages with equal lines around different articles are
    different texts, and lose those lines.
    """
    cleaned = lines.clean_lines(docs, min_texts=lines.MIN_SITES)
    return cleaned.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8 or more.

    SimHash fingerprints of five words, linked under the masks of ``op9_simhash``, and bands of minima for the pairs beyond their
    few bits say which texts are compared; every link is the exact similarity of two texts.
    """
    ship_code(spark)
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, score, ids, alternatives, exact): ids as 32-bit little-endian numbers, alternatives to the best as in ``pieces.combine``."""
    ship_code(spark)
    rows = pieces.encode(docs, pieces.load(docs), carry=("doc_id", "lang", "source"), check=True)
    return rows.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "score", "ids", "alternatives", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("sentencepiece", encode)]

#: Language models, SimHash and piece lattices have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is kept in the shared scratch folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
