"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm.common import components, drop, keep, whole

SHINGLE = 4
SEED = 42
RADIUS = 4
PIECE = 1 << 16
TILE = 2048


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint, as a signed number: bit i is set where over half of the shingles' hashes have it.

    Words are runs of bytes between ASCII white space with A-Z lower-cased; repeated shingles count
    each time; fewer words than a shingle make one shingle; no word (or null) gives zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[shingle - 1:].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[at:at + PIECE], ends[at:at + PIECE])), np.uint64)
                    for at in range(0, n, PIECE))


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the 64-bit hashes of all ``parts``, as a signed number; no hash gives zero."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius + 1) - 1 masks of which, for any ``radius`` bit positions, one leaves all of them out.

    Bit positions carry nonzero vectors of radius + 1 binary digits in turn; mask v keeps the bits whose
    vector has an odd product with v. ``radius`` vectors span less than the whole space, so some v is
    orthogonal to all of them: two values that differ in those bits only agree under mask v.
    """
    size = (1 << radius + 1) - 1
    codes = [i % size + 1 for i in range(bits)]
    masks = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links values with at most ``radius`` differing bits."""
    left, us, vs = np.ones(len(values), bool), [], []
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first], stack = False, [first]
        while stack:
            x = stack.pop()
            found = np.flatnonzero(left & (np.bitwise_count(values ^ values[x]) <= radius))
            if len(found):
                left[found] = False
                us.append(np.full(len(found), values[x]))
                vs.append(values[found])
                stack.extend(found.tolist())
    none = np.empty(0, values.dtype)
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def _bucket_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        us, vs = [], []
        for values in batch["values"]:
            u, v = forest(np.unique(np.asarray(values, np.int64)).view(np.uint64))
            us.append(u.view(np.int64))
            vs.append(v.view(np.int64))
        if us:
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def link_fingerprints(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect exactly what links of at most ``radius`` bits connect, over distinct ``fp``.

    Every value goes to one bucket per mask; a pair within the radius shares at least one. Buckets of
    one value are dropped by their counts. A larger bucket is cut into blocks of about TILE values and
    every two blocks meet once, so that no task holds a bucket; each gives a spanning forest, not pairs.
    """
    masks = covering_masks(radius)
    tables = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    busy = keep(tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "buckets")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = (tables.join(busy, ["t", "key"]).withColumn("_mine", mine)
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .groupBy("t", "key", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"))
             .agg(F.collect_list("fp").alias("values")))
    return meets.select("values").mapInPandas(_bucket_edges, "u long, v long")


def component_of_fingerprints(rows: DataFrame, first: Column) -> DataFrame:
    """(fp, first): the smallest ``first`` over all rows whose fingerprints are reachable from ``fp``.

    ``rows`` is a kept table with a column ``fp``; the result is a kept table of distinct fingerprints.
    """
    values = keep(rows.groupBy("fp").agg(F.min(first).alias("own")), "fingerprints")
    links = keep(link_fingerprints(values).distinct(), "links")
    roots = keep(components(links), "components")
    named = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "own", F.coalesce("component", "fp").alias("root"))
    firsts = keep(named.groupBy("root").agg(F.min("own").alias("first")), "firsts")
    out = keep(named.select("fp", "root").join(firsts, "root").select("fp", "first"), "groups")
    for t in (values, links, roots, firsts):
        drop(t)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    ``component_id`` is the smallest doc_id reachable over links of at most 4 differing fingerprint
    bits. Texts without words (null, empty) have fingerprint zero and link like others. Null ids are
    never the smallest; a group of null ids only has a null component. Repeated rows stay; other
    columns are not read.
    """
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    groups = component_of_fingerprints(rows, F.col("doc_id"))
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                          F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest (id, md5 of the text) stays.

    Null ids come after others. Of rows equal in both one stays. All columns stay as they are.
    """
    identity = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("text"))
    rows = keep(docs.select(identity.alias("_identity"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    stays = component_of_fingerprints(rows, F.col("_identity")).select(F.md5(F.to_json("first")).alias("_stays")).distinct()
    return (docs.select(whole(docs), F.md5(F.to_json(identity)).alias("_stays")).join(stays, "_stays", "left_semi")
            .dropDuplicates(["_stays"]).select("_doc.*"))
