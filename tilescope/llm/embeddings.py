"""Near-duplicate embeddings: int8 tile products with error bounds, full precision for what may pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import components, drop, keep

THRESHOLD = 0.98
BLOCK = 2048
STRIP = 256
SLACK = 1e-9
TIE = 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32 whole numbers, scale, norm of scale * codes, norm of the remainder) of unit vectors.

    With x = s q + e: |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |y|, and |y| = 1.
    """
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: pieces of 1,024 dimensions stay below 2**24 in single precision."""
    return sum((a[:, k:k + 1024] @ b[:, k:k + 1024].T).astype(np.float64) for k in range(0, a.shape[1], 1024))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of unit vectors with product >= threshold in double precision.

    Every pair is decided by one sum, in one order, whatever its neighbours: where very many pairs are possible, a
    matrix product settles those that are further than TIE from the threshold, more than the two can differ.
    """
    qx, sx, nx, ex = quantise(x)
    qy, sy, _, ey = quantise(y)
    out = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), STRIP):
        s = slice(at, at + STRIP)
        may = code_products(qx[s], qy) * np.outer(sx[s], sy) + (np.outer(nx[s], ey) + ex[s, None] + SLACK) >= threshold
        if np.count_nonzero(may) > may.size // 16:
            product = x[s] @ y.T
            out[s] = may & (product >= threshold)
            may &= np.abs(product - threshold) <= TIE
        i, j = np.nonzero(may)
        for k in range(0, len(i), 1 << 15):
            p, q = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
            out[at + p, q] = np.einsum("nd,nd->n", x[at + p], y[q]) >= threshold
    return out


def spanning_edges(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) of a spanning forest of a symmetric boolean matrix."""
    left, us, vs = np.ones(len(links), bool), [], []
    for first in np.flatnonzero(links.any(axis=1)):
        if not left[first]:
            continue
        left[first], stack = False, [first]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(links[at] & left)
            left[found] = False
            us.append(np.full(len(found), at))
            vs.append(found)
            stack.extend(found.tolist())
    none = np.empty(0, np.int64)
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(threshold: float):
    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (u, null, links) and spanning edges (u, v, 0) of one pair of blocks."""
        a, b = key[2], key[3]
        x = _units(pdf["vector"])
        ids, copies, mine = pdf["rid"].to_numpy(), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        links = np.zeros((len(x), len(x)), bool)
        if a == b:
            links[:] = tile_links(x, x, threshold)
            links |= links.T
            np.fill_diagonal(links, False)
        else:
            p, q = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
            if len(p) and len(q):
                found = tile_links(x[p], x[q], threshold)
                links[np.ix_(p, q)] = found
                links[np.ix_(q, p)] = found.T
        counts = links @ copies
        some = np.flatnonzero(counts)
        u, v = spanning_edges(links)
        return pd.DataFrame({
            "u": np.concatenate((ids[some], ids[u])),
            "v": pd.array(np.concatenate((np.zeros(len(some), np.int64), ids[v])), dtype="Int64"),
            "n": np.concatenate((counts[some], np.zeros(len(u), np.int64))).astype(np.int64),
        }).assign(v=lambda d: d["v"].mask(np.arange(len(d)) < len(some)))
    return meet


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors link when their labels (and lengths) are equal and not null and their cosine is at least
    ``threshold``; null, empty and zero vectors and those with null or non-finite components link with
    nothing. Equal vectors are one class with a count, so copies cost nothing more; classes are dealt
    into blocks of about 2,048 by label, every two blocks of a label meet once in a task, which gives
    link counts and a spanning forest, never the pairs. A null id is never the smallest; a component
    of null ids only is null. Repeated rows are vectors of their own; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = (F.col("label").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda v: v != 0)
              & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    classes = keep(rows.where(usable).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("own"))
                   .withColumn("rid", F.monotonically_increasing_id()).withColumn("d", F.size("vector")), "vectors")
    sizes = keep(classes.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    cells = (classes.join(sizes, ["label", "d"]).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "d", "rid", "copies", "vector", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")))
    found = keep(cells.groupBy("label", "d", "a", "b").applyInPandas(_meet(threshold), "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("rid")).agg(F.sum("n").alias("links"))
    roots = keep(components(found.where("v is not null").select("u", "v")), "components")
    named = (classes.select("label", "vector", "rid", "copies", "own")
             .join(counts, "rid", "left").join(roots, F.col("rid") == roots["node"], "left")
             .select("label", "vector", "own", F.coalesce("component", "rid").alias("root"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    named = keep(named, "named")
    firsts = keep(named.groupBy("root").agg(F.min("own").alias("first")), "firsts")
    classed = keep(named.join(firsts, "root").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "n_links", "first"), "classed")
    for t in (classes, sizes, found, roots, named, firsts):
        drop(t)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return (rows.join(classed, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.col("vec_id").eqNullSafe(component).alias("kept")))
