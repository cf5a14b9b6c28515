"""Embedding tables: neighbours, centroids, covariance alignment, silhouette, scaling, inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.functions.scalars import as_doubles, bind, dot, is_finite, l2norm
from tilescope.operators.blocks import best_possible, block_pairs, hottest_share, matrix, pack, pack_blocks, pack_near, seed_rows, single_error, unit_rows, unpack, wire_type
from tilescope.session import cut_lineage, small_side

OPEN_BLOCKS = 32


def check_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive integer")
    return k


def knn_join(queries: DataFrame, refs: DataFrame, k: int, id_col: str = "vec_id", label: str = "label",
             keys: list[str] = (), skipped=None) -> DataFrame:
    """Exact top-k cosine neighbours: (keys, id, ref_id, ref_label, sim, rank).

    Similarities are rounded to 12 decimals and ties go to the lowest reference id. Blocks hold vectors of like
    directions; each task keeps k candidates per query over the blocks it meets, looks at those only that reach a query's k-th so far
    by a product in single precision and its error bound, takes their similarities in double precision,
    and skips a block whose best possible similarity is below what the k-th neighbour of every query of the block is known to reach. A window with a group
    limit merges tasks. ``skipped``, an accumulator pair (all, skipped), counts block pairs.
    """
    check_k(k)
    keys = list(keys)
    kinds = dict(queries.dtypes)
    seeds = queries.sparkSession.sparkContext.broadcast(seed_rows(refs, keys, id_col))  # SEEDS vectors
    share, rows = hottest_share(seeds), (queries.count(), refs.count())
    left = pack_near(queries, keys, id_col, label, seeds, k, times=pack_blocks(share, rows[0]))
    pairs = block_pairs(left, pack_near(refs, keys, id_col, label, seeds, times=pack_blocks(share, rows[1])), keys, share, rows)
    wire_l, wire_r = wire_type(queries), wire_type(refs)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"{id_col} bigint, ref_id bigint, ref_label bigint, sim double"])

    class Best:
        """The k best of every query of a block so far: rounded similarities down, ids up."""

        def __init__(self, ids, m, floors):
            self.ids, self.unit = ids, unit_rows(m)
            self.single = self.unit.astype(np.float32)
            self.state, self.waiting = [], 0
            self.edge = np.where(floors > -2.0, floors, -np.inf)  # what the k-th reaches, by the seeds and so far

        def meet(self, unit, single, ids, codes):
            sims, slack = self.single @ single.T, single_error(unit.shape[1])
            reach = self.edge
            if np.isinf(reach).any():  # the k best of these are enough
                at = min(k, sims.shape[1]) - 1
                reach = np.fmax(reach, -np.partition(-sims, at, axis=1)[:, at] - slack)
            low = reach - 2e-12  # more than rounding moves two apart
            row, col = np.divmod(np.flatnonzero(sims >= (low - slack).astype(np.float32)[:, None]), sims.shape[1])
            if not len(row):
                return
            exact = np.einsum("ij,ij->i", self.unit[row], unit[col]) if len(row) * 64 < sims.size else (self.unit @ unit.T)[row, col]
            some = exact >= low[row]
            row, col = row[some], col[some]
            self.state.append((row, np.round(exact[some], 12), ids[col], codes[col]))
            self.waiting += len(row)
            if self.waiting >= k * len(self.ids):
                self.trim()

        def trim(self):
            if not self.state:
                return np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            row, sim, ids, codes = (np.concatenate(c) for c in zip(*self.state))
            order = np.lexsort((ids, -sim, row))
            row, sim, ids, codes = row[order], sim[order], ids[order], codes[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, sim, ids, codes = row[keep], sim[keep], ids[keep], codes[keep]
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            self.edge[row[last]] = np.maximum(self.edge[row[last]], sim[last])
            self.state, self.waiting = [(row, sim, ids, codes)], 0
            return self.state[0]

    def bounds(sizes, centres, radii):
        """The blocks of a pack: (rows of each, centres, radii)."""
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        return [slice(i, j) for i, j in zip(cuts, cuts[1:])], np.frombuffer(centres).reshape(len(cuts) - 1, -1), np.frombuffer(radii)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_packs: dict = {}

        def opened(r, blocks):
            ids, _, m = unpack(r.n_l, r.ids_l, r.codes_l, r.mat_l, wire_l)
            floors = np.frombuffer(r.floors_l)
            return [Best(ids[b], m[b], floors[b]) for b in blocks]

        def flush(name):
            for best in open_packs.pop(name):
                row, sim, ids, codes = best.trim()
                yield pd.DataFrame({**{c: v for c, v in zip(keys, name[1:])}, id_col: best.ids[row], "ref_id": ids,
                                    "ref_label": codes, "sim": sim}, columns=[*keys, id_col, "ref_id", "ref_label", "sim"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                name = (r.block_l, *[getattr(r, c) for c in keys])
                own, *near_l = bounds(r.sizes_l, r.centres_l, r.radii_l)
                other, *near_r = bounds(r.sizes_r, r.centres_r, r.radii_r)
                if name not in open_packs:
                    if sum(map(len, open_packs.values())) >= OPEN_BLOCKS:
                        yield from flush(next(iter(open_packs)))
                    open_packs[name] = opened(r, own)
                bests, most, whole = open_packs[name], best_possible(*near_l, *near_r), None
                for j, b in enumerate(other):
                    floors = np.array([best.edge.min() for best in bests])
                    skip = most[:, j] < floors - 1e-7  # more than rounding, and than the norms' distance from 1
                    if skipped is not None:
                        skipped[0].add(len(skip))
                        skipped[1].add(int(skip.sum()))
                    if skip.all():
                        continue
                    ids, codes, m = whole = whole or unpack(r.n_r, r.ids_r, r.codes_r, r.mat_r, wire_r)
                    unit = unit_rows(m[b])
                    single = unit.astype(np.float32)
                    for i in np.flatnonzero(~skip):
                        bests[i].meet(unit, single, ids[b], codes[b])
        for name in list(open_packs):
            yield from flush(name)

    found = pairs.mapInPandas(run, schema)
    w = Window.partitionBy(*keys, id_col).orderBy(F.desc("sim"), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_vote(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label per query, lowest class on equal votes, with its vote share."""
    votes = neighbours.groupBy(*keys, "ref_label").agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(*keys).agg(
        F.max_by("ref_label", F.struct(F.col("_v"), -F.col("ref_label"))).alias("pred"),
        (F.max("_v") / F.sum("_v")).alias("share"))


def knn_classify(train: DataFrame, test: DataFrame, k: int, id_col: str = "vec_id", keys: list[str] = ()) -> DataFrame:
    """Test rows (keys, id, label) with ``pred``. An empty training set is an error inside the job."""
    keys = list(keys)
    pred = knn_vote(knn_join(test, train, k, id_col, keys=keys), [*keys, id_col])
    fail = F.raise_error(F.lit("kNN requires nonempty training features")).cast("bigint")
    return test.select(*keys, id_col, "label").join(pred, [*keys, id_col], "left").withColumn(
        "pred", F.coalesce("pred", fail))


# ---- means, scaling, centroids ----------------------------------------------------------------

def vector_stats(df: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """(keys, n, mean, var) with sample variances, combined map-side on the JVM."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(as_doubles(f)))
    out = df.groupBy(*keys).agg(s.alias("_s")) if keys else df.agg(s.alias("_s"))
    return out.select(*keys, F.col("_s.count").alias("n"), vector_to_array("_s.mean").alias("mean"),
                      vector_to_array("_s.variance").alias("var"))


def standardize(df: DataFrame, train: DataFrame, keys: list[str] = (), f: str = "f") -> DataFrame:
    """(x - mean) / population SD of the training rows; constant columns are only centred."""
    keys = list(keys)
    st = vector_stats(train, keys, f)
    sd = F.transform("var", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")))
    st = st.select(*keys, F.struct("mean", F.transform(sd, lambda s: F.when(s > 0, s).otherwise(1.0)).alias("sd")).alias("_st"))
    rows = df.join(small_side(st), keys) if keys else df.withColumn("_st", st.scalar())
    centred = F.zip_with(f, F.col("_st.mean"), lambda x, m: x.cast("double") - m)
    return rows.withColumn(f, F.zip_with(centred, F.col("_st.sd"), lambda x, s: x / s)).drop("_st")


def centroid_distances(df: DataFrame, domain: str, a, b, k: int, f: str = "f") -> DataFrame:
    """L2 distance of class means between two domains; NULL when a class is missing on a side."""
    st = vector_stats(df.where(F.col(domain).isin(a, b) & F.col("label").between(0, k - 1)), [domain, "label"], f)
    at = lambda d: F.max_by("mean", F.when(F.col(domain) == d, 1))
    both = st.groupBy("label").agg(at(a).alias("_a"), at(b).alias("_b"), F.count(F.lit(1)).alias("_sides"))
    gap = F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y))
    dist = F.when(F.col("_sides") == 2, F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    return every.join(both.select("label", dist.alias("distance")), "label", "left")


def mean_distance(distances: DataFrame) -> DataFrame:
    return distances.agg(F.avg("distance").alias("mean_distance"), F.count("distance").alias("classes"))


def silhouette(df: DataFrame, f: str = "f", label: str = "label") -> DataFrame:
    """Exact mean cosine silhouette in one pass over rows: a unit vector's mean distance to a class is
    one minus its product with that class's mean unit vector. Fewer than two classes gives 0."""
    unit = df.select(F.col(label).alias("_y"), l2norm(f, 0.0).alias("_u"))
    sums = Summarizer.metrics("count", "sum").summary(array_to_vector("_u"))
    cls = unit.groupBy("_y").agg(sums.alias("_s")).select(
        "_y", F.col("_s.count").alias("n"), vector_to_array("_s.sum").alias("s"))
    table = cls.agg(F.collect_list(F.struct("_y", "n", "s")).alias("t"))  # one entry per class
    prod = bind(F.col("_u"), lambda u: F.transform("_t", lambda c: F.struct(
        c["_y"].alias("y"), c["n"].alias("n"), dot(u, c["s"]).alias("p"))))
    rows = unit.withColumn("_t", table.scalar()).select("_y", prod.alias("_p"))
    own = F.filter("_p", lambda c: c["y"] == F.col("_y"))[0]
    other = F.array_min(F.transform(F.filter("_p", lambda c: c["y"] != F.col("_y")), lambda c: 1.0 - c["p"] / c["n"]))
    a = F.try_divide(own["n"] - own["p"], (own["n"] - 1).cast("double"))
    s = rows.select(own["n"].alias("n"), a.alias("a"), other.alias("b"))
    value = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.agg(F.coalesce(F.avg(F.when(F.col("b").isNotNull(), value)), F.lit(0.0)).alias("silhouette"),
                 F.count(F.lit(1)).alias("n"))


# ---- covariance alignment -----------------------------------------------------------------------

#: Columns of a Gram matrix that travel together, and the bytes of matrices a task holds before it hands them on.
GRAM_COLUMNS = 128
GRAM_BYTES = 64 << 20


def covariance_rows(df: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """Sample covariance as rows (keys, i, cov array); NULL entries for a key of one row.

    One pass: tasks add products of rows less one common vector, a row of the data, and hand them on in pieces of GRAM_COLUMNS
    columns keyed by (key, row, first column), with the sums of the rows; Spark adds those. The covariance is the products less those of
    the sums, divided by n - 1. No mean has to be known before, and a task holds GRAM_BYTES of matrices or one of them.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    one = df.select(f).first()
    if one is None:
        return df.select(*keys, F.lit(0).alias("i"), F.array().cast("array<double>").alias("cov")).where("false")
    common = np.asarray(one[f], dtype=np.float64)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "i int, at int, n bigint, part array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}

        def hand_on():
            for key, (n, sums, gram) in acc.items():
                rows = np.concatenate([sums[None], gram])  # row -1 holds the sums
                for at in range(0, len(sums), GRAM_COLUMNS):
                    yield pd.DataFrame({**{k: [v] * len(rows) for k, v in zip(keys, key)}, "i": np.arange(-1, len(gram)), "at": at, "n": n, "part": list(rows[:, at:at + GRAM_COLUMNS])})
            acc.clear()

        for pdf in batches:
            for key, rows in (pdf.groupby(keys, sort=False) if keys else [((), pdf)]):
                x = matrix(rows[f]) - common
                n, sums, gram = acc.get(tuple(key), (0, 0.0, 0.0))
                acc[tuple(key)] = n + len(x), sums + x.sum(axis=0), gram + x.T @ x
                if len(acc) * common.nbytes * len(common) > GRAM_BYTES:
                    yield from hand_on()
        yield from hand_on()

    added = Summarizer.sum(array_to_vector("part"))
    total = cut_lineage(df.select(*keys, f).mapInPandas(run, schema).groupBy(*keys, "i", "at").agg(F.sum("n").alias("n"), vector_to_array(added).alias("part")))
    whole = lambda rows, by: rows.groupBy(*by).agg(F.first("n").alias("n"), F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("row"))
    sums = whole(total.where("i < 0"), keys).select(*keys, F.col("row").alias("_s"))
    rows = whole(total.where("i >= 0"), [*keys, "i"])
    rows = rows.join(sums, keys) if keys else rows.withColumn("_s", sums.scalar())
    own = F.element_at("_s", F.col("i") + 1)
    return rows.select(*keys, "i", F.zip_with("row", "_s", lambda g, s: F.try_divide(g - own * s / F.col("n"), (F.col("n") - 1).cast("double"))).alias("cov"))


@dataclass(frozen=True)
class Coral:
    """Means and the d x d alignment matrix between two domains."""

    source_mean: np.ndarray
    target_mean: np.ndarray
    alignment: np.ndarray


def coral_fit(df: DataFrame, domain: str, source, target, reg: float = 1.0, f: str = "f") -> Coral:
    """Inverse root of the source covariance times root of the target's; eigenvalues floored at ``reg``.

    Only two d-vectors and two d x d matrices reach the driver.
    """
    both = df.where(F.col(domain).isin(source, target))
    means = {r[domain]: np.asarray(r["mean"]) for r in vector_stats(both, [domain], f).collect()}
    cov: dict = {}
    for r in covariance_rows(both, [domain], f).orderBy("i").collect():
        cov.setdefault(r[domain], []).append(r["cov"])

    def root(c, power):
        c = np.asarray(c) + reg * np.eye(len(c))
        values, vectors = np.linalg.eigh(c)
        return (vectors * np.maximum(values, reg) ** power) @ vectors.T
    return Coral(means[source], means[target], root(cov[source], -0.5) @ root(cov[target], 0.5))


def coral_transform(f: str, model: Coral) -> Column:
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list((matrix(values) - model.source_mean) @ model.alignment + model.target_mean))
    return run(F.col(f))


def coral_distance(df: DataFrame, domain: str, a, b, f: str = "f") -> DataFrame:
    """Squared Frobenius distance of covariances over 4 d squared."""
    rows = covariance_rows(df.where(F.col(domain).isin(a, b)), [domain], f)
    at = lambda d: F.max_by("cov", F.when(F.col(domain) == d, 1))
    both = rows.groupBy("i").agg(at(a).alias("_a"), at(b).alias("_b"))
    gap = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.agg((F.sum(gap) / (4.0 * F.pow(F.count(F.lit(1)), 2))).alias("coral_distance"))


# ---- outlier score --------------------------------------------------------------------------------

def class_moments(df: DataFrame, cols: list[str], cls: str, ridge: float = 1e-6) -> DataFrame:
    """(cls, _m0.._m2, _a, _b, _c, _d, _e, _g): mean and upper triangle of the covariance of three columns per class.

    Classes under two rows have zero mean and identity.
    """
    x, y, z = cols
    cov = lambda a, b: F.covar_samp(a, b) + (ridge if a == b else 0.0)
    entries = {"a": (x, x), "b": (x, y), "c": (x, z), "d": (y, y), "e": (y, z), "g": (z, z)}
    st = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                             *[cov(*pair).alias(f"_{n}") for n, pair in entries.items()])
    few = F.col("_n") < 2
    return st.select(cls, *[F.when(few, 0.0).otherwise(F.col(f"_m{i}")).alias(f"_m{i}") for i in range(3)],
                     *[F.when(few, 1.0 if n in "adg" else 0.0).otherwise(F.col(f"_{n}")).alias(f"_{n}") for n in entries])


def supplied_moments(table: DataFrame, cls: str, mean: str = "mean", cov: str = "cov") -> DataFrame:
    """The moments table from (cls, mean array of 3, covariance array of 3 arrays of 3)."""
    at = {"a": (0, 0), "b": (0, 1), "c": (0, 2), "d": (1, 1), "e": (1, 2), "g": (2, 2)}
    return table.select(cls, *[F.col(mean)[i].cast("double").alias(f"_m{i}") for i in range(3)],
                        *[F.col(cov)[i][j].cast("double").alias(f"_{n}") for n, (i, j) in at.items()])


def mahalanobis(df: DataFrame, cols: list[str], cls: str, ridge: float = 1e-6, moments: DataFrame | None = None) -> DataFrame:
    """Distance of three columns from their class, by the closed-form inverse of a 3 x 3 covariance.

    ``moments`` (from ``supplied_moments``) takes the place of the rows' own; rows of a class it does
    not have get a NULL score. A singular matrix falls back to Euclidean.
    """
    st = class_moments(df, cols, cls, ridge) if moments is None else moments
    entries = "abcdeg"
    a, b, c, d, e, g = (F.col(f"_{n}") for n in entries)
    det = a * (d * g - e * e) - b * (b * g - c * e) + c * (b * e - c * d)
    u, v, w = (F.col(n) - F.col(f"_m{i}") for i, n in enumerate(cols))
    quad = (u * u * (d * g - e * e) + v * v * (a * g - c * c) + w * w * (a * d - b * b)
            + 2 * u * v * (c * e - b * g) + 2 * u * w * (b * e - c * d) + 2 * v * w * (b * c - a * e))
    score = F.sqrt(F.coalesce(F.try_divide(quad, F.when(det != 0, det)), u * u + v * v + w * w))
    return df.join(small_side(st), cls, "left").withColumn("score", score).drop(*[f"_m{i}" for i in range(3)], *[f"_{n}" for n in entries])


# ---- inference ------------------------------------------------------------------------------------

def embed_tiles(tiles: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], h: int, w: int,
                batch: int = 256, px: str = "px") -> DataFrame:
    """Add ``f``: a user model applied to batches of (n, h*w) pixels; loaded once per Python worker."""
    run = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[h * w]])
    return tiles.withColumn("f", run(px))


def random_projection(h: int, w: int, dim: int, seed: int = 42):
    """Seeded control model: fixed Gaussian projection and a tanh."""
    def make():
        weights = np.random.default_rng(seed).standard_normal((h * w, dim)) / np.sqrt(h * w)
        return lambda x: np.tanh(np.asarray(x, dtype=np.float64) @ weights / 255.0).astype(np.float32)
    return make


def feature_faults(features: DataFrame, dim: int, expected: DataFrame, id_col: str = "vec_id", f: str = "f") -> DataFrame:
    """(id, reason) for every fault of a feature table: repeated, size, not_finite, unexpected and missing IDs.

    One aggregate by ID and one full join with the expected IDs (column ``id_col``, each once); NULL
    vectors count as a wrong size. A complete table gives no row.
    """
    bad = ~F.forall(f, lambda v: v.isNotNull() & is_finite(v))
    ids = features.groupBy(F.col(id_col).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.size(f) != dim, F.lit(True))).alias("_s"), F.count_if(bad).alias("_b"))
    want = expected.select(F.col(id_col).alias("_want"), F.lit(True).alias("_expected"))
    faults = F.filter(F.array(F.when(F.col("_n") > 1, "repeated"), F.when(F.col("_s") > 0, "size"), F.when(F.col("_b") > 0, "not_finite"),
                              F.when(F.col("_expected").isNull(), "unexpected"), F.when(F.col("_n").isNull(), "missing")), lambda r: r.isNotNull())
    return (ids.join(want, F.col("_id").eqNullSafe(F.col("_want")), "full")
            .select(F.coalesce("_id", "_want").alias(id_col), F.explode(faults).alias("reason")))


def require_features(features: DataFrame, dim: int, expected: DataFrame, id_col: str = "vec_id", f: str = "f") -> DataFrame:
    """The feature table; the returned plan raises before its first row if there is any fault."""
    worst = feature_faults(features, dim, expected, id_col, f).agg(F.min(F.struct("reason", F.col(id_col).cast("string").alias("id"))).alias("w"))
    found = worst.select("w").scalar()
    fail = F.raise_error(F.concat(F.lit("feature table refused: "), found["reason"], F.lit(" "), F.coalesce(found["id"], F.lit("null"))))
    return features.where(F.when(found.isNull(), True).otherwise(fail.cast("boolean")))


def feature_checks(features: DataFrame, dim: int, id_col: str = "vec_id", f: str = "f") -> DataFrame:
    """Counts of rows, repeated IDs, wrong sizes and non-finite vectors."""
    bad = ~F.forall(f, is_finite)
    ids = features.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(f) != dim).alias("s"), F.count_if(bad).alias("b"))
    return ids.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("s").alias("wrong_size"), F.sum("b").alias("not_finite"))
