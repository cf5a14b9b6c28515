"""Domain-gap statistics: maximum mean discrepancy in several forms and the proxy A-distance.

Estimates read every row unless the caller asks for a seeded sample; kernel sums over whole tables go
through the block grid, every two blocks once. Only the median bandwidth always comes from a sample, of BANDWIDTH_ROWS rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilescope.operators import blocks
from tilescope.operators.blocks import half_pairs, matrix, pack, unpack, wire_type
from tilescope.operators.embedding import standardize, vector_stats
from tilescope.operators.fit import few_partitions
from tilescope.operators.ordering import hash_rank, hash_sample
from tilescope.session import cut_lineage, small_side

#: Rows whose pairwise distances give the median bandwidth, a heuristic constant of the kernel.
BANDWIDTH_ROWS = 2000
#: Blocks travel in packs of so many, since a pair of packs holds the square of their pairs, and are multiplied one by one.
TIMES = 8
#: The exact median over all pairs: quantiles of a sample's distances between which it is looked for first, steps of a
#: histogram, and distances that the last pass hands to the driver at most.
BETWEEN = (0.46, 0.54)
STEPS = 1 << 16
LAST_DISTANCES = 1 << 19
#: Squared norms times gamma up to which exponents come from one product; their error is about 1e-15 times that.
WIDEST = 1e3
#: Rows of each domain that an estimate needs.
LEAST_ROWS = {"biased": 1, "unbiased": 2}


def mmd_linear(df: DataFrame, domain: str, a, b, unbiased: bool = False, f: str = "f") -> DataFrame:
    """Squared norm of the mean difference; the unbiased form subtracts the variance terms."""
    st = vector_stats(df.where(F.col(domain).isin(a, b)), [domain], f)
    at = lambda d: F.max_by(F.struct("n", "mean", "var"), F.when(F.col(domain) == d, 1))
    both = st.agg(at(a).alias("a"), at(b).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    value = total(F.zip_with("a.mean", "b.mean", lambda x, y: (x - y) * (x - y)))
    if unbiased:
        value = value - total("a.var") / F.col("a.n") - total("b.var") / F.col("b.n")
    return both.select(value.alias("mmd2"))


def equal_samples(df: DataFrame, domain: str, a, b, seed, id_col: str, max_samples: int) -> DataFrame:
    """The same number of seeded rows from both domains; two counts that stop at ``max_samples``."""
    left, right = df.where(F.col(domain) == a), df.where(F.col(domain) == b)
    n = min(left.limit(max_samples).count(), right.limit(max_samples).count())
    if n < 1:
        raise ValueError(f"a sample of {a} and {b} needs at least one row of each")
    return hash_sample(left, n, seed, [id_col]).unionByName(hash_sample(right, n, seed, [id_col]))


def _finite(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("a feature vector holds NULL, NaN or an infinite value")
    return x


def _squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products where they are accurate; pairs much closer than the cloud is wide are taken by direct differences."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d = x @ y.T
    d *= -2.0
    d += nx[:, None]
    d += ny
    np.maximum(d, 0.0, out=d)
    if not d.size or d.min() >= 1e-6 * (nx.max() + ny.max()):  # no pair is close
        return d
    i, j = np.nonzero(d < 1e-6 * (nx[:, None] + ny))
    for k in range(0, len(i), 1 << 14):
        p, q = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)
    return d


def _median_gamma(x: np.ndarray) -> float:
    upper = np.triu_indices(len(x), 1)
    d = _squared_distances(x, x)[upper]
    d = d[d > 0]
    return 1.0 / float(np.median(d)) if d.size else 1.0


def median_gamma(sample: DataFrame, seed, id_col: str, f: str = "f", max_rows: int | None = BANDWIDTH_ROWS) -> DataFrame:
    """1 / median positive squared distance over at most ``max_rows`` seeded rows, one bounded group; over all rows if it is None."""
    if max_rows is None:
        return sample.sparkSession.range(1).select(F.lit(exact_median_gamma(sample, id_col, f)).alias("gamma"))
    rows = hash_sample(sample, max_rows, seed, [id_col]).select(f).withColumn("_all", F.lit(1))
    return rows.groupBy("_all").applyInPandas(
        lambda pdf: pd.DataFrame({"gamma": [_median_gamma(_finite(matrix(pdf[f])))]}), "gamma double")


def _bits(value: float) -> int:
    """Positive doubles order like their bits."""
    return int(np.array([value], np.float64).view(np.int64)[0])


def _packs(r, wire: type) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of both packs of a pair."""
    return tuple(_finite(unpack(*side, wire)[2]) for side in ((r.n_l, r.ids_l, r.codes_l, r.mat_l), (r.n_r, r.ids_r, r.codes_r, r.mat_r)))


def _tiles(r, n: int, m: int, size: int) -> Iterator[tuple[slice, slice]]:
    """(rows of the left, of the right) of a pair of packs by ``size`` rows; of a pack with itself those with left <= right."""
    for i in range(0, n, size):
        for j in range(i if r.block_l == r.block_r else 0, m, size):
            yield slice(i, i + size), slice(j, j + size)


def _pair_bits(r, size: int, wire: type) -> Iterator[np.ndarray]:
    """Bits of the squared distances of a pair of packs, of a pack with itself those of its pairs once."""
    x, y = _packs(r, wire)
    for p, q in _tiles(r, len(x), len(y), size):
        d = _squared_distances(x[p], y[q])
        yield (d[np.triu_indices(len(d), 1)] if r.block_l == r.block_r and p == q else d.ravel()).view(np.int64)


def _count_between(pairs: DataFrame, low: int, high: int, wire: type) -> tuple[int, int, np.ndarray, int]:
    """(positive distances, those below ``low``, counts in STEPS steps from ``low`` to ``high``, width of a step), all in bits."""
    width, size = -(-(high - low + 1) // STEPS), blocks.BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(STEPS + 2, np.int64)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for bits in _pair_bits(r, size, wire):
                    none = np.count_nonzero(bits <= 0)
                    n[STEPS] += len(bits) - none
                    n[STEPS + 1] += np.count_nonzero(bits < low) - none
                    n[:STEPS] += np.bincount((bits[(bits >= low) & (bits <= high)] - low) // width, minlength=STEPS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"step": at, "n": n[at]})

    n = np.zeros(STEPS + 2, np.int64)
    for r in pairs.mapInPandas(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        n[r.step] = r.n
    return int(n[STEPS]), int(n[STEPS + 1]), n[:STEPS], width


def _distances_between(pairs: DataFrame, spans: list[tuple[int, int]], wire: type) -> DataFrame:
    """(bits, n): the distances whose bits lie in one of ``spans``, equal ones counted."""
    size = blocks.BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                some = [bits[(bits >= low) & (bits <= high)] for bits in _pair_bits(r, size, wire) for low, high in spans]
                bits, n = np.unique(np.concatenate(some), return_counts=True)
                if len(bits):
                    yield pd.DataFrame({"bits": bits, "n": n})

    return pairs.mapInPandas(run, "bits bigint, n bigint").groupBy("bits").agg(F.sum("n").alias("n"))


def _middle_distances(pairs: DataFrame, low: float, high: float, wire: type) -> list[float]:
    """The middle two of the positive squared distances over half block pairs, none if there are none; exact.

    A pass counts distances in equal steps between two bounds, at first the guess ``low`` to ``high`` (all if it misses), then the
    step with the middle. Once few enough are in it they go to the driver; distances are never stored. With a good
    guess that is two passes for up to 900,000 rows, and one more for every 65,536-fold of pairs.
    """
    everything = (1, _bits(np.inf))
    low, high = (_bits(low), _bits(high)) if 0 < low <= high else everything
    while True:
        total, below, counts, width = _count_between(pairs, low, high, wire)
        if not total:
            return []
        upto = np.cumsum(counts)
        ranks = [(total - 1) // 2 - below, total // 2 - below]
        if (ranks[0] < 0 or ranks[1] >= upto[-1]) and (low, high) != everything:
            low, high = everything
            continue
        steps = [int(np.searchsorted(upto, r, side="right")) for r in ranks]
        spans = [(low + k * width, min(high, low + (k + 1) * width - 1)) for k in steps]
        value = lambda bits: float(np.array([bits], np.int64).view(np.float64)[0])
        if steps[0] < steps[1]:  # the last of one step and the first of another
            ends = [_distances_between(pairs, [s], wire).agg(f("bits")).first()[0] for s, f in zip(spans, (F.max, F.min))]
            return [value(b) for b in ends]
        low, high = spans[0]
        if low == high:
            return [value(low)] * 2
        if counts[steps[0]] <= LAST_DISTANCES:
            found = _distances_between(pairs, spans[:1], wire).toPandas().sort_values("bits")
            own = found["n"].cumsum().to_numpy()
            before = int(upto[steps[0] - 1]) if steps[0] else 0
            return [value(found["bits"].iloc[min(int(np.searchsorted(own, r - before, side="right")), len(own) - 1)]) for r in ranks]


def _guess(df: DataFrame, id_col: str, f: str) -> tuple[float, float]:
    """The BETWEEN quantiles of the distances of BANDWIDTH_ROWS seeded rows, a bounded group; zeros if there are none."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _finite(matrix(pdf[f]))
        d = _squared_distances(x, x)[np.triu_indices(len(x), 1)]
        low, high = np.quantile(d[d > 0], BETWEEN) if (d > 0).any() else (0.0, 0.0)
        return pd.DataFrame({"low": [low], "high": [high]})

    rows = hash_sample(df, BANDWIDTH_ROWS, 0, [id_col]).select(f).withColumn("_all", F.lit(1))
    found = rows.groupBy("_all").applyInPandas(run, "low double, high double").first()
    return (found["low"], found["high"]) if found else (0.0, 0.0)


def exact_median_gamma(df: DataFrame, id_col: str, f: str = "f") -> float:
    """1 / median positive squared distance over all pairs of rows, 1 if no two differ. A sample only says where to look; nothing quadratic is kept."""
    packed = cut_lineage(pack(df.withColumn("_none", F.lit(0)), [], id_col, "_none", f, times=TIMES))
    middle = _middle_distances(half_pairs(packed), *_guess(df, id_col, f), wire_type(df, f))
    return 1.0 / (sum(middle) / 2) if middle else 1.0


def _exponent_factors(x: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(a, b) with a @ b.T = -gamma times the squared distances, so that a kernel is a product and its exponential; none where
    the vectors are so wide against the bandwidth that the product would lose digits."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    nx, ny = gamma * (x * x).sum(axis=1), gamma * (y * y).sum(axis=1)
    if not abs(nx).max() + abs(ny).max() <= WIDEST:
        return None
    return np.column_stack([2.0 * gamma * x, -nx, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), -ny])


def kernel_sums(df: DataFrame, gamma: DataFrame, group: str, id_col: str, f: str = "f") -> DataFrame:
    """Sums of the RBF kernel over all ordered row pairs by group pair: (group_a, group_b, total).

    ``gamma`` is one row. Every two blocks meet once and count for both orders. Tasks add up per group pair and emit one row for each.
    """
    packed = cut_lineage(pack(df, [], id_col, group, f, times=TIMES))
    pairs, size, wire = half_pairs(packed).withColumn("gamma", gamma.scalar()), blocks.BLOCK, wire_type(df, f)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ga, gb = np.frombuffer(r.codes_l, np.int64), np.frombuffer(r.codes_r, np.int64)
                x, y = _packs(r, wire)
                factors = _exponent_factors(x, y, r.gamma)
                for p, q in _tiles(r, len(x), len(y), size):
                    kern = -r.gamma * _squared_distances(x[p], y[q]) if factors is None else factors[0][p] @ factors[1][q].T
                    np.exp(kern, out=kern)
                    ua, ia = np.unique(ga[p], return_inverse=True)
                    ub, ib = np.unique(gb[q], return_inverse=True)
                    sums = np.eye(len(ua))[ia].T @ kern @ np.eye(len(ub))[ib]
                    for i, u in enumerate(ua):
                        for j, v in enumerate(ub):
                            acc[(u, v)] = acc.get((u, v), 0.0) + sums[i, j]
                            if r.block_l != r.block_r or p != q:
                                acc[(v, u)] = acc.get((v, u), 0.0) + sums[i, j]
        if acc:
            yield pd.DataFrame([(int(u), int(v), t) for (u, v), t in acc.items()], columns=["group_a", "group_b", "total"])

    return (pairs.mapInPandas(run, "group_a bigint, group_b bigint, total double")
            .groupBy("group_a", "group_b").agg(F.sum("total").alias("total")))


def mmd_rbf(df: DataFrame, domain: str, a, b, id_col: str, gamma: DataFrame | None = None, estimator: str = "biased",
            seed=0, max_samples: int | None = None, f: str = "f") -> DataFrame:
    """One row mmd2, gamma: V-statistic (clipped at zero) or U-statistic over every row of both domains,
    or over equal seeded samples of at most ``max_samples`` each. Non-finite features, a domain without
    rows and a U-statistic of fewer than two raise inside the job."""
    return mmd_rbf_forms(df, domain, a, b, id_col, gamma, (estimator,), seed, max_samples, f).drop("form")


def mmd_rbf_forms(df: DataFrame, domain: str, a, b, id_col: str, gamma: DataFrame | None = None, estimators: tuple[str, ...] = ("biased", "unbiased"),
                  seed=0, max_samples: int | None = None, f: str = "f") -> DataFrame:
    """As ``mmd_rbf``, a row for each estimator with its name as ``form``; the kernel is summed once for all."""
    for e in estimators:
        if e not in LEAST_ROWS:
            raise ValueError(f"unknown estimator {e!r}; use biased or unbiased")
    rows = df.where(F.col(domain).isin(a, b)) if max_samples is None else equal_samples(df, domain, a, b, seed, id_col, max_samples)
    gamma = median_gamma(rows, seed, id_col, f) if gamma is None else gamma
    side = F.when(F.col(domain) == a, 0).otherwise(1)
    rows = rows.withColumn("_side", side)
    sums = kernel_sums(rows, gamma, "_side", id_col, f)
    at = lambda i, j: F.sum(F.when((F.col("group_a") == i) & (F.col("group_b") == j), F.col("total")))
    k = sums.agg(at(0, 0).alias("ss"), at(1, 1).alias("tt"), at(0, 1).alias("st"))
    n = rows.agg(F.struct(F.count_if(F.col("_side") == 0).alias("ns"), F.count_if(F.col("_side") == 1).alias("nt")))
    k = k.withColumn("_n", n.scalar()).withColumn("gamma", gamma.scalar())
    ns, nt = F.col("_n.ns").cast("double"), F.col("_n.nt").cast("double")
    raw = F.col("ss") / (ns * ns) + F.col("tt") / (nt * nt) - 2.0 * F.col("st") / (ns * nt)
    values = {"biased": F.when(raw < 0, 0.0).otherwise(raw),
              "unbiased": (F.col("ss") - ns) / (ns * (ns - 1)) + (F.col("tt") - nt) / (nt * (nt - 1)) - 2.0 * F.col("st") / (ns * nt)}
    enough = lambda e: (ns >= LEAST_ROWS[e]) & (nt >= LEAST_ROWS[e])
    fail = lambda e: F.raise_error(F.lit(f"the {e} estimate needs {LEAST_ROWS[e]} or more rows of each domain"))
    forms = F.array(*[F.struct(F.lit(e).alias("form"), F.when(enough(e), values[e]).otherwise(fail(e)).alias("mmd2")) for e in estimators])
    return k.select(F.inline(forms), "gamma", F.col("_n.ns").alias("n_source"), F.col("_n.nt").alias("n_target"))


def _mmd(x: np.ndarray, y: np.ndarray, gamma: float | None, estimator: str) -> float:
    """Squared MMD of two samples; ``gamma`` None is the linear kernel."""
    m, n = len(x), len(y)
    if gamma is None:
        centre = y.mean(axis=0)
        k = lambda p, q: (p - centre) @ (q - centre).T
    else:
        k = lambda p, q: np.exp(-gamma * _squared_distances(p, q))
    xx, yy, cross = k(x, x), k(y, y), 2.0 * float(k(x, y).mean())
    if estimator == "unbiased":
        return float((xx.sum() - np.trace(xx)) / (m * (m - 1)) + (yy.sum() - np.trace(yy)) / (n * (n - 1)) - cross)
    return float(max(xx.mean() + yy.mean() - cross, 0.0))


def mmd_repeated(df: DataFrame, domain: str, a, b, id_col: str, max_samples: int, repeats: int = 100, seed: int = 0,
                 kernel: str = "rbf", gamma: float | None = None, estimator: str = "biased", f: str = "f") -> DataFrame:
    """One estimate per seed (repeat, gamma, mmd2) over equal samples of at most ``max_samples`` rows a domain.

    ``gamma`` None takes the sample's median bandwidth; the linear kernel has none (NULL). The
    per-repeat samples plan as a group limit ahead of the shuffle: at most ``max_samples`` rows per
    repeat, domain and task move, and each group is one such sample.
    """
    least = {"biased": 1, "unbiased": 2}.get(estimator)
    if repeats < 2 or least is None or kernel not in ("rbf", "linear"):
        raise ValueError("two or more repeats, a known estimator and the rbf or linear kernel are needed")
    rows = df.where(F.col(domain).isin(a, b))
    n = min(rows.where(F.col(domain) == d).limit(max_samples).count() for d in (a, b))
    if n < least:
        raise ValueError(f"the {estimator} estimate needs {least} or more rows of each domain")
    each = rows.select(id_col, F.col(domain).alias("_d"), f).withColumn(
        "repeat", F.explode(F.sequence(F.lit(seed), F.lit(seed + repeats - 1))))
    picked = hash_sample(each, n, F.col("repeat").cast("string"), [id_col], ["repeat", "_d"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_d", id_col])
        x, y = (_finite(matrix(pdf.loc[pdf["_d"] == d, f])) for d in (a, b))
        width = None if kernel == "linear" else gamma or _median_gamma(np.concatenate([x, y]))
        return pd.DataFrame({"repeat": [pdf["repeat"].iloc[0]], "gamma": [width], "mmd2": [_mmd(x, y, width, estimator)]}).astype({"gamma": float})

    return picked.groupBy("repeat").applyInPandas(one, "repeat int, gamma double, mmd2 double")


def resampling_summary(values: DataFrame, value: str = "mmd2") -> DataFrame:
    """Mean, SD and 2.5 / 97.5 percent quantiles over a bounded number of resamples."""
    q = F.percentile(value, [0.025, 0.975])
    return values.agg(F.count(F.lit(1)).alias("repeats"), F.avg(value).alias("mean"),
                      F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), q[0].alias("low"), q[1].alias("high"))


def mmd_permutation(df: DataFrame, domain: str, a, b, id_col: str, permutations: int = 1000, seed: int = 0,
                    max_samples: int = 500, f: str = "f") -> DataFrame:
    """Permutation test with a fixed bandwidth: observed, p_value, permutations, n, gamma.

    The pooled sample (at most twice ``max_samples`` rows) is broadcast; permutations are spread over tasks.
    Permutation i takes the first half of the sample in the order of md5("seed:i:id").
    """
    if permutations < 1:
        raise ValueError(f"{permutations} permutations give no test; ask for one or more")
    spark = df.sparkSession
    sample = equal_samples(df, domain, a, b, seed, id_col, max_samples).select(domain, id_col, f)
    rows = sorted(sample.collect(), key=lambda r: (r[domain] != a, r[id_col]))  # at most 2 * max_samples rows
    pooled = _finite(np.asarray([r[f] for r in rows], dtype=float))
    n, gamma, names = len(pooled) // 2, _median_gamma(pooled), [r[id_col] for r in rows]
    shared = spark.sparkContext.broadcast(np.exp(-gamma * _squared_distances(pooled, pooled)))

    def statistic(kern, first):
        w = np.full(2 * n, -1.0 / n)
        w[first] = 1.0 / n
        return float(w @ kern @ w)

    observed = statistic(shared.value, np.arange(n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kern = shared.value
        for pdf in batches:
            null = [statistic(kern, sorted(range(2 * n), key=lambda k: hashlib.md5(f"{seed}:{i}:{names[k]}".encode()).digest())[:n])
                    for i in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "null": null})

    null = spark.range(permutations).mapInPandas(run, "id bigint, null double")
    return null.agg(F.lit(observed).alias("observed"),
                    ((F.count_if(F.col("null") >= observed) + 1) / F.lit(permutations + 1.0)).alias("p_value"),
                    F.count(F.lit(1)).alias("permutations"), F.lit(n).alias("n"), F.lit(gamma).alias("gamma"))


def mmd_groups(df: DataFrame, domain: str, a, b, group: str, id_col: str, mode: str, repeats: int = 1000, seed: int = 0,
               f: str = "f") -> DataFrame:
    """Biased squared MMD per resample (repeat, mmd2): source leave-one-group-out or target group bootstrap.

    All rows count: the kernel is summed once by group pair, with one bandwidth from the unresampled
    rows, and every resample is a weighted sum of that small matrix. Refitting the bandwidth for each
    resample, or equalising the domains' sizes, would give other values. Draw j of resample i is the first
    32 bits of md5("seed:i:j") modulo the number of groups. Groups may be of any type.
    """
    if mode not in ("source_jackknife", "target_bootstrap"):
        raise ValueError(f"unknown mode {mode!r}; use source_jackknife or target_bootstrap")
    rows = df.where(F.col(domain).isin(a, b))
    names = small_side(rows.select(F.col(group).alias("_name")).distinct()
                       .select("_name", (F.row_number().over(Window.orderBy("_name")) - 1).cast("bigint").alias("_group")))
    rows = rows.join(names, rows[group] == names["_name"]).withColumn(
        "_cell", F.col("_group") * 2 + F.when(F.col(domain) == a, 0).otherwise(1)).drop("_name", "_group")
    sums = kernel_sums(rows, median_gamma(rows, seed, id_col, f), "_cell", id_col, f).collect()  # group pairs
    sizes = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = sorted(sizes)
    at = {c: i for i, c in enumerate(cells)}
    kern = np.zeros((len(cells), len(cells)))
    for r in sums:
        kern[at[r["group_a"]], at[r["group_b"]]] = r["total"]
    count = np.asarray([sizes[c] for c in cells], dtype=float)
    source = np.asarray([c % 2 == 0 for c in cells])
    moving = np.flatnonzero(source if mode == "source_jackknife" else ~source)
    total = len(moving) if mode == "source_jackknife" else repeats

    def weights(i):
        times = np.ones(len(cells))
        if mode == "source_jackknife":
            times[moving[i]] = 0.0
        else:
            digest = lambda j: int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16)
            draw = [digest(j) % len(moving) for j in range(len(moving))]
            times[moving] = np.bincount(draw, minlength=len(moving))
        ns, nt = (times * count)[source].sum(), (times * count)[~source].sum()
        return np.where(source, times / ns, -times / nt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [max(float(w @ kern @ w), 0.0) for w in map(weights, (int(i) for i in pdf["id"]))]
            yield pd.DataFrame({"repeat": pdf["id"], "mmd2": values})

    return df.sparkSession.range(total).mapInPandas(run, "repeat bigint, mmd2 double")


def proxy_a_distance(df: DataFrame, domain: str, a, b, id_col: str, seed: int = 0, max_samples: int = 5000,
                     f: str = "f") -> DataFrame:
    """2 (1 - 2 e) clipped to [0, 2], where e is the balanced error of a linear hinge classifier.

    Balanced seeded samples, stratified half split, scaling fitted on the training half.
    """
    rows = equal_samples(df, domain, a, b, seed, id_col, max_samples).select(
        id_col, F.when(F.col(domain) == a, 0.0).otherwise(1.0).alias("label"), F.col(f).alias("f"))
    ranked = hash_rank(rows, ["label"], f"{seed}:half", [id_col])
    n = rows.where("label = 0").count()
    train, test = ranked.where(F.col("rank") <= (n + 1) // 2), ranked.where(F.col("rank") > (n + 1) // 2)
    vec = lambda d: standardize(d, train, (), "f").select("label", array_to_vector("f").alias("features"))
    half = vec(train).persist()
    try:
        model = LinearSVC(maxIter=50, regParam=1e-4, tol=1e-3, standardization=False).fit(few_partitions(half, n))
    finally:
        half.unpersist()
    error = F.avg(F.when(F.col("label") == 0, (F.col("prediction") != 0).cast("double"))), F.avg(
        F.when(F.col("label") == 1, (F.col("prediction") != 1).cast("double")))
    e = model.transform(vec(test)).agg(((error[0] + error[1]) / 2).alias("error"), F.count(F.lit(1)).alias("n_test"))
    return e.withColumn("a_distance", F.least(F.greatest(2.0 * (1.0 - 2.0 * F.col("error")), F.lit(0.0)), F.lit(2.0)))
