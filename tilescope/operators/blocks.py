"""Packed vector blocks and the block grid join behind neighbour search and kernel sums.

Rows become blocks of at most BLOCK vectors inside their own partitions (no shuffle). Every pair of
blocks meets exactly once on a shards x shards grid by equi-join, and a task keeps only running
results per block, so no row pair ever leaves it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.operators.ordering import hash_sample

BLOCK = 512


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def pack(df: DataFrame, keys: list[str], id_col: str, code_col: str, f: str = "f", unit: bool = False, times: int = 1) -> DataFrame:
    """(keys, block, n, ids, codes, mat): ids and whole-number codes as int64 bytes, vectors in their ``wire_type``, unit ones as float64; ``times`` BLOCK rows a block."""
    size, wire = BLOCK * times, np.float64 if unit else wire_type(df, f)
    key_types = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    schema = (key_types + ", " if keys else "") + "block bigint, n int, ids binary, codes binary, mat binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = TaskContext.get().partitionId() << 32
        for pdf in batches:
            groups = pdf.groupby(keys, sort=True) if keys else [((), pdf)]
            for key, rows in groups:
                for at in range(0, len(rows), size):
                    part = rows.iloc[at: at + size].sort_values("_id")
                    m = matrix(part["_f"])
                    if unit:
                        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
                    out = {k: [v] for k, v in zip(keys, key)}
                    out |= {"block": [serial], "n": [len(part)], "ids": [part["_id"].to_numpy(np.int64).tobytes()],
                            "codes": [part["_code"].to_numpy(np.int64).tobytes()], "mat": [m.astype(wire).tobytes()]}
                    serial += 1
                    yield pd.DataFrame(out)

    rows = df.select(*keys, F.col(id_col).cast("bigint").alias("_id"), F.col(code_col).cast("bigint").alias("_code"),
                     F.col(f).alias("_f"))
    return rows.mapInPandas(run, schema)


PIVOTS = 64
SEEDS = 2048


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def seed_rows(refs: DataFrame, keys: list[str], id_col: str, f: str = "f") -> tuple[list[tuple], np.ndarray]:
    """(keys, unit vectors) of SEEDS rows of ``refs`` in seeded hash order, for the driver; the first PIVOTS serve as pivots."""
    rows = hash_sample(refs.select(*keys, id_col, f), SEEDS, "pivot", [id_col, *keys]).collect()
    vectors = unit_rows(np.asarray([r[f] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))
    chain, left = [], list(range(min(PIVOTS, len(rows))))
    while left:  # pivots in a chain of like directions, so that rows of neighbouring pivots are alike
        near = left if not chain else sorted(left, key=lambda i: -float(vectors[i] @ vectors[chain[-1]]))
        chain.append(near[0])
        left.remove(near[0])
    order = [*chain, *range(len(chain), len(rows))]
    return [tuple(rows[i][c] for c in keys) for i in order], vectors[order]


def _block_cuts(pivots: np.ndarray, size: int) -> list[int]:
    """Where blocks of sorted rows begin: after ``size`` rows, or at a new pivot once a quarter of that is in."""
    cuts, begin = [0], 0
    for at in [*np.flatnonzero(np.diff(pivots) != 0) + 1, len(pivots)]:
        while at - begin > size:
            begin += size
            cuts.append(begin)
        if at - begin >= max(1, size // 4) and at < len(pivots):
            begin = int(at)
            cuts.append(begin)
    return [*cuts, len(pivots)]


def wire_type(df: DataFrame, f: str = "f") -> type:
    """Four bytes a number carry an array<float> exactly; all else takes eight."""
    return np.float32 if dict(df.dtypes)[f] == "array<float>" else np.float64


def hottest_share(seeds) -> float:
    """The share of the key with most rows, by the seed rows."""
    names = seeds.value[0]
    return max(Counter(names).values()) / len(names) if names else 1.0


def pack_near(df: DataFrame, keys: list[str], id_col: str, code_col: str, seeds, k: int = 0, f: str = "f", times: int = 1) -> DataFrame:
    """As ``pack`` in packs of ``times`` blocks of like directions, the vectors as they are in their ``wire_type``: (..., sizes, centres, radii, floors), all per block but the last.

    Rows are dealt by range over (keys, nearest pivot, id), so blocks hold one pivot's rows, or a few small pivots',
    and no pivot is one task's. A centre is the mean direction, a radius the widest angle to it. With ``k``, ``floors`` are similarities that
    the k-th neighbour of each row reaches at least: its k-th best among the key's seeds, -2 if they are fewer.
    """
    kinds, wire = dict(df.dtypes), wire_type(df, f)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "block bigint, n int, ids binary, codes binary, mat binary, sizes binary, centres binary, radii binary, floors binary"])

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        pivots = seeds.value[1][:PIVOTS]
        return pd.Series((unit_rows(matrix(column)) @ pivots.T).argmax(axis=1) if len(pivots) and len(column) else np.zeros(len(column), int))

    rows = df.select(*keys, F.col(id_col).cast("bigint").alias("_id"), F.col(code_col).cast("bigint").alias("_code"), F.col(f).alias("_f"))
    order = [*keys, "_pivot", "_id"]
    dealt = rows.withColumn("_pivot", nearest("_f")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = TaskContext.get().partitionId() << 32
        own_names, own = seeds.value
        of_key = {}
        for i, name in enumerate(own_names):
            of_key.setdefault(name, []).append(i)
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                cuts, mine = _block_cuts(part["_pivot"].to_numpy(), BLOCK), of_key.get(tuple(key), [])
                for first in range(0, len(cuts) - 1, times):
                    bounds = np.asarray(cuts[first: first + times + 1])
                    some = part.iloc[bounds[0]: bounds[-1]]
                    raw = matrix(some["_f"])
                    m = unit_rows(raw)
                    each = np.split(m, bounds[1:-1] - bounds[0])
                    centres = np.stack([x.mean(axis=0) for x in each])
                    centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-30
                    radii = np.array([np.arccos(np.clip(x @ c, -1, 1)).max() for x, c in zip(each, centres)])
                    floors = np.concatenate([np.partition(np.nan_to_num(x @ own[mine].T, nan=-2.0), -k, axis=1)[:, -k] for x in each]) if 0 < k <= len(mine) else np.full(len(m), -2.0)
                    out = {c: [v] for c, v in zip(keys, key)}
                    out |= {"block": [serial], "n": [len(some)], "ids": [some["_id"].to_numpy(np.int64).tobytes()],
                            "codes": [some["_code"].to_numpy(np.int64).tobytes()], "mat": [raw.astype(wire).tobytes()], "sizes": [np.diff(bounds).astype(np.int64).tobytes()],
                            "centres": [centres.tobytes()], "radii": [radii.tobytes()], "floors": [floors.tobytes()]}
                    serial += 1
                    yield pd.DataFrame(out)

    return dealt.mapInPandas(run, schema)


def single_error(d: int) -> float:
    """More than a product of two vectors of ``d`` numbers and at most length 1 in single precision can be off, and a bound rounded to it."""
    return (d + 8) * 2.0 ** -23


def best_possible(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The greatest cosines between vectors within angles ``ra`` of directions ``a`` and those within ``rb`` of ``b``, all with all."""
    apart = np.arccos(np.clip(a @ b.T, -1, 1)) - ra[:, None] - rb
    return np.cos(np.maximum(apart, 0.0))


#: Cells of the grid for each core, so that tasks even out, and rows of a side that a cell holds at most, about.
CELLS_A_CORE = 4
CELL_ROWS = 500_000


#: Blocks of a pack at most, and packs of a side that even out over the groups of a grid.
PACK_BLOCKS = 8
PACKS = 64


def pack_blocks(share: float, n: int) -> int:
    """Blocks a pack for ``n`` rows, ``share`` of them of one key: a pair of packs holds the square of its pairs, so what travels for
    each pair of rows is less, but a table has to have packs enough."""
    return min(PACK_BLOCKS, max(1, int(share * n) // (BLOCK * PACKS)))


def grid(spark: SparkSession, share: float, rows: tuple[int, int]) -> tuple[int, int]:
    """(groups of left blocks, of right blocks) of a key's grid; ``rows`` are those of the two tables.

    Every left block is sent once for each right group and the other way round, so the longer side is cut into more groups. Cells are
    as many as keep all cores busy, not as many as there are shuffle partitions: copies of a block do not grow with the tables until
    a cell would hold CELL_ROWS.
    """
    cells = max(1.0, share * min(int(spark.conf.get("spark.sql.shuffle.partitions")), CELLS_A_CORE * spark.sparkContext.defaultParallelism))
    left, right = (max(1, n) for n in rows)
    groups = min(max(1, round(math.sqrt(cells * left / right))), math.ceil(cells))
    least = lambda n: math.ceil(share * n / CELL_ROWS)
    return max(groups, least(left)), max(math.ceil(cells / groups), least(right))


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], share: float = 1.0, rows: tuple[int, int] = (1, 1)) -> DataFrame:
    """Every (left, right) block pair of a key, spread over a grid; columns get ``_l`` / ``_r`` suffixes.

    A block goes to one row or column of its key's ``grid``. ``share`` is the hottest key's part of all rows: its cells are that part
    of all, so that many even keys do not send every block to more cells than there are tasks. A merge join, so that a left block meets
    all right blocks of its cell before the next one comes.
    """
    groups = dict(zip(("_gl", "_gr"), grid(left.sparkSession, share, rows)))  # blocks of a partition are dealt to them in turn
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in left.columns if c not in keys]

    def side(df, s, own, other):
        first = F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(groups[own]))
        home = F.pmod(F.col("block") + first, F.lit(groups[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(groups[other] - 1)))
        return (df.select(*keys, *[F.col(c).alias(c + s) for c in names], home.alias(own)).withColumn(other, every)
                .repartition(parts, *keys, "_gl", "_gr").hint("merge"))

    return side(left, "_l", "_gl", "_gr").join(side(right, "_r", "_gr", "_gl"), [*keys, "_gl", "_gr"])


def half_pairs(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a table once, and each with itself (``block_l = block_r``); columns get ``_l`` / ``_r`` suffixes.

    The upper half of a grid, so a block goes to about half as many cells. Cells are not put together by their bytes, since the
    work is in their pairs.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.isqrt(2 * parts))
    home = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    side = lambda s, cell: blocks.select(*[F.col(c).alias(c + s) for c in blocks.columns], home.alias("_home")).select("*", F.explode(cell).alias("_other"))
    left = side("_l", F.sequence(F.col("_home"), F.lit(shards - 1))).withColumnsRenamed({"_home": "_gl", "_other": "_gr"})
    right = side("_r", F.sequence(F.lit(0), F.col("_home"))).withColumnsRenamed({"_home": "_gr", "_other": "_gl"})
    left, right = (rows.repartition(parts, "_gl", "_gr").hint("merge") for rows in (left, right))
    return left.join(right, ["_gl", "_gr"]).where("_gl < _gr OR block_l <= block_r")


def unpack(row_n: int, ids: bytes, codes: bytes, mat: bytes, wire: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int64),
            np.frombuffer(mat, wire).astype(np.float64, copy=False).reshape(row_n, -1))
