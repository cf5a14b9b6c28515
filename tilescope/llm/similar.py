"""Near-duplicates by five-word similarity: SimHash and MinHash bands for candidates, exact Jaccard for links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm import simhash
from tilescope.llm.common import components, drop, keep, whole

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: A pair at 0.8 shares no band with chance (1 - 0.8**3)**20 = 6e-7.
ROWS, BANDS = 3, 20
#: Estimates from 60 minima have a standard error of 0.052 at 0.8; pairs below this one are not looked at.
LEAST_ESTIMATE = 0.5
PIECE = 4096
TILE = 2048
CHARS = 4_000_000

_random = np.random.default_rng(SEED)
XORS = _random.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
FACTORS = _random.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
STEPS = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words make one run, no word (or null) none.

    Words are runs of bytes between ASCII white space with A-Z lower-cased, as in ``simhash``. Each is
    hashed once; a run's hash is a sum of its words' hashes times a factor for the place, mixed.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    sums = np.full(n, width, np.uint64)
    for k in range(width):
        sums += own[k:k + n] * STEPS[k]
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(sums ^ (sums >> np.uint64(29)))


def minima(hashes: np.ndarray) -> bytes:
    """The upper 32 bits of the smallest of ``hashes`` in each of ROWS * BANDS orders; nothing for no hash."""
    if not len(hashes):
        return b""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        low = np.minimum(low, ((hashes[at:at + PIECE] ^ XORS[:, None]) * FACTORS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


@F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("n_shingles", T.LongType())]))
def sketch(texts: pd.Series) -> pd.DataFrame:
    """The SimHash fingerprint of the distinct shingles, their minima and their number."""
    sets = (shingles(t) for t in texts)
    return pd.DataFrame([(simhash.majority([s]), minima(s), len(s)) for s in sets], columns=["fp", "sketch", "n_shingles"])


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forests of each bucket's texts over estimates of LEAST_ESTIMATE or more."""
    for batch in batches:
        us, vs = [], []
        for some in batch["members"]:
            some = {m["key"]: m["sketch"] for m in some}
            keys, left = list(some), np.ones(len(some), bool)
            low = np.stack([np.frombuffer(s, "<u4") for s in some.values()])
            for x, y in _forest(left, lambda x, rest: (low[rest] == low[x]).mean(axis=1) >= LEAST_ESTIMATE):
                us.append(keys[x])
                vs.append(keys[y])
        yield pd.DataFrame({"u": us, "v": vs}, dtype=object)


def _forest(left: np.ndarray, like) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest: ``like(x, rest)`` says which of ``rest`` are linked to x."""
    for first in range(len(left)):
        if not left[first]:
            continue
        left[first], stack = False, [first]
        while stack:
            x = stack.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            found = rest[like(x, rest)]
            left[found] = False
            stack.extend(found.tolist())
            yield from ((x, y) for y in found.tolist())


def exact_forest(texts: list[str], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that connect exactly the texts that links of five-word Jaccard ``similarity`` or more connect."""
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    numbers, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marked = np.zeros(len(numbers), bool)

    def like(x, rest):
        mine = place[starts[x]:starts[x] + sizes[x]]
        marked[mine] = True
        if len(rest) * 4 < len(sets):
            both = np.array([np.count_nonzero(marked[place[starts[y]:starts[y] + sizes[y]]]) for y in rest])
        else:
            both = np.add.reduceat(marked[place], starts, dtype=np.int64)[rest]
        marked[mine] = False
        return both >= similarity * (sizes[x] + sizes[rest] - both)

    return list(_forest(np.ones(len(sets), bool), like))


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        us, vs = [], []
        for some in batch["members"]:
            some = {m["key"]: m["text"] for m in some}
            keys = list(some)
            for x, y in exact_forest(list(some.values())):
                us.append(keys[x])
                vs.append(keys[y])
        yield pd.DataFrame({"u": us, "v": vs}, dtype=object)


def _meet(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(members): the rows (key, ``value``) of each group, those of a group of several ``blocks`` by every two blocks."""
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    return (rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .groupBy(*by, F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"))
            .agg(F.collect_list(F.struct("key", value)).alias("members")).where(F.size("members") > 1).select("members"))


def _size_class(n: Column) -> Column:
    """Classes of sizes: two texts of similarity SIMILARITY have sizes of that ratio at least, and so equal or neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.lit(-float(np.log(SIMILARITY))) + 1e-9).cast("int")


def _with_roots(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links``, the smallest of each component too; a kept table."""
    found = keep(components(links), "components")
    out = keep(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop(found)
    return out


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): texts connected as their SimHash fingerprints are by links of ``simhash.RADIUS`` bits; a kept table.

    The covering masks and spanning forests of ``simhash``. Texts of one fingerprint are tied to the smallest of them.
    """
    firsts = keep(texts.where(F.length("sketch") > 0).groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    same = texts.where(F.length("sketch") > 0).join(firsts, "fp").where("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    links = keep(simhash.link_fingerprints(firsts.select("fp")).distinct(), "links")
    one, two = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in "uv")
    found = keep(same.unionByName(links.join(one, "u").join(two, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))), "maybe")
    for t in (firsts, links):
        drop(t)
    return found


def band_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the texts that agree in a band of minima and in LEAST_ESTIMATE of all; a kept table."""
    bands = [F.xxhash64(F.lit(b), F.substring("sketch", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    tables = texts.where(F.length("sketch") > 0).select("key", F.explode(F.array(*bands)).alias("band"))
    busy = keep(tables.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("band", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "buckets")
    met = keep(tables.join(busy, "band"), "met")
    found = keep(_meet(met.join(texts, "key"), ["band"], "sketch").mapInPandas(_estimated, "u string, v string").distinct(), "maybe")
    for t in (busy, met):
        drop(t)
    return found


def link_texts(docs: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component): the texts, by md5, that links of five-word Jaccard of 0.8 or more connect; a kept table.

    ``texts`` is a kept table (key, fp, sketch, n_shingles) of the distinct texts of ``docs``. Texts whose SimHash
    fingerprints are linked meet, and so do texts that agree in a band of minima with an estimate of 0.5 or more: at 0.8 two
    fingerprints differ in 10 of 64 bits, past the reach of the masks. Both form clusters, disjoint, so
    that each text is read once more; in a cluster all similarities that can reach 0.8 are computed from the texts. Buckets
    and clusters too large for a task are cut into blocks of which every two meet, in clusters those of like sizes.
    """
    near, maybe = fingerprint_pairs(texts), band_pairs(texts)
    clusters = _with_roots(near.unionByName(maybe))
    text = F.col(f"`{text_col}`")
    # copies become one row in the task that reads them, so a text of which there are very many is no hot key
    own = docs.select(F.md5(text).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    read = keep(own.join(clusters, own["key"] == clusters["node"]).select("key", F.col("component").alias("cluster"), "text"), "clusters", "zstd")
    sizes = read.groupBy("cluster").agg(F.sum(F.length("text")).alias("n")).select("cluster", F.ceil((F.col("n") + 1) / CHARS).cast("int").alias("blocks"))
    # in clusters of several blocks only texts of like sizes meet: each goes to its own class's meeting and to the one below
    sized = read.join(texts.select("key", "n_shingles"), "key").join(sizes, "cluster").withColumn("_c", F.when(F.col("blocks") > 1, _size_class(F.col("n_shingles"))).otherwise(0))
    classed = sized.withColumn("class", F.explode(F.when(F.col("blocks") > 1, F.array(F.col("_c"), F.col("_c") - 1)).otherwise(F.array(F.col("_c")))))
    counts = classed.groupBy("cluster", "class").agg(F.sum(F.length("text")).alias("n")).select("cluster", "class", F.ceil((F.col("n") + 1) / CHARS).cast("int").alias("blocks"))
    links = keep(_meet(classed.drop("blocks").join(counts, ["cluster", "class"]), ["cluster", "class"], "text").mapInPandas(_exact, "u string, v string").distinct(), "links")
    out = _with_roots(links)
    for t in (near, maybe, clusters, read, links):
        drop(t)
    return out


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest (id, md5 of the text) stays.

    Groups are what links of a five-word Jaccard of 0.8 or more connect, every link computed from the
    texts; texts without a word (null, empty) are one group. Null ids come after others. Of rows equal
    in both one stays. All columns stay as they are.
    """
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.md5(text), F.lit(""))
    identity = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), key.alias("text"))
    rows = keep(docs.select(identity.alias("_identity"), key.alias("key"), sketch(text).alias("s")).select("_identity", "key", "s.*"), "sketches")
    texts = keep(rows.groupBy("key").agg(F.min("_identity").alias("own"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "texts")
    groups = link_texts(docs, texts.select("key", "fp", "sketch", "n_shingles"), text_col)
    root = F.when(F.length("sketch") == 0, F.lit("")).otherwise(F.coalesce("component", "key"))
    stays = keep(texts.join(groups, texts["key"] == groups["node"], "left").groupBy(root.alias("root")).agg(F.min("own").alias("first"))
                 .select(F.md5(F.to_json("first")).alias("_stays")), "stays")
    for t in (rows, texts, groups):
        drop(t)
    return (docs.select(whole(docs), F.md5(F.to_json(identity)).alias("_stays")).join(stays, "_stays", "left_semi")
            .dropDuplicates(["_stays"]).select("_doc.*"))
