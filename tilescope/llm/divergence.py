"""Source divergence audit: exact document frequencies, then a recount through minimal perfect hashes.

The first pass counts in how many documents of its language each term stands. Terms frequent enough are
dealt to shards, each with a minimal perfect hash and its keys. The second pass reads the texts
again with a round of shards broadcast, checks every hit against the stored key and counts occurrences in dense
slots, an array per group. Shares and divergences are integers throughout.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm import spans
from tilescope.llm.common import keep
from tilescope.session import BROADCAST_ROWS, is_small

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Terms of a shard, on average; stored keys are at most KEY_BYTES long, so a shard has a size.
SHARD_TERMS = 16_384
KEY_BYTES = 32
#: Bytes of shards broadcast at once, and of the dense counts a task holds before it hands them on.
ROUND_BYTES = 32 << 20
SLOT_BYTES = 96 << 20
#: Bytes of text taken at a time.
TEXT_BYTES = 4 << 20
#: Sources of a language that meet in one block of pairs.
BLOCK = 64

_NO_TERM = np.zeros(256, bool)  # all of ASCII but letters
_NO_TERM[:0x80] = True
_NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, number of terms of each text): runs of letters A to Z and characters beyond ASCII, A-Z lower-cased."""
    return spans.words(texts, _NO_TERM, _LOWER)


# ---- minimal perfect hashes ---------------------------------------------------------------

def _key(term: bytes) -> bytes:
    """What is stored of a term: itself, or a mark that no text begins with and the digest of a long one."""
    return term if len(term) <= KEY_BYTES else b"\xff" + hashlib.sha256(term).digest()


def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    return pd.util.hash_array(keys, hash_key=f"{seed:016d}", categorize=False) if len(keys) else np.zeros(0, np.uint64)


def _level(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """Place of each hash in a level of ``size`` bits."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys, with the keys.

    Each level has two bits a key left; a key alone at its bit takes it, the others go to the next level,
    and a key's slot is the rank of its bit among all levels'. Keys that share 64 bits of hash would never
    part, so the seed changes until none do.
    """

    def __init__(self, keys: list[bytes]):
        own = np.array(keys + [None], dtype=object)[:-1]
        self.seed = 0
        while len(np.unique(_hashes(own, self.seed))) < len(own):
            self.seed += 1
        left = _hashes(own, self.seed)
        self.sizes, bits = [], []
        while len(left):
            size = 2 * len(left)
            at = _level(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.ranks = np.cumsum(self.bits, dtype=np.int32) - 1
        self.keys = pa.array(own[np.argsort(self._slots(own))].tolist(), pa.binary())

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h, slot, begin = _hashes(keys, self.seed), np.full(len(keys), -1), 0
        left = np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            at = begin + _level(h[left], k, size)
            hit = self.bits[at]
            slot[left[hit]] = self.ranks[at[hit]]
            left, begin = left[~hit], begin + size
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        slot = self._slots(keys)
        hit = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[hit])), pa.array(keys[hit].tolist(), pa.binary()))
        slot[hit[~same.to_numpy(zero_copy_only=False)]] = -1
        return slot

    def __getstate__(self):
        return self.seed, self.sizes, np.packbits(self.bits), len(self.bits), self.keys

    def __setstate__(self, state):
        self.seed, self.sizes, packed, n, self.keys = state
        self.bits = np.unpackbits(packed, count=n).astype(bool)
        self.ranks = np.cumsum(self.bits, dtype=np.int32) - 1


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (_hashes(keys, 10**15) % np.uint64(n)).astype(np.int32)


# ---- first pass ---------------------------------------------------------------------------

def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """(rows, term number of each word, distinct terms, row of each word) of slices of batches whose first column is the text."""
    for batch in batches:
        for i, j in spans.slices(batch.column(0), TEXT_BYTES):
            part = batch.slice(i, j - i)
            values, counts = terms(part.column(0))
            code, distinct = spans.coded(values)
            yield part, code, distinct, np.repeat(np.arange(j - i), counts)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): the terms in at least ``min_docs`` documents of their language. ``docs``: text, lang, source."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches):
        for part, code, distinct, row in _batches(batches):
            lang, langs = spans.coded(part.column(1))
            seen = np.unique(row * len(distinct) + code)  # each term once a document
            pair, n = np.unique(lang[seen // max(len(distinct), 1)] * len(distinct) + seen % max(len(distinct), 1), return_counts=True)
            which = pa.array(pair // max(len(distinct), 1)), pa.array(pair % max(len(distinct), 1))
            yield pa.RecordBatch.from_arrays([langs.take(which[0]), distinct.take(which[1]).cast(pa.string()), pa.array(n)], names=schema.names)

    found = docs.select("text", "lang").mapInArrow(count, schema)
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


# ---- perfect hashes as a table ------------------------------------------------------------

def _keys(values: pa.Array) -> np.ndarray:
    return np.array([_key(v) for v in values.cast(pa.binary()).to_pylist()] + [None], dtype=object)[:-1]


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """(lang, n_shards, shard, slot, term, m, packed): every kept term with its slot, a kept table.

    The number of a language's shards follows from its terms, so that a shard holds about SHARD_TERMS. Each
    is built in a task of its own; ``packed`` is its perfect hash with the stored keys, at slot 0 only, ``m`` its terms.
    """
    kept = keep(kept, "terms", "zstd")
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("int").alias("n_shards"))
    rows = kept.join(_small(sizes, "term_sizes"), "lang").select("lang", "term", "n_shards")
    dealt = T.StructType([T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n_shards", T.IntegerType()),
                          T.StructField("shard", T.IntegerType())])

    def deal(batches):
        for b in batches:
            keys, n = _keys(b.column(1)), b.column(2).to_numpy()
            shard = np.zeros(len(n), np.int32)
            for m in np.unique(n):
                shard[n == m] = shard_of(keys[n == m], int(m))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=dealt.names)

    placed = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_shards", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("m", T.IntegerType()),
                           T.StructField("packed", T.BinaryType())])

    def build(t: pa.Table) -> pa.Table:
        keys = _keys(t.column("term").combine_chunks())
        shard = PerfectHash(keys.tolist())
        slot = shard.find(keys)
        packed = pickle.dumps(shard)
        return pa.table([t.column("lang"), t.column("n_shards"), t.column("shard"), pa.array(slot, pa.int32()), t.column("term"),
                         pa.array(np.full(len(keys), len(keys), np.int32)), pa.array([packed if k == 0 else None for k in slot.tolist()], pa.binary())], names=placed.names)

    return keep(rows.mapInArrow(deal, dealt).groupBy("lang", "shard").applyInArrow(build, placed), "slots", "zstd")


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, broadcast if it is counted and measured to be small."""
    rows = keep(df, name)
    return F.broadcast(rows) if is_small(rows, BROADCAST_ROWS) else rows


# ---- second pass --------------------------------------------------------------------------

def recount(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """(lang, source, shard, slot, n, n_lang): occurrences of kept terms by group, those that have any, and in the language; a kept table.

    Shards are broadcast in rounds of at most ROUND_BYTES, and each round reads all the texts once. A task
    counts into an array of slots per group and hands its counts on when the arrays pass SLOT_BYTES.
    """
    spark = docs.sparkSession
    by_size = Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, 0)
    shards = slots.where("slot = 0").select("lang", "n_shards", "shard", "m", "packed")
    rounds = keep(shards.withColumn("round", F.floor(F.sum(F.octet_length("packed")).over(by_size) / ROUND_BYTES)), "rounds")
    numbers = [r["round"] for r in rounds.select("round").distinct().orderBy("round").collect()]
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])
    counted = None
    for number in numbers:
        packed = spark.sparkContext.broadcast([tuple(r) for r in rounds.where(F.col("round") == number).select("lang", "n_shards", "shard", "m", "packed").collect()])
        part = keep(docs.select("text", "lang", "source").mapInArrow(_counter(packed, schema), schema), "counts")
        packed.unpersist()
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = spark.createDataFrame([], schema)
    dealt = counted.repartition("lang", "shard", "slot").groupBy("lang", "shard", "slot", "source").agg(F.sum("n").alias("n"))
    alike = Window.partitionBy("lang", "shard", "slot")
    return keep(dealt.select("lang", "source", "shard", "slot", "n", F.sum("n").over(alike).alias("n_lang")), "recount")


def _counter(packed, schema):
    names = schema.names

    def count(batches):
        tables: dict[str, tuple[int, np.ndarray, dict]] = {}
        for lang, n_shards, shard, m, data in sorted(packed.value, key=lambda r: r[2]):
            _, begins, own = tables.setdefault(lang, (n_shards, [0], {}))
            own[shard] = (begins[-1], pickle.loads(data))
            begins.append(begins[-1] + m)
        held: dict[tuple[str, str], np.ndarray] = {}  # 32-bit slots: handed on before 2**31 words are counted
        counted = 0

        def hand_on():
            for (lang, source), dense in held.items():
                _, begins, own = tables[lang]
                at = np.flatnonzero(dense)
                k = np.searchsorted(begins, at, side="right") - 1
                shard = np.array(list(own), np.int32)[k]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(shard),
                                                  pa.array((at - np.array(begins)[k]).astype(np.int32)), pa.array(dense[at].astype(np.int64))], names=names)
            held.clear()

        for part, code, distinct, row in _batches(batches):
            if not len(code):
                continue
            counted += len(code)
            if counted >= 1 << 31:
                yield from hand_on()
                counted = len(code)
            keys = _keys(distinct)
            lang, langs = spans.coded(part.column(1))
            source, sources = spans.coded(part.column(2))
            of_word = lang[row]
            for k, name in enumerate(langs.to_pylist()):
                if name not in tables:
                    continue
                n_shards, begins, own = tables[name]
                mine = of_word == k
                used = np.unique(code[mine])
                place = np.full(len(keys), -1)
                shard = shard_of(keys[used], n_shards)
                for s in np.unique(shard):
                    if s in own:
                        some = used[shard == s]
                        begin, table = own[s]
                        slot = table.find(keys[some])
                        place[some] = np.where(slot >= 0, begin + slot, -1)
                at = place[code[mine]]
                there = at >= 0
                pair, n = np.unique(source[row[mine][there]] * begins[-1] + at[there], return_counts=True)
                cuts = np.flatnonzero(np.diff(pair // begins[-1], prepend=-1))
                for x, y in zip(cuts, [*cuts[1:], len(pair)]):
                    group = name, sources[int(pair[x] // begins[-1])].as_py()
                    if group not in held:
                        if held and sum(d.nbytes for d in held.values()) + 4 * begins[-1] > SLOT_BYTES:
                            yield from hand_on()
                        held[group] = np.zeros(begins[-1], np.int32)
                    held[group][pair[x:y] % begins[-1]] += n[x:y].astype(np.int32)
        yield from hand_on()

    return count


# ---- shares and divergences ---------------------------------------------------------------

def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total), exact: the product has room for every count."""
    whole_part = F.call_function("div", (F.lit(SCALE) * n.cast("decimal(19,0)")).cast("decimal(38,0)"), total.cast("decimal(38,0)"))
    return F.lit(1) + whole_part


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays, by long division in base 1,000; ``total`` may go up to 9e15."""
    out, rest = np.divmod(n, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source's terms lie from the other sources' and from its language's.

    A language keeps the terms of at least ``min_docs`` of its documents. A group, and a language, gives each kept
    term the share p = 1 + floor(SCALE (n + 1) / (N + V)): n its occurrences there, N those of all kept terms,
    V the number of kept terms. Part ``pair``: for each other source of the language the sum over kept terms of
    floor((p - q)^2 / q), q being the other's share, ranked; 0 without kept terms. Part ``term``: the ``top`` kept
    terms of the group with p > q by the same measure, q being the language's share. Ties rank by the item's UTF-8 bytes.

    Null text, language or source is the empty string. Every row is a document, repeated ones too; groups without
    terms appear in pairs. An empty table gives no rows. Texts of any length are read whole, a slice at a time.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    slots = perfect_hashes(kept_terms(rows, min_docs))
    counts = recount(rows, slots)
    terms_of = slots.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(terms_of, "lang", "left")
    in_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
                           (F.sum(F.coalesce("own", F.lit(0))).over(in_lang) + F.coalesce("v", F.lit(0))).alias("lang_total"),
                           (F.row_number().over(in_lang.orderBy("source")) - 1).alias("i"))
    groups = _small(groups, "groups")
    return _term_part(counts, slots, groups, top).unionByName(_pair_part(counts, slots, groups))


def _term_part(counts: DataFrame, slots: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Rows are cut to those that reach a group's first ``top`` values before terms are looked up to settle ties."""
    rows = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "shard", "slot", _share(F.col("n") + 1, F.col("total")).alias("p"), _share(F.col("n_lang") + 1, F.col("lang_total")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", "shard", "slot", F.expr("(p - q) * (p - q) div q").alias("value"))
    group = Window.partitionBy("lang", "source")
    first = rows.withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    named = first.join(slots.select("lang", "shard", "slot", "term"), ["lang", "shard", "slot"])
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pair_part(counts: DataFrame, slots: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over a shard's dense counts for two blocks of sources at a time; a shard and a block have a size, so has a task's group."""
    shards = slots.where("slot = 0").select("lang", "shard", "m")
    # every source meets every shard of its language once, so that sources without a term there count too
    anchors = groups.join(shards, "lang", "left").select("lang", "i", "total", F.coalesce("shard", F.lit(-1)).alias("shard"), F.coalesce("m", F.lit(0)).alias("slot"), F.lit(-1).cast("long").alias("n"))
    cells = counts.join(groups, ["lang", "source"]).select("lang", "i", F.lit(0).cast("long").alias("total"), "shard", "slot", "n")
    blocks = groups.groupBy("lang").agg(F.max(F.floor(F.col("i") / BLOCK)).cast("int").alias("last"))
    own = F.floor(F.col("i") / BLOCK).cast("int")
    dealt = (anchors.unionByName(cells).join(_small(blocks, "source_blocks"), "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
             .select("lang", "shard", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "i", "total", "slot", "n"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.LongType())])

    def sums(t: pa.Table) -> pa.Table:
        i, total, slot, n = (t.column(c).to_numpy() for c in ("i", "total", "slot", "n"))
        anchor = n < 0
        order = np.argsort(i[anchor])
        sources, totals, m = i[anchor][order], total[anchor][order], int(slot[anchor][0])
        dense = np.zeros((len(sources), m), np.int64)
        cell = ~anchor
        dense[np.searchsorted(sources, i[cell]), slot[cell]] = n[cell]
        p = _shares(dense + 1, totals[:, None]) if m else dense
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        left, right, value = [], [], []
        for x in range(len(sources)):  # pairs within a block are made where both sides are that block
            others = np.flatnonzero((sources // BLOCK != sources[x] // BLOCK) | ((a == b) & (np.arange(len(sources)) != x)))
            apart = p[x] - p[others]
            value.append((apart * apart // p[others]).sum(axis=1) if m else np.zeros(len(others), np.int64))
            left.append(np.full(len(others), sources[x]))
            right.append(sources[others])
        out = [np.concatenate(c) for c in (left, right, value)]
        return pa.table([pa.array([t.column("lang")[0].as_py()] * len(out[0]), pa.string()), pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), pa.array(out[2])], names=schema.names)

    found = dealt.groupBy("lang", "shard", "a", "b").applyInArrow(sums, schema).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    one, two = groups.select("lang", "source", "i"), groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    named = found.join(one, ["lang", "i"]).join(two, ["lang", "j"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
