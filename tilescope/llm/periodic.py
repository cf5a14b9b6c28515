"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm import spans
from tilescope.llm.common import whole, words

#: A run holds at least so many words and so many periods.
MIN_WORDS = 24
MIN_PERIODS = 3

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
RESULT = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType())])


def split(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segments) of the words that can stand in a run; every segment is consecutive words.

    A run repeats each of its words MIN_PERIODS times, so a word rarer than that within its segment is
    in no run and splits the segment; pieces under MIN_WORDS go. The pieces are counted anew until
    nothing splits. A round looks only at the pieces of the segments that the last one split.
    """
    at, part = np.arange(len(code)), text
    settled, n = [], 0
    while len(at):
        key = pd.factorize(part * (code.max() + 1) + code[at])[0]
        often = np.bincount(key)[key] >= MIN_PERIODS
        whole_part = np.ones(part.max() + 1, bool)
        whole_part[part[~often]] = False
        done = whole_part[part]
        live = often & ~done
        pieces = [(at[done], part[done], True), (at[live], part[live], False)]
        at, part = at[:0], part[:0]
        for a, p, stable in pieces:
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = (np.diff(a) != 1) | (np.diff(p) != 0)
            p = np.cumsum(new) - 1
            long = np.bincount(p)[p] >= MIN_WORDS
            a, p = a[long], p[long]
            if stable:
                settled.append((a, p + n))
                n += int(p[-1]) + 1 if len(p) else 0
            else:
                at, part = a, p
    if not settled:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, part = (np.concatenate(c) for c in zip(*settled))
    order = np.argsort(at, kind="stable")
    return at[order], part[order]


def lag_scan(code: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, a row each, as positions in ``code``; runs lie within a ``part``.

    For every power of two W, windows of W words are numbered by doubling, equal windows equally. Where a
    window next recurs at a lag q with W/2 < q <= W, q is the smallest period there (a smaller one would
    bring the window back earlier), and a maximal stretch of starts with the same lag q, from x to y, is
    exactly the run from x of y - x + W + q words: a run of three periods has such starts. So each period
    is scanned at one W, in sorts of the windows that recur at all: O(n log n) a level whatever the periods.
    """
    found = [np.zeros((0, 3), np.int64)]
    longest = np.bincount(part).max() if len(part) else 0
    rank = pd.factorize(part * (code.max() + 1 if len(code) else 1) + code)[0].astype(np.int64)
    where = np.arange(len(code))
    w = 1
    while MIN_PERIODS * (w // 2 + 1) <= longest and len(where):
        order = where[np.argsort(rank[where], kind="stable")]
        same = rank[order[1:]] == rank[order[:-1]]
        here, later = order[:-1][same], order[1:][same]
        lag = later - here
        fits = (lag > w // 2) & (lag <= w)
        i, q = here[fits], lag[fits]
        by_start = np.argsort(i)
        i, q = i[by_start], q[by_start]
        if len(i):
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(i) != 1) | (np.diff(q) != 0)
            x = np.flatnonzero(new)
            y = np.append(x[1:], len(i)) - 1
            length, period = i[y] - i[x] + w + q[x], q[x]
            ok = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
            found.append(np.stack([i[x], length, period], axis=1)[ok])
        recurs = np.zeros(len(code), bool)
        recurs[here] = recurs[later] = True
        where = np.flatnonzero(recurs[:len(code) - w] & recurs[w:] & (part[:len(code) - w] == part[w:])) if w < len(code) else where[:0]
        doubled = pd.factorize(rank[where] * (rank.max() + 1) + rank[where + w])[0]
        rank = np.full(len(code), -1, np.int64)
        rank[where] = doubled
        w *= 2
    return np.concatenate(found)


def runs_of_texts(texts: pa.Array) -> pa.Array:
    """Runs of each text by start, then period, and the text without its repeats."""
    values, counts = spans.words(texts)
    code, _ = spans.coded(values)
    ends = np.concatenate(([0], np.cumsum(counts)))
    at, part = split(code, np.repeat(np.arange(len(texts)), counts))
    runs = lag_scan(code[at], part)
    runs[:, 0] = at[runs[:, 0]]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(edge)[:-1] == 0
    kept = np.concatenate(([0], np.cumsum(stays)))[ends]
    left = values if stays.all() else values.filter(pa.array(stays))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left), b" ").cast(pa.string())
    cuts = np.searchsorted(runs[:, 0], ends).astype(np.int32)
    runs[:, 0] -= np.repeat(ends[:-1], np.diff(cuts))
    fields = [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
    return pa.StructArray.from_arrays([lists, joined], fields=list(_RESULT))


@F.arrow_udf(RESULT)
def _runs(texts: pa.Array) -> pa.Array:
    parts = [runs_of_texts(texts[i:j]) for i, j in spans.slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], _RESULT)


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, runs, collapsed): each row of ``docs`` as a struct, its runs, and its text with runs cut to one period.

    Words are maximal runs of characters other than space and tab to carriage return, numbered from 0. A
    run is a maximal stretch of smallest period q, of at least MIN_WORDS words and MIN_PERIODS periods; a
    word inside any run, after that run's first q words, goes. What stays is joined by one space. A null
    or empty text has no runs and collapses to the empty text. Rows are independent: nothing is shuffled,
    repeated rows give repeated results, and the work on a text of n words is O(n log n) a level. A worker
    holds a batch of rows (at most one text beyond SLICE_BYTES in work at a time, about 100 bytes a word).
    """
    return docs.select(whole(docs).alias("doc"), _runs(F.col(f"`{text_col}`")).alias("_r")).select(
        "doc", F.col("_r.runs").alias("runs"), F.col("_r.collapsed").alias("collapsed"))


def collapse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text that has runs collapsed; other texts stay as they are."""
    found = find_runs(docs, text_col)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"doc.`{text_col}`"))
    return found.select(*[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def _strongest(runs: Column) -> Column:
    """The run of most periods, compared exactly; ties by start, then period; null without runs."""
    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        sooner = F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"])
        return F.when(best.isNull() | (a > b) | ((a == b) & sooner), r).otherwise(best)
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text by its id's checksum has its words after a point replaced by a repeated stretch."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), h.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(chosen, words(F.col("text"))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row."""
    best = _strongest(F.col("runs"))
    rows = find_runs(docs, text_col).select(F.col(f"doc.`{id_col}`").alias("doc_id"), "runs", "collapsed", best.alias("best"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
