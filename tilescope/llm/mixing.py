"""Mixing sources to target weights by a time-varying curriculum, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.llm.common import before, keep, md5_key, n_words, whole

EXPAND = 4096


def weigh_by_rank(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                  tilts: tuple[float, ...] = (0.5, 0.0, -0.5)) -> DataFrame:
    """Add ``weight`` and ``knots`` (time, weight) to one row per source, repeating over sources by code point, null last.

    A tilt of 0.5 starts a source at 1.5 times its weight and ends it at half of it, linearly, so the
    integral over the training time 0 to 1 stays the weight. The window runs over one row per source.
    """
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), k + 1)
    weight, tilt = pick(weights), pick(tilts)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return sources.withColumn("weight", weight).withColumn(
        "knots", F.array(knot(0.0, weight * (1 + tilt)), knot(1.0, weight * (1 - tilt))))


def fill_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): ``share`` of all sizes dealt by weight, none above ``cap`` sizes.

    What a capped source leaves goes to the others by weight until none is above. In order of
    size / weight the level with the first k sources capped rises up to the right k and falls after,
    so the level is its maximum; one pass over one row per source. Sources of no size get 0.
    """
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - capped * cap) / rest
    return (sources.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
            .withColumn("target", F.least(F.col("source_size") * cap, F.col("_level") * F.col("weight")).cast("double")).drop("_level"))


def integrate(knots: Column) -> Column:
    """Segments (t0, len, w0, w1, c0, c1) of a piecewise linear schedule with its cumulative integral from c0 to c1."""
    first = F.array().cast("array<struct<t0:double,len:double,w0:double,w1:double,c0:double,c1:double>>")

    def add(done, k):
        a, b = F.element_at(knots, k), F.element_at(knots, k + 1)
        c = F.coalesce(F.get(done, F.size(done) - 1)["c1"], F.lit(0.0))
        length = b["t"] - a["t"]
        return F.concat(done, F.array(F.struct(
            a["t"].alias("t0"), length.alias("len"), a["w"].alias("w0"), b["w"].alias("w1"), c.alias("c0"),
            (c + (a["w"] + b["w"]) / 2 * length).alias("c1"))))

    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), first, add)


def invert(segments: Column, share: Column) -> Column:
    """The time at which a source has met ``share`` (0 to 1) of its whole demand."""
    demand = share * F.element_at(segments, -1)["c1"]
    s = F.coalesce(F.try_element_at(F.filter(segments, lambda x: demand < x["c1"]), F.lit(1)), F.element_at(segments, -1))
    d = F.greatest(demand - s["c0"], F.lit(0.0))
    root = s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + d * 2 * (s["w1"] - s["w0"]) / s["len"], F.lit(0.0)))
    return F.least(s["t0"] + s["len"], s["t0"] + F.when(root > 0, d * 2 / root).otherwise(0.0))


def _taken(start: Column, size: Column, end: Column) -> Column:
    return F.least(F.greatest(end - start, F.lit(0)), size)


def plan_mix(docs: DataFrame, weigh=weigh_by_rank, share: float = 1.5, cap: int = 2, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", others: Column | None = None) -> DataFrame:
    """One row per distinct (doc_id, source, md5 of the text, others) with its count ``n`` and place in the source's stream.

    A source's documents follow each other in md5 order; the stream is read ``cap`` times over. A
    document's words before ``target`` (whole words) are taken, so a source's taken words equal its
    target rounded down; the document that lies across the target is taken in part. Null sources form
    one source, null texts have size 0 and take nothing. Same input, same plan, in any partitioning.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.md5(text).alias("text_md5"),
                       (F.lit("") if others is None else others).alias("others"))
    items = keep(rows.groupBy("doc_id", "source", "size", "text_md5", "others").agg(F.count(F.lit(1)).alias("n"))
                 .select("*", (F.col("size") * F.col("n")).alias("all"),
                         md5_key(F.col("doc_id"), F.col("source"), F.col("size"), F.col("text_md5"), F.col("others")).alias("h")), "mix")
    sizes = items.groupBy("source").agg(F.sum("all").alias("source_size"))
    sources = keep(fill_targets(weigh(sizes), share, float(cap)).withColumn("segments", integrate(F.col("knots")))
                   .withColumn("goal", F.floor("target").cast("long")).withColumnRenamed("source", "_source"), "sources")
    placed = before(items, ["source"], "h", ["all"])
    return placed.join(sources, placed["source"].eqNullSafe(sources["_source"])).drop("_source", "weight", "knots")


def _rows(plan: DataFrame) -> DataFrame:
    """One row per document again: equal rows take neighbouring places, expanded in pieces."""
    pieces = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EXPAND).cast("long"))).alias("_from")).hint("rebalance")
    each = F.sequence(F.col("_from"), F.least(F.col("n"), F.col("_from") + EXPAND) - 1)
    return (pieces.select("*", F.explode(each).alias("_i"))
            .withColumn("start", F.col("before_all") + F.col("_i") * F.col("size")).drop("_from", "_i"))


def _position(start: Column) -> Column:
    goal = F.greatest(F.col("goal"), F.lit(1))
    return invert(F.col("segments"), start / goal)


def mix_counts(docs: DataFrame, cap: int = 2, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position), one row per document, sorted by training position.

    ``position`` (0 to 1) is where the document's first copy starts; documents not taken have none and come last.
    """
    rows = _rows(plan_mix(docs, cap=cap, **how))
    taken = sum([_taken(F.col("start") + F.col("source_size") * k, F.col("size"), F.col("goal")) for k in range(1, cap)],
                _taken(F.col("start"), F.col("size"), F.col("goal")))
    at = F.when(taken > 0, F.round(_position(F.col("start")), 9))
    return (rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), at.alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mix_documents(docs: DataFrame, cap: int = 2, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **how) -> DataFrame:
    """The documents in training order: all columns, each row as often as the mix reads it, sorted by position.

    A copy belongs to the mix if at least half of its words lie before the target, so texts stay
    whole; documents without words have no copy. Copies keep every column of ``docs``.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, source_col, text_col)]
    others = F.md5(F.to_json(F.struct(*rest))) if rest else F.lit("")
    plan = plan_mix(docs, cap=cap, id_col=id_col, text_col=text_col, source_col=source_col, others=others, **how)
    reads = _rows(plan.where("size > 0")).select("*", F.explode(F.array(*[F.lit(k) for k in range(cap)])).alias("_k"))
    starts = reads.withColumn("start", F.col("start") + F.col("_k") * F.col("source_size")).where("start + size / 2 <= goal")
    places = starts.select("h", _position(F.col("start")).alias("_position"))
    key = md5_key(F.col(id_col), F.col(source_col), n_words(F.col(text_col)), F.md5(F.col(text_col)), others).alias("_key")
    distinct = docs.select(whole(docs), key).groupBy("_doc", "_key").agg(F.count(F.lit(1)).alias("_n"))
    return distinct.join(places, F.col("_key") == F.col("h")).orderBy("_position").select("_doc.*")
