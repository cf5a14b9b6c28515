"""Removal of lines that many sites share: HyperLogLog spread per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import components, drop, keep, whole, words

MIN_SITES = 10
LOG_K = 12
#: The sketch's standard error is below 0.83 / sqrt(2**LOG_K) = 1.3 %; estimates this far off (19 standard errors) are counted exactly.
MARGIN = 0.25
#: Near copies: words of a run, least hashes of runs that are compared, their least common share, and orders of lines that find them.
SHINGLE, SKETCH, SIMILAR, BANDS = 5, 256, 0.72, 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(line: Column) -> list[Column]:
    """Two checksums that stand for a trimmed line: 96 bits together."""
    trimmed = F.trim(line)
    return [F.xxhash64(trimmed).alias("lh"), F.crc32(trimmed.cast("binary")).alias("lc")]


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(lh, lc): hashes of the lines that stand in documents of at least ``min_sites`` distinct sites; a kept table.

    Lines are trimmed of spaces; lines without a word never count. Null sites are one site, the same
    as the empty name. A line on fewer rows than ``min_sites`` cannot qualify, so a plain count with
    map-side sums comes first and only the rest is sketched; sketches merge in the aggregation.
    """
    site = F.coalesce(F.col(f"`{site_col}`"), F.lit(""))
    lines = (docs.select(site.alias("site"), F.explode(_lines(F.col(f"`{text_col}`"))).alias("line"))
             .where(F.trim("line").rlike(r"[^\x20\x09-\x0D]")).select("site", *_hashes(F.col("line"))))
    often = keep(lines.groupBy("lh", "lc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("lh", "lc"), "lines")
    spread = (lines.join(often, ["lh", "lc"], "left_semi").groupBy("lh", "lc").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
              .select("lh", "lc", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = keep(spread.where(F.col("sites") >= min_sites * (1 - MARGIN)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("lh", "lc")
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("lh", "lc")
    exact = (lines.join(near, ["lh", "lc"], "left_semi").select("lh", "lc", "site").distinct()
             .groupBy("lh", "lc").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("lh", "lc"))
    return keep(sure.unionByName(exact), "shared")


def _on_texts(docs: DataFrame, shared: DataFrame, text_col: str) -> DataFrame:
    """(_text, _at, lh, lc): the shared lines of each row by the md5 of its text and line number."""
    text = F.col(f"`{text_col}`")
    return (docs.select(F.md5(text).alias("_text"), F.posexplode(_lines(text)).alias("_at", "_line"))
            .where(F.trim("_line").rlike(r"[^\x20\x09-\x0D]"))
            .select("_text", "_at", *_hashes(F.col("_line"))).join(shared, ["lh", "lc"], "left_semi"))


def _sketches(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """(key, sketch): the SKETCH smallest hashes of the five-word runs of each text whose md5 is in ``keys``; a kept table."""
    text = F.col(f"`{text_col}`")
    own = docs.select(F.md5(text).alias("key"), text.alias("_t")).groupBy("key").agg(F.first("_t").alias("_t")).join(keys, "key", "left_semi")
    rows = own.select("key", words(F.lower("_t")).alias("_w"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]))
    return keep(rows.select("key", F.slice(F.sort_array(F.array_distinct(runs)), 1, SKETCH).alias("sketch")), "sketches")


def _similar(a: Column, b: Column) -> Column:
    """Share of common runs among the SKETCH smallest of both texts': the similarity itself for texts of fewer runs."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)


def copies(docs: DataFrame, on: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component): texts, by md5, that are copies or near copies of each other by their whole words; a kept table.

    ``on`` has the shared lines (_text, lh, lc) of texts. Texts that agree in the smallest of their lines' hashes in one of BANDS orders, or
    in two of them, are compared with the first of those texts, by sketches of all their five-word runs, and belong together from SIMILAR on, which
    an estimate of a pair at 0.8 reaches with three standard errors to spare.
    """
    low = [F.min(F.xxhash64("lh", "lc", F.lit(k))).alias(f"m{k}") for k in range(BANDS)]
    lows = on.groupBy("_text").agg(*low)
    keys = [F.xxhash64(F.lit(b), f"m{b}") for b in range(BANDS)] + [F.xxhash64(F.lit(-b), f"m{b - 1}", f"m{b}") for b in range(1, BANDS)]
    bands = keep(lows.select("_text", F.explode(F.array(*keys)).alias("key")), "bands")
    firsts = bands.groupBy("key").agg(F.min("_text").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v")
    pairs = keep(bands.join(firsts, "key").where("_text <> v").select(F.col("_text").alias("u"), "v").distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    sketches = _sketches(docs, nodes, text_col)
    one, two = (sketches.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}")) for c in "uv")
    like = pairs.join(one, "u").join(two, "v").where(_similar(F.col("su"), F.col("sv")) >= SIMILAR).select("u", "v")
    found = keep(components(like), "copies")
    for t in (bands, pairs, sketches):
        drop(t)
    return found


def lines_of_many_texts(docs: DataFrame, shared: DataFrame, min_texts: int, text_col: str = "text") -> DataFrame:
    """Those of the ``shared`` lines (lh, lc) that stand in at least ``min_texts`` texts of their own; a kept table.

    Equal texts are one text, and so are near copies (``copies``), judged by whole texts: lines that a group of copies
    alone takes to many sites are not shared lines, and pages with equal lines around different articles are texts of their own.
    """
    on = keep(_on_texts(docs, shared, text_col).select("_text", "lh", "lc").distinct(), "on")
    groups = copies(docs, on, text_col)
    own = on.join(groups, on["_text"] == groups["node"], "left").select("lh", "lc", F.coalesce("component", "_text").alias("own")).distinct()
    found = keep(own.groupBy("lh", "lc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_texts).select("lh", "lc"), "shared")
    for t in (on, groups):
        drop(t)
    return found


def with_clean_text(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", min_texts: int = 1) -> DataFrame:
    """(doc, text, n_lines, n_removed): each row of ``docs`` as a struct, its text without the shared lines, and counts of lines (long).

    Kept lines stay in order and as they were, joined by newlines. A null text stays null with 0
    lines; a text of shared lines only becomes empty; no row is dropped. Hits carry the md5 of the
    text and line numbers only, once per distinct text, and meet the documents in one join. The kept
    stretches between removed lines are cut out as slices, so a text costs its length. With ``min_texts``
    above 1 a shared line must also stand in so many texts, copies counted once (``lines_of_many_texts``).
    """
    shared = shared_lines(docs, min_sites, text_col, site_col)
    if min_texts > 1:
        shared = lines_of_many_texts(docs, shared, min_texts, text_col)
    text = F.col(f"`{text_col}`")
    hits = _on_texts(docs, shared, text_col)
    removed = keep(hits.groupBy("_text").agg(F.sort_array(F.collect_set("_at")).alias("_removed")), "removed")
    found = docs.select(whole(docs), F.md5(text).alias("_text")).join(removed, "_text", "left")
    own = F.col(f"_doc.`{text_col}`")
    cut = F.col("_removed")
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(cut, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(cut, k), F.size("_lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: F.slice(F.col("_lines"), start(k) + 1, F.greatest(end(k) - start(k), F.lit(0)))))
    split = found.withColumn("_lines", F.when(cut.isNotNull(), _lines(own)))
    cleaned = F.when(cut.isNotNull(), F.array_join(kept, "\n")).otherwise(own)
    n_lines = F.coalesce(F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    n_removed = F.coalesce(F.when(cut.isNotNull(), F.size(cut)), F.lit(0)).cast("long")
    return split.select(F.col("_doc").alias("doc"), cleaned.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def clean_lines(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All columns of ``docs`` with the shared lines taken out of the text, as ``with_clean_text`` does."""
    cleaned = with_clean_text(docs, text_col=text_col, **how)
    return cleaned.select(*[(F.col("text") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars, text_md5) of the cleaned documents, one row per document."""
    cleaned = with_clean_text(docs, text_col=text_col, **how)
    return cleaned.select(F.col(f"doc.`{id_col}`").alias("doc_id"), "n_lines", "n_removed",
                          F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
