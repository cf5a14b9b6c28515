"""Quality rules: text statistics and a learned decision list, in column expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import drop, keep, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")
MAX_TRAIN_ROWS = 200_000
BINS = 20
MIN_PRECISION, MIN_SUPPORT = 0.95, 20


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of all windows in order.

    Sorting (hash, position) puts equal windows side by side; in order of position each marked window
    adds the words up to the next one, five at most. Costs n log n for any text.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = lambda p: F.sort_array(F.filter(F.transform(p, lambda x, k: F.when(
        (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
    covered = lambda m: F.aggregate(F.transform(m, lambda i, k: F.least(F.coalesce(F.get(m, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
                                    F.lit(0).cast("long"), lambda a, x: a + x)
    # one-element arrays bind a value that is used several times
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bind(pairs, lambda p: bind(marked(p), covered))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks), all long.

    Null and empty texts have zeros. Windows of five words are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    hashed = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_windows", F.when(F.size("_words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    less = lambda chars: F.length("_text") - F.length(F.translate("_text", chars, ""))
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        less(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeated(F.col("_windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), less("!?").cast("long").alias("n_marks"))


def add_features(stats: DataFrame) -> DataFrame:
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return stats.select("*", share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
                        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
                        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "n_words").alias("mark_share"))


class Rule:
    """Conjunction of (feature, above, threshold); with no condition it covers everything."""

    def __init__(self, conditions: Sequence[tuple[str, bool, float]] = ()):
        self.conditions = tuple(conditions)

    def covers(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            out = out & (F.col(name) > threshold if above else F.col(name) <= threshold)
        return out

    def __str__(self):
        return " and ".join(f"{n} {'>' if a else '<='} {t:g}" for n, a, t in self.conditions) or "always"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the covered bad rows by a condition that leaves p of p0 bad and n of n0 good ones."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the condition of highest gain until no good row is covered; each step reads one small count table."""
    rule, names = Rule(), list(cuts)
    while True:  # each condition leaves fewer good rows
        binned = rows.where(rule.covers()).select("bad", F.posexplode(F.array(*[F.col(f"bin_{n}") for n in names])).alias("feature", "bin"))
        table = {(r["feature"], r["bin"], r["bad"]): r["n"] for r in binned.groupBy("feature", "bin", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
        p0, n0 = (sum(table.get((0, b, y), 0) for b in range(BINS + 1)) for y in (True, False))
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, name in enumerate(names):
            p = n = 0
            for b, cut in enumerate(cuts[name]):  # bins up to b hold the values <= cut
                p, n = p + table.get((f, b, True), 0), n + table.get((f, b, False), 0)
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(pp, nn, p0, n0)
                    if gain > best[0] + 1e-12:
                        best = (gain, (name, above, cut))
        if best[1] is None:
            break
        rule = Rule([*rule.conditions, best[1]])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is best on rows it was not grown on, with the bad and good rows it covers there."""
    starts = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    counts = rows.agg(*[F.count_if(r.covers() & (F.col("bad") == y)) for r in starts for y in (True, False)]).first()
    scored = [((p - n) / max(p + n, 1), -k, starts[k], p, n) for k, (p, n) in enumerate(zip(counts[::2], counts[1::2]))]
    return max(scored, key=lambda s: s[:2])[2:]


def learn_decision_list(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                        max_rows: int = MAX_TRAIN_ROWS) -> list[Rule]:
    """Rules, in order, that reject texts like those labelled 0; texts that no rule covers are kept.

    Sequential covering: two thirds of the labelled rows grow a rule, one third prunes it; it is added
    while at least MIN_PRECISION of the rows it newly covers there are bad, and at least MIN_SUPPORT are;
    covered rows leave both parts. Fits on about ``max_rows`` labelled rows, drawn by the md5 of the
    id; thresholds are their approximate quantiles. Only quantiles and counts by (feature, bin, label)
    come to the driver. No usable label: no rules.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("bad"))
    total = known.count()
    draw = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    fold = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 9, 8), 16, 10).cast("long") % 3
    known = known.where(draw < max_rows / max(total, 1)).withColumn("prune", fold == 0)
    rows = keep(features.join(known, F.col("doc_id") == F.col("_id")).select("bad", "prune", *FEATURES), "labelled")
    marks = rows.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 1000) for f in FEATURES]).first()
    if marks[0] is None:
        return []
    cuts = {f: sorted({float(v) for v in m}) for f, m in zip(FEATURES, marks)}
    bins = [sum((F.col(f) > c).cast("int") for c in cuts[f]).alias(f"bin_{f}") for f in FEATURES]
    left = keep(rows.select("*", *bins), "binned")
    drop(rows)
    rules: list[Rule] = []
    while True:  # each rule takes at least MIN_SUPPORT bad rows
        rule = _grow(left.where("not prune"), cuts)
        if not rule.conditions:
            break
        rule, p, n = _prune(left.where("prune"), rule)
        if p < MIN_SUPPORT or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = left.where(~rule.covers())
    return rules


def rejected(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional expression."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(rule.covers(), True)
    return out.otherwise(False)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per document.

    ``base_failed``: under 10 words, or over a fifth of them in repeated windows. Other documents are
    kept unless the list, learned from documents that pass so far, rejects them. Null texts have zeros and fail. Repeated rows stay;
    other columns are not read.
    """
    features = keep(add_features(text_statistics(docs, id_col, text_col)), "statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = learn_decision_list(features.where(~failed), labels)
    return features.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                           (~failed & ~rejected(rules)).alias("kept"))
