"""Language identification: script ranges, hashed letter n-grams, Viterbi spans with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm.common import whole

#: First and last code point of each script's main Unicode blocks.
SCRIPT_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPT_RANGES)
BITS2, BITS3 = 16, 17
MAX_TRAIN_DOCS = 3_000
SWITCH = 10.0
MIN_SCRIPT_SHARE = 0.01
CHARS = 2_000_000
CHUNK = 250_000
UNDETERMINED = "und"


@cache
def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, bit of its script) by code point."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, 1 << OTHER, np.int64)
    for k, ranges in enumerate(SCRIPT_RANGES.values()):
        for first, last in ranges:
            script[first:last + 1] = 1 << k
    return letter, script


def _pieces(text: str) -> Iterator[str]:
    """Lower-cased pieces of at most CHUNK characters, cut behind a space where there is one."""
    at, text = 0, text.lower()
    while at < len(text):
        end = min(len(text), at + CHUNK)
        space = text.rfind(" ", at, end) if end < len(text) else -1
        end = space + 1 if space >= at else end
        yield text[at:end]
        at = end


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, each followed by a space; start of each text)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = " ".join(texts) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], ends[:-1]))


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bigram bucket, trigram bucket, first position and length of each word, scripts of each word).

    A word is a run of letters; its last n-grams end on the character behind it, and none reaches
    into the word before. The first position is that of the word's first letter.
    """
    letter, script = _code_tables()
    is_letter = letter[codes]
    a = np.where(is_letter, codes, np.uint32(32))
    p1 = np.concatenate((np.full(1, 32, np.uint32), a[:-1]))
    p2 = np.where(p1 == 32, np.uint32(32), np.concatenate((np.full(2, 32, np.uint32), a[:-2]))[:len(a)])
    two = (a * np.uint32(2654435761) + p1 * np.uint32(2246822519)) >> np.uint32(32 - BITS2)
    three = (a * np.uint32(3266489917) + p1 * np.uint32(668265263) + p2 * np.uint32(374761393)) >> np.uint32(32 - BITS3)
    before = np.concatenate((np.zeros(1, bool), is_letter[:-1]))
    starts, ends = np.flatnonzero(is_letter & ~before), np.flatnonzero(before & ~is_letter)
    scripts = np.bitwise_or.reduceat(np.where(is_letter, script[codes], 0), starts) if len(starts) else np.empty(0, np.int64)
    return two, three, starts, ends - starts, scripts


def _inside(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True at the positions of words and of the character behind each."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse counts (lang, kind, bucket, n) over a task's texts; kind 1: scripts, 2 and 3: n-grams."""
    grams: dict[str, dict[int, np.ndarray]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            own = grams.setdefault(lang, {1: np.zeros(OTHER + 1, np.int64), 2: np.zeros(1 << BITS2, np.int64), 3: np.zeros(1 << BITS3, np.int64)})
            for piece in _pieces(text):
                codes, _ = _codes([piece])
                two, three, starts, lengths, _ = _features(codes)
                inside = _inside(starts, lengths, len(codes))
                own[2] += np.bincount(two[inside], minlength=1 << BITS2)
                own[3] += np.bincount(three[inside], minlength=1 << BITS3)
                letter, script = _code_tables()
                bits, n = np.unique(script[codes[letter[codes]]], return_counts=True)
                own[1][np.log2(bits).astype(int)] += n
    for lang, kinds in grams.items():
        for kind, counts in kinds.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "kind": kind, "bucket": at, "n": counts[at]})


class Model:
    """Log-likelihoods of n-gram buckets relative to their mean over languages, and languages by script."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        n = len(self.langs)
        tables = {1: np.zeros((OTHER + 1, n)), 2: np.zeros((1 << BITS2, n)), 3: np.zeros((1 << BITS3, n))}
        for (lang, kind), rows in counts.groupby(["lang", "kind"]):
            tables[kind][rows["bucket"], self.langs.index(lang)] = rows["n"]
        share = tables[1] / np.maximum(tables[1].sum(axis=0), 1)
        self.by_script = share >= MIN_SCRIPT_SHARE
        scores = []
        for kind in (2, 3):
            c = tables[kind]
            logs = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * (c > 0).any(axis=1).sum()))
            scores.append(((logs - logs.mean(axis=1, keepdims=True)) / 2).astype(np.float32))
        self.two, self.three = scores

    def all_word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``word_scores`` taken over about CHUNK characters at a time: arrays per character stay small."""
        done, some, size = [], [], 0
        for k, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                done.append(self.word_scores(some))
                some, size = [], 0
        if not done:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, int), np.zeros(0, int)
        return tuple(np.concatenate(x) for x in zip(*done))

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each word by language, letters of each word, number of words of each text)."""
        codes, at = _codes(texts)
        two, three, starts, lengths, scripts = _features(codes)
        words = np.diff(np.searchsorted(starts, np.append(at, len(codes))))
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), lengths, words
        inside = np.flatnonzero(_inside(starts, lengths, len(codes)))
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        scores = np.add.reduceat(self.two[two[inside]] + self.three[three[inside]], first, axis=0)
        masks, back = np.unique(scripts, return_inverse=True)
        allowed = np.ones((len(masks), len(self.langs)), bool)
        for k, mask in enumerate(masks):
            per = self.by_script[[s for s in range(OTHER + 1) if mask >> s & 1]]
            allowed[k] = per.all(axis=0) if per.all(axis=0).any() else per.any(axis=0)
        some = allowed.any(axis=1)[back]
        scores = np.where(allowed[back], scores, scores.min(axis=1, keepdims=True) - np.float32(SWITCH))
        return np.where(some[:, None], scores, np.float32(0)), lengths, words


def viterbi(scores: np.ndarray, words: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word of many texts at once, with ``switch`` lost at each change of language.

    Texts take step t together, the longest first, so a step is one array operation; ties stay in the
    language, then go to the first one.
    """
    order = np.argsort(-words, kind="stable")
    counts, offsets = words[order], (np.cumsum(words) - words)[order]
    steps, langs = int(words.max(initial=0)), scores.shape[1]
    active = np.searchsorted(-counts, -np.arange(steps), side="left")
    best = np.zeros((len(words), langs), np.float32)
    came = np.full(scores.shape, -1, np.int16)
    for t in range(steps):
        n = active[t]
        at, now = offsets[:n] + t, best[:n]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - np.float32(switch)
            moves = jump[:, None] > now
            came[at] = np.where(moves, top[:, None], -1)
            now = np.where(moves, jump[:, None], now)
        now = now + scores[at]
        best[:n] = now - now.max(axis=1, keepdims=True)
    state = best.argmax(axis=1)
    out = np.zeros(len(scores), np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        out[at] = state[:n]
        back = came[at, state[:n]]
        state[:n] = np.where(back >= 0, back, state[:n])
    return out


def label_texts(model: Model, texts: list[str | None], spans: bool) -> list[tuple]:
    """(lang, score, spans) of each text."""
    out: list[tuple] = []
    batch: list[list[str]] = []

    def flush():
        pieces = [p for t in batch for p in t]
        scores, letters, words = model.all_word_scores(pieces)
        per_text = np.add.reduceat(np.append(words, 0), np.cumsum([0] + [len(t) for t in batch])[:-1]) if batch else np.zeros(0, int)
        per_text = np.where([len(t) > 0 for t in batch], per_text, 0)
        langs = viterbi(scores, per_text)
        at = 0
        for n in per_text.tolist():
            mine, size = langs[at:at + n], letters[at:at + n]
            at += n
            if not n:
                out.append((UNDETERMINED, 0.0, []))
                continue
            by = np.bincount(mine, weights=size, minlength=len(model.langs))
            k = int(by.argmax())
            runs = []
            if spans:
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [n]))
                runs = [(int(a), int(b - a), model.langs[mine[a]]) for a, b in zip(cuts[:-1], cuts[1:])]
            out.append((model.langs[k], float(by[k] / by.sum()), runs))
        batch.clear()

    size = 0
    for text in texts:
        batch.append(list(_pieces(text)) if text else [])
        size += len(text or "")
        if size >= CHARS:
            flush()
            size = 0
    flush()
    return out


def train(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, max_docs: int = MAX_TRAIN_DOCS) -> Model | None:
    """Fit on about ``max_docs`` labelled documents of each language, drawn by the md5 of the id.

    The counts of all tasks are summed in Spark; at most languages x 200,000 sums come to the driver.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("double").alias("_h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return None
    limit = F.lit(0.0)
    for lang, count in n.items():
        limit = F.when(F.col("lang") == lang, min(1.0, max_docs / count) * 2.0**32).otherwise(limit)
    counts = (rows.where(F.col("_h") < limit).select("lang", "text")
              .mapInPandas(_count_grams, "lang string, kind int, bucket int, n long")
              .groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas())
    return Model(counts) if len(counts) else None


RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()),
                                                     T.StructField("lang", T.StringType())]))),
])


def identify(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             spans: bool = False, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc, language): each row of ``docs`` as a struct and a struct (lang, score, spans).

    Learns from the rows that ``usable`` selects and that have a language and a text; predictions see
    the text only. Words are runs of letters; the scripts of a word narrow its candidates to languages
    that use them in training (a script no language uses leaves the word undecided). Viterbi over the
    word scores labels spans (first word, number of words, language); ``lang`` has most letters, by
    ``score`` of all. ``und`` with score 0 and no spans if the text is null or has no letter, or if
    there is nothing to learn from. Ties go to the first language by name. Repeated rows stay.
    """
    model = train(docs, usable, id_col, text_col, lang_col, max_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            rows = [(UNDETERMINED, 0.0, [])] * len(texts)
        else:
            rows = label_texts(shared.value, texts.tolist(), spans)
        return pd.DataFrame(rows, columns=["lang", "score", "spans"])

    return docs.select(whole(docs).alias("doc"), label(F.col(f"`{text_col}`")).alias("language"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score); a null id is neither held out nor learned from."""
    rows = identify(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), id_col)
    return rows.select(F.col(f"doc.`{id_col}`").alias("doc_id"), held_out(f"doc.`{id_col}`").alias("held_out"), F.col("language.lang").alias("lang_pred"),
                       F.col("language.score").alias("score"))


def keep_languages(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The documents of a decided language: ``und`` and those without a language of ``min_score`` of the letters go."""
    rows = identify(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), id_col)
    return rows.where((F.col("language.lang") != UNDETERMINED) & (F.col("language.score") >= min_score)).select("doc.*")
