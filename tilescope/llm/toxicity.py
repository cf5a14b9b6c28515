"""Toxicity grades by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm.common import keep

TOKEN = re.compile(r"[^\W_]+")
MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 2_000
MIN_Z, MIN_DOCS = 4.0, 5
GRADES = 4
L2, STEPS, RATE = 1e-5, 500, 0.1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, toxic, clean): in how many of a batch's texts of either label a term stands."""
    for batch in batches:
        seen = {True: Counter(), False: Counter()}
        for text, bad in zip(batch["text"], batch["bad"]):
            seen[bool(bad)].update(set(tokens(text)))
        both = list(seen[True].keys() | seen[False].keys())
        yield pd.DataFrame({"term": both, "toxic": [seen[True][w] for w in both], "clean": [seen[False][w] for w in both]})


class OrdinalModel:
    """P(grade <= k) = sigmoid(cut_k - w.x): one weight per term, shared by the ordered cuts."""

    def __init__(self, terms: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.weights, self.cuts = weights, cuts

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        known = Counter(self.terms[w] for w in tokens(text) if w in self.terms)
        return list(known), np.log1p(list(known.values())).tolist()

    def grades(self, text: str | None) -> np.ndarray:
        """Probability of each grade."""
        at, x = self.features(text)
        score = float(self.weights[at] @ np.asarray(x)) if at else 0.0
        below = np.concatenate(([0.0], 1 / (1 + np.exp(np.clip(score - self.cuts, -50, 50))), [1.0]))
        return np.diff(below)


def fit_ordinal(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, n_terms: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts by full-batch Adam on the mean log-likelihood with an L2 penalty.

    Cuts are the first one plus sums of exponentials, so they stay in order.
    """
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.concatenate([np.asarray(a, int) for a, _ in rows]) if len(owner) else np.zeros(0, int)
    x = np.concatenate([np.asarray(v, float) for _, v in rows]) if len(owner) else np.zeros(0)
    weight = 1 / len(rows)
    theta = np.zeros(n_terms + n_grades - 1)
    theta[n_terms] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, raw = theta[:n_terms], theta[n_terms:]
        cuts = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        score = np.bincount(owner, w[at] * x, len(rows))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -50, 50)))
        slope = np.pad(below * (1 - below), ((0, 0), (1, 1)))
        full = np.concatenate((np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))), axis=1)
        i = np.arange(len(rows))
        p = np.maximum(full[i, grades + 1] - full[i, grades], 1e-12)
        up, low = slope[i, grades + 1] / p * weight, slope[i, grades] / p * weight
        by_score = low - up
        by_cut = np.bincount(grades + 1, up, n_grades + 1)[1:-1] - np.bincount(grades, low, n_grades + 1)[1:-1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate((np.bincount(at, by_score[owner] * x, n_terms) - L2 * w, [tail[0]], tail[1:] * np.exp(raw[1:])))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = theta[n_terms:]
    return theta[:n_terms], raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS) -> OrdinalModel | None:
    """Fit on about ``max_rows`` labelled documents, drawn by the md5 of the id; None without both labels.

    Terms are words whose share of toxic and of clean documents differs by MIN_Z standard errors, at
    most MAX_TERMS. Both sides are drawn before they meet, and the sample is kept once. Labels say toxic or not; toxic documents get grades 1 to GRADES - 1 by thirds of
    their sum of features that speak for toxicity. The sample's sparse counts (terms only) come to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("bad"))
    rate = max_rows / max(known.count(), 1)
    drawn = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32 < rate
    sample = keep(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where(drawn("_doc"))
                  .join(known.where(drawn("_id")), F.col("_doc") == F.col("_id")).select("text", "bad"), "labelled", "zstd")
    sizes = {r["bad"]: r["n"] for r in sample.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n1, n0 = sizes[True], sizes[False]
    words = (sample.mapInPandas(_document_frequencies, "term string, toxic long, clean long").groupBy("term")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    p = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    chosen = (words.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).withColumn("z", z).where(F.abs("z") >= MIN_Z)
              .orderBy(F.abs("z").desc(), "term").limit(MAX_TERMS).collect())
    if not chosen:
        return None
    terms = [r["term"] for r in chosen]
    shape = OrdinalModel(terms, np.zeros(len(terms)), np.zeros(GRADES - 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*shape.features(t), bool(b)) for t, b in zip(batch["text"], batch["bad"])]
            yield pd.DataFrame(rows, columns=["at", "x", "bad"])

    rows = sample.mapInPandas(count, "at array<int>, x array<double>, bad boolean").toPandas()
    speaks = np.array([r["z"] > 0 for r in chosen])
    features = list(zip(rows["at"], rows["x"]))
    said = np.array([np.asarray(x, float)[speaks[np.asarray(a, int)]].sum() if len(a) else 0.0 for a, x in features])
    bad = rows["bad"].to_numpy(bool)
    cuts = np.quantile(said[bad], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grades = np.where(bad, 1 + (said[:, None] > cuts).sum(axis=1), 0)
    return OrdinalModel(terms, *fit_ordinal(features, grades, len(terms), GRADES))


RESULT = T.StructType([T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])


def grade_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, p_toxic, severity, grade, toxic), one row per document.

    ``p_toxic`` is the probability of a grade above 0, ``severity`` the expected grade (0 to 3), ``grade``
    the most probable one (ties: the lower), ``toxic`` says p_toxic >= 0.5. Whole texts are read; null
    and empty texts have no features. Without labels of both kinds, or without telling words, all is 0.
    Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **how))

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, []
        for text in texts:
            p = model.grades(text) if model is not None else np.array([1.0])
            rows.append((float(1 - p[0]), float(p @ np.arange(len(p))), int(p.argmax())))
        return pd.DataFrame(rows, columns=["p_toxic", "severity", "grade"]).astype({"grade": "int32"})

    judged = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col)).alias("_j"))
    return judged.select("doc_id", "_j.p_toxic", "_j.severity", "_j.grade", (F.col("_j.p_toxic") >= 0.5).alias("toxic"))
