"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text. Weights come from preference pairs
(a document labelled 1 over one labelled 0) by logistic loss on the difference of their features, the
Bradley-Terry likelihood. The threshold is the quantile of the strengths of all labelled training rows at the share of label
0 among them, with a rank error of at most one in ``ACCURACY``; the score is the logistic of the distance to it, so 0.5 is the
threshold.

Training: the weights come from a sample of about ``SAMPLE_ROWS`` labelled documents of each label, chosen by a hash of
doc_id, and at most ``MAX_PAIRS`` pairs. With one label only, or none, all scores are that label's (0.5 without any).

Null or empty text: features of empty text. Very long texts are read whole. Rows of equal strength get equal scores; at the
threshold the label is 1. Repeated rows and ids get equal results, a null doc_id is kept and labels without a label are
left out; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, documents, fit_logistic, held_out, known_labels, labelled_sample, labels

SAMPLE_ROWS = 5_000
MAX_PAIRS = 40_000
ACCURACY = 100_000
SEED = 17
SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\=+~^@]")
DIGITS = re.compile(r"\d")
UPPER = re.compile(r"[A-Z]")
MARKS = re.compile(r"[.,;:!?]")
BLOCK_BYTES = 1 << 16


def features(text: str | None) -> list[float]:
    """Shape, repetition and symbols of a text; all but the lengths are shares."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    data = text.encode()
    packed = sum(len(zlib.compress(data[i : i + BLOCK_BYTES], 1)) for i in range(0, len(data), BLOCK_BYTES))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(1 for w in words if SYMBOLS.search(w))
    return [
        np.log1p(len(words)),
        float(len(words) < 10),
        len("".join(words)) / n / 10,
        len(set(words)) / n,
        1 - len(pairs) / max(len(words) - 1, 1),
        repeats / n,
        np.sqrt(len(SYMBOLS.findall(text)) / chars),
        marked / n,
        np.sqrt(len(DIGITS.findall(text)) / chars),
        np.sqrt(len(UPPER.findall(text)) / chars),
        np.sqrt(len(MARKS.findall(text)) / chars),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        packed / max(len(data), 1),
        max(map(len, words), default=0) / chars,
    ]


def learn(sample: DataFrame, labelled: DataFrame) -> dict:
    """Model: centre, spread and weights of features from a bounded ``sample`` (text, label), and the threshold from all
    ``labelled`` rows (text, label), which may be many."""
    model = learn_weights(sample)
    if not model["weights"].any():
        return model
    found = labelled.select(strength(F.col("text"), model).alias("strength"), "label")
    return model | {"threshold": threshold(cut(found, "strengths"))}


def learn_weights(sample: DataFrame) -> dict:
    """The model without its threshold, which is 0 then; with one label only, or none, it is whole."""

    @F.pandas_udf("array<double>")
    def featured(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    rows = sample.select(featured("text").alias("x"), "label").toPandas()
    size = len(features(""))
    if rows["label"].nunique() < 2:
        sign = {0: -1.0, 1: 1.0}.get(rows["label"].iloc[0] if len(rows) else None, 0.0)
        return {"centre": np.zeros(size), "spread": np.ones(size), "weights": np.zeros(size), "threshold": -sign, "scale": 1.0}
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort(x.T)  # the result doesn't depend on the order of rows
    x, y = x[order], rows["label"].to_numpy()[order]
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / spread
    good, bad = x[y == 1], x[y == 0]
    rng = np.random.default_rng(SEED)
    n = min(MAX_PAIRS, len(good) * len(bad))
    differences = good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]
    weights = fit_logistic(differences, np.ones(n), l2=1.0)
    strengths = x @ weights
    scale = float(np.abs(strengths[y == 1].mean() - strengths[y == 0].mean())) / 6 + 1e-6
    return {"centre": centre, "spread": spread, "weights": weights, "threshold": 0.0, "scale": scale}


def threshold(found: DataFrame) -> float:
    """The middle between the strength at the share of label 0 among all ``found`` (strength, label) and the next greater one."""
    share = found.agg(F.avg(1 - F.col("label"))).first()[0]
    at = found.agg(F.percentile_approx("strength", share, ACCURACY)).first()[0]
    after = found.filter(F.col("strength") > at).agg(F.min("strength")).first()[0]
    return at if after is None else (at + after) / 2


def strength(text: Column, model: dict) -> Column:
    @F.pandas_udf("double")
    def measured(text: pd.Series) -> pd.Series:
        x = (np.array([features(t) for t in text]).reshape(len(text), -1) - model["centre"]) / model["spread"]
        return pd.Series((x * model["weights"]).sum(axis=1))  # equal rows give equal sums in any batch

    return measured(text)


def score_of(strength: Column, model: dict) -> Column:
    away = (strength - F.lit(float(model["threshold"]))) / F.lit(float(model["scale"]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), away))))


def score(text: Column, model: dict) -> Column:
    return score_of(strength(text, model), model)


def scored(docs: DataFrame, marks: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, score) of all ``docs``: each text is measured once, and only its strength is joined and written."""
    model = learn_weights(sample)
    found = cut(docs.select("doc_id", strength(F.col("text"), model).alias("strength")), "strengths")
    if model["weights"].any():
        labelled = found.join(known_labels(marks, "quality"), "doc_id")
        model = model | {"threshold": threshold(labelled.select("strength", "label"))}
    return found.select("doc_id", score_of(F.col("strength"), model).alias("score"))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marks = labels(spark, sf_dir)
    rows = scored(docs, marks, labelled_sample(docs, marks, "quality", SAMPLE_ROWS))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
