"""A quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; all text is unlabelled, a mixture of both classes whose positive share (the class prior) is
estimated from positives and unlabelled text alone: a first model tells the two apart, and where its score is high only positives are left, so
that the unlabelled share there over the positives' share is the prior.  A linear model on text measures minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where the second part goes below zero, its gradient is turned.

Training takes at most ``max_rows`` positives and as many unlabelled rows, by order of a hash of the id; scoring covers every row.
Labels of rows with crc32(doc_id as text) mod 5 = 0 are never read: they are held out.

Edge cases: null and empty texts have all measures 0 and get that score; without positives or without text every score is one half; rows that repeat score alike; an empty table gives no rows; other columns are ignored; very
long texts are counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

MAX_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 400
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MEASURES = ("words", "word_length", "symbols", "marks", "bars", "upper", "digits", "variety", "stutter", "top_word", "same_lines", "stops")


def measures(text: str | None) -> tuple[float, ...]:
    """Measures of a text, each about 0 to 8: logs of counts and of shares."""
    words = (text or "").split()
    if not text or not words:
        return (0.0,) * len(MEASURES)
    n, n_chars = len(words), sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    stutter = sum(map(str.__eq__, words, words[1:]))
    of_words = lambda x: np.log1p(100 * x / n)
    return (
        np.log1p(n),
        np.log1p(n_chars / n),
        of_words(sum(map(text.count, "#*$%&<>"))),
        of_words(text.count("!")),
        of_words(text.count("|")),
        np.log1p(100 * len(UPPER.findall(text)) / n_chars),
        np.log1p(100 * sum(map(text.count, "0123456789")) / n_chars),
        len(counts) / n**0.8,
        of_words(stutter),
        of_words(counts.most_common(1)[0][1]),
        np.log1p(100 * (len(lines) - len(set(lines))) / len(lines)),
        of_words(text.count(". ") + text.count(".\n") + text.endswith(".")),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            found = np.array([measures(x) for x in rows.column("text").to_pylist()], np.float64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], ["doc_id", *MEASURES])


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, rate: float = 0.05, decay: float = 0.02) -> np.ndarray:
    """Weights (the last is the intercept) on standardised measures, folded back to raw ones; logistic loss, Adam.

    Without a prior it learns to tell positives from unlabelled rows, both weighing one half.
    """
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-6
    p, u = ((np.column_stack([(x - mean) / scale, np.ones(len(x))])) for x in (positive, unlabelled))
    share = 0.5 if prior is None else prior
    w = np.zeros(p.shape[1])
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = np.einsum("ij,j->i", p, w), np.einsum("ij,j->i", u, w)
        own = share * (p * slope(zp)[:, None]).mean(0)
        rest = (u * -slope(-zu)[:, None]).mean(0)
        if prior is None:
            gradient = own + (1 - share) * rest
        else:
            negative = loss(-zu).mean() - prior * loss(-zp).mean()
            other = rest - prior * (p * -slope(-zp)[:, None]).mean(0)
            gradient = own + other if negative >= 0 else -other
        gradient = gradient + decay * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - (raw * mean).sum())


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled rows: the ratio of the two score tails bounds it from above wherever the tail begins.

    The least such bound counts, each with a standard error, as the least of many noisy ratios would be too low.
    """
    w = train(positive, unlabelled, None)
    scores = [(x * w[:-1]).sum(1) for x in (positive, unlabelled)]
    cuts = np.quantile(scores[0], np.arange(0.05, 0.51, 0.05))
    tp, tu = ((s[:, None] >= cuts).mean(0) for s in scores)
    bound = tu / tp * (1 + np.sqrt((1 - tu) / np.maximum(1e-9, tu * len(unlabelled)) + (1 - tp) / (tp * len(positive))))
    return float(min(0.99, max(0.01, bound.min())))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` and ``labels(doc_id, quality)`` to (doc_id, held_out, score, predicted)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    schema = "doc_id long, " + ", ".join(f"{x} double" for x in MEASURES)
    measured = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, schema), "measures")
    open_labels = labels.where(~held_out & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))

    def by_hash(rows: DataFrame) -> np.ndarray:
        """The first ``max_rows`` by hash; what can't be among them stays out of the tasks' results."""
        places = 1 << 30
        at = F.pmod(F.xxhash64("doc_id"), F.lit(places))
        share = min(1.0, 1.2 * max_rows / max(1, rows.count()))
        first = rows.withColumn("at", at).where(F.col("at") < int(places * share)).orderBy("at", *MEASURES).limit(max_rows)
        return np.array(first.select(*MEASURES).collect(), np.float64).reshape(-1, len(MEASURES))

    positive = by_hash(measured.join(open_labels.where("quality = 1"), "doc_id", "left_semi"))
    unlabelled = by_hash(measured.where(~held_out))
    if len(positive) and len(unlabelled):
        *weights, bias = train(positive, unlabelled, class_prior(positive, unlabelled)).tolist()
    else:
        weights, bias = [0.0] * len(MEASURES), 0.0
    total = F.lit(bias)
    for name, weight in zip(MEASURES, weights, strict=True):
        total = total + F.col(name) * weight
    scored = measured.select("doc_id", held_out.alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
