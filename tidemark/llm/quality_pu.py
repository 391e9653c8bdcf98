"""A quality classifier from positive and unlabelled texts: logistic regression under the non-negative unbiased risk.

Positives are trusted texts (label 1); unlabelled texts are drawn from all training documents, whatever their label; label 0 is never read.
The class prior is estimated from these two alone: a first classifier tells positives from unlabelled texts, and the least ratio of unlabelled to positive
scores above a threshold, over two halves that are fitted and scored crosswise, is the share of positives that the unlabelled texts can hold.
The fit takes at most SAMPLE different texts of each kind, those of least hash, and their mean and deviation; every text is scored, from counts over the whole of it.

Defined results: a null or empty text has no words and is scored too; repeated rows keep one row each and are one row of the sample, a repeated label counts
once (the larger); without positives every score is 0.5.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, table

FOLDS, HELD_OUT = 5, 0
#: Most texts of each kind in the fit.
SAMPLE = 6000
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.05, 1e-3
#: Least share of positives above a threshold that the prior is read from.
LEAST_TAIL = 0.3
_SYMBOLS = list(b"#*$%&<>^~=_\\{}[]@+")


def features(text: bytes | None) -> list[float]:
    text = text or b""
    size = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    lengths = np.array([len(w) for w in words] or [0])
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    share = seen[seen > 0] / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = max(1, n - 2)
    return [
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        float((lengths <= 3).mean()),
        upper / max(1, upper + lower),
        seen[48:58].sum() / size,
        seen[_SYMBOLS].sum() / size,
        seen[33] / n,
        seen[124] / n,
        seen[46] / n,
        seen[44] / n,
        seen[128:].sum() / size,
        (seen[32] + seen[9:14].sum()) / size,
        len(lines) / n,
        np.log1p(len(counts)) / np.log1p(n),
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples,
        len(zlib.compress(text, 1)) / size,
        len(set(lines)) / max(1, len(lines)),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
        -float((share * np.log2(share)).sum()),
    ]


def expanded(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -4, 4)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk, prior * E_p[l(g)] and E_u[l(-g)] - prior * E_p[l(-g)], and their gradients."""
    at_p, at_u = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
    plus, minus = prior * np.logaddexp(0, -p @ w).mean(), np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    return plus, minus, prior * ((at_p - 1) @ p) / len(p), at_u @ u / len(u) - prior * (at_p @ p) / len(p)


def descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int) -> np.ndarray:
    """Weights by Adam; where the second part of the risk is below zero, its gradient is undone."""
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, risk, plus, minus = gradient(p, u, w, prior)
        g = plus + minus + DECAY * w if risk >= 0 else -minus
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled rows. For every threshold, unlabelled rows above it are at least that share of the positive rows above it; the least ratio, with an allowance for
    the size of the halves, is the estimate."""
    found = []
    for own in (0, 1):
        a, b = p[own::2], u[own::2]
        held_p, held_u = p[1 - own :: 2], u[1 - own :: 2]
        if not (len(a) and len(b) and len(held_p) and len(held_u)):
            continue
        # With a small prior the risk is that of telling positives from unlabelled rows, weighed by it.
        w = descend(a, b, len(a) / (len(a) + len(b)), STEPS // 2)
        at_p, at_u = np.sort(held_p @ w), np.sort(held_u @ w)
        cuts = np.quantile(at_p, np.linspace(0, 1 - LEAST_TAIL, 60))
        f_p = 1 - np.searchsorted(at_p, cuts) / len(at_p)
        f_u = 1 - np.searchsorted(at_u, cuts) / len(at_u)
        allowed = np.sqrt(np.maximum(f_u * (1 - f_u), 1 / len(at_u)) / len(at_u))
        found.append(((f_u + allowed) / f_p).min())
    return float(np.clip(np.mean(found), 0.05, 0.95)) if found else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> tuple:
    """Mean and deviation of the unlabelled rows, and weights. The prior is estimated if it is not given."""
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = expanded(positive, mean, std), expanded(unlabelled, mean, std)
    return mean, std, descend(p, u, class_prior(p, u) if prior is None else prior, STEPS)


def _features(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "h"])


def _sample(rows: DataFrame, text: str) -> np.ndarray:
    """Features of the SAMPLE different rows (by doc_id and text) of least hash."""
    hashed = rows.select(F.col(text).cast("binary").alias("t"), F.pmod(F.xxhash64("doc_id", text, F.lit("pu")), F.lit(1 << 62)).alias("h"))
    n = hashed.count()
    # Few rows more than the sample reach the sort; equal rows are one.
    few = hashed.where(F.col("h") <= int((1 << 62) * min(1.0, 4 * SAMPLE / max(1, n))))
    picked = few.select("h").distinct().orderBy("h").limit(SAMPLE)
    got = few.join(F.broadcast(picked), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t")).select("t", "h").mapInArrow(_features, "x array<double>, h long").collect()
    return np.array([r.x for r in sorted(got, key=lambda r: r.h)])


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple | float:
    """The model, or 0.5 where there is no positive. Labels are read only outside the held-out fold, and only those of 1."""
    labels = labels.where((crc_mod("doc_id", FOLDS) != HELD_OUT) & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    trusted = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    docs = docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    p = _sample(docs.join(F.broadcast(trusted), "doc_id", "left_semi"), text)
    if not len(p):
        return 0.5
    return fit(p, _sample(docs, text))


def scored(docs: DataFrame, model: tuple | float, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns of docs and _tm_score."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = given.value
        for batch in batches:
            texts = batch.column("_tm_text").to_pylist()
            if isinstance(model, float):
                score = np.full(len(texts), model)
            else:
                score = 1 / (1 + np.exp(-expanded(np.array([features(t) for t in texts]).reshape(len(texts), -1), *model[:2]) @ model[2])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score, pa.float64())], [*columns, "_tm_score"])

    picked = docs.select(*columns, F.col(text).cast("binary").alias("_tm_text"))
    return picked.mapInArrow(run, picked.select(*columns, F.lit(0.0).alias("_tm_score")).schema)


def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("_tm_score").alias("score"), (F.col("_tm_score") >= THRESHOLD).cast("int").alias("predicted"))
