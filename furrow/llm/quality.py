"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

A text is reduced to a few statistics (shares of kinds of signs, word and line lengths, repetition). Random Fourier features z(x) with
z(x) . z(y) close to a Gaussian kernel turn kernel ridge regression into linear regression; each partition sums its part of the normal
equations, for several folds, and only these sums (their size does not depend on the data) are added up and solved. Every fold's rows are
scored by the sums of the other folds, and isotonic regression over a fixed number of score bins maps scores to probabilities.

Defined results: a null text counts as empty and is scored like any other; labelled rows whose label is null, and labels without a document, are
passed over; a document labelled twice counts twice; without any usable label every score is 0.5, with one class only that class's share; repeated
rows each keep their row; an empty table gives an empty result; other columns of the input are ignored, or returned unchanged by ``keep_good``.
Labels beyond ``TRAINING_ROWS`` are drawn by a hash of their ids, the same at every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.batches import decide, map_texts
from furrow.session import drop_stored, stored

STATISTICS = (
    "log_bytes", "word_bytes", "upper", "digits", "blanks", "lines", "exclaim", "bars", "marks", "stops", "beyond_ascii", "distinct_words", "top_word", "distinct_lines", "marked_words", "entropy", "capital_words", "word_spread",
)
FOLDS, BINS = 4, 2_000
#: Tasks that sum normal equations (the training rows are bounded), and tasks that add up their sums.
TASKS, ADDERS = 64, 8
#: Labelled rows that the model is fitted on; of more labels about so many are drawn by a hash. Also bounds what is sent to all tasks.
TRAINING_ROWS = 200_000
_SIGNS = np.arange(256)
_IS = {
    "upper": (_SIGNS >= 65) & (_SIGNS <= 90), "letter": ((_SIGNS | 32) >= 97) & ((_SIGNS | 32) <= 122) & (_SIGNS < 128) | (_SIGNS >= 128), "digits": (_SIGNS >= 48) & (_SIGNS <= 57),
    "blanks": np.isin(_SIGNS, (32, 9, 10, 11, 12, 13)), "marks": np.isin(_SIGNS, list(b"#$%&*+<=>@[]^_{}~\\/")), "stops": np.isin(_SIGNS, list(b".,;:?")), "beyond_ascii": _SIGNS >= 128,
}


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of ``STATISTICS``; all zero for an empty one."""
    raw = text.encode() if text else b""
    if not raw:
        return np.zeros(len(STATISTICS))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    letters = max(1, int(count[_IS["letter"]].sum()))
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    share = count[count > 0] / n
    marked = sum(w[-1:] in b"#$%&*!|" for w in words)
    capital = sum(w.isupper() for w in words)
    return np.array([
        np.log1p(n), sizes.mean(), count[_IS["upper"]].sum() / letters, count[_IS["digits"]].sum() / n, count[_IS["blanks"]].sum() / n, np.log1p(count[10]) - np.log1p(n / 80), count[33] / m, count[124] / m,
        count[_IS["marks"]].sum() / m, count[_IS["stops"]].sum() / m, count[_IS["beyond_ascii"]].sum() / n, len(seen) / m, max(seen.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), marked / m,
        -(share * np.log2(share)).sum(), capital / m, sizes.std(),
    ])


def document_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of each row's whole text."""

    return map_texts(docs.select(id, text), text, "x array<double>", lambda: lambda texts: [[statistics(t) for t in texts]])


@dataclass(frozen=True)
class Fourier:
    """Scaled statistics to random Fourier features of a Gaussian kernel, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])


def fourier(mean, scale, features: int, width: float, seed: int) -> Fourier:
    rng = np.random.default_rng(seed)
    return Fourier(np.asarray(mean), np.where(np.asarray(scale) > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))


@dataclass(frozen=True)
class Model:
    transform: Fourier
    weights: np.ndarray
    #: Calibration: raw scores and the probabilities there, both ascending.
    raw: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.transform(x) @ self.weights, -1, 2)
        # A thousandth of the raw score keeps the order inside the steps of the isotonic fit.
        return 0.999 * np.interp(raw, self.raw, self.probability) + 0.001 * np.clip(raw, 0, 1)


def isotonic(raw: np.ndarray, rows: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in the order of ``raw``: (mean raw score, share of positives) of each pool."""
    pools: list[list[float]] = []
    for r, n, p in zip(raw, rows, positive):
        pools.append([r * n, n, p])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _sum_rows(frame: DataFrame, size: int) -> np.ndarray:
    """Sum (fold, part: binary of doubles) by fold: first in a few streaming tasks, then here."""

    def run(batches):
        total = np.zeros((FOLDS, size))
        for pdf in batches:
            for fold, part in zip(pdf["fold"], pdf["part"]):
                total[fold] += np.frombuffer(part)
        yield pd.DataFrame({"fold": range(FOLDS), "part": [t.tobytes() for t in total]})

    out = np.zeros((FOLDS, size))
    for row in frame.repartition(ADDERS).mapInPandas(run, "fold int, part binary").collect():
        out[row.fold] += np.frombuffer(row.part)
    return out


def fit(training: DataFrame, features: int = 200, width: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Fit on rows (fold, x, y) with y 0 or 1. ``width``: the kernel's, in standard deviations of the statistics."""
    d, training = len(STATISTICS), training.coalesce(TASKS)
    moments = training.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return Model(fourier(np.zeros(d), np.ones(d), 1, width, seed), np.zeros(2), np.array([0.0]), np.array([0.5]))
    by = {r.k: r for r in moments}
    transform = fourier([by[k].m for k in range(d)], [by[k].s for k in range(d)], features, width, seed)
    m = features + 1

    def sums(batches):
        total = np.zeros((FOLDS, m * m + m + 1))
        for pdf in batches:
            z, y, folds = transform(np.stack(pdf["x"].to_numpy())), pdf["y"].to_numpy(np.float64), pdf["fold"].to_numpy()
            for f in range(FOLDS):
                own = folds == f
                total[f] += np.concatenate([(z[own].T @ z[own]).ravel(), z[own].T @ y[own], [own.sum()]])
        yield pd.DataFrame({"fold": range(FOLDS), "part": [t.tobytes() for t in total]})

    total = _sum_rows(training.mapInPandas(sums, "fold int, part binary"), m * m + m + 1)

    def solve(t: np.ndarray) -> np.ndarray:
        penalty = np.eye(m) * ridge * max(t[-1], 1) / features
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(t[: m * m].reshape(m, m) + penalty, t[m * m : -1])

    others = np.stack([solve(total.sum(axis=0) - total[f]) for f in range(FOLDS)])

    def binned(batches):
        for pdf in batches:
            raw = np.clip((transform(np.stack(pdf["x"].to_numpy())) * others[pdf["fold"].to_numpy()]).sum(axis=1), -1, 2)
            yield pd.DataFrame({"bin": np.minimum(((raw + 1) / 3 * BINS).astype(int), BINS - 1), "y": pdf["y"].to_numpy(np.float64)})

    bins = training.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    raw, probability = isotonic(np.array([(r.bin + 0.5) / BINS * 3 - 1 for r in bins]), np.array([r.n for r in bins], float), np.array([r.p for r in bins]))
    return Model(transform, solve(total.sum(axis=0)), raw, probability)


def training_ids(labels: DataFrame, held_out: Column, label: str = "quality", id: str = "doc_id", most: int = TRAINING_ROWS) -> DataFrame:
    """(id, y): usable labels of rows that aren't held out; of more than ``most`` about that many, those with the smallest hashes."""
    rows = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~F.coalesce(held_out, F.lit(True))).select(id, F.col(label).cast("double").alias("y"))
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.lit(29), id), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def training_rows(stats: DataFrame, chosen: DataFrame, id: str = "doc_id") -> DataFrame:
    """(fold, x, y): statistics of the labelled rows ``chosen(id, y)``."""
    return stats.join(chosen, id).select(F.pmod(F.xxhash64(id), F.lit(FOLDS)).cast("int").alias("fold"), "x", "y")


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAINING_ROWS) -> DataFrame:
    """(id, score, predicted) for each row of ``docs``, learned from the labels of rows that aren't ``held_out``."""
    stats = stored(document_statistics(docs, id, text), "statistics")
    training = stored(training_rows(stats, training_ids(labels, held_out, label, id, most), id), "training")
    model = fit(training)
    drop_stored(training)

    def score(batches):
        for pdf in batches:
            s = model.score(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({id: pdf[id], "score": s, "predicted": (s >= 0.5).astype(int)})

    return stats.mapInPandas(score, f"`{id}` {docs.schema[id].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged.

    Statistics for training are made of labelled texts only: their ids, about ``most`` at the most, are sent to the texts. All texts are then scored where
    they stand, and only the decisions come back from Python.
    """
    chosen = stored(training_ids(labels, held_out, label, id, most), "labelled")
    labelled = docs.select(id, text).join(F.broadcast(chosen.select(id).distinct()), id, "left_semi")
    training = stored(training_rows(document_statistics(labelled, id, text), chosen, id), "training")
    model = fit(training)
    drop_stored(training)
    good = decide(docs.sparkSession, lambda: lambda texts: model.score(np.stack([statistics(t) for t in texts])) >= 0.5)
    return docs.filter(good(F.col(text)))
