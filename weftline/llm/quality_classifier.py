"""Quality scores of texts by a kernel ridge model on document statistics.

Statistics of each text are standardised with means and deviations over all documents; random
Fourier features approximate a Gaussian kernel over them. Each task adds up its share of the normal
equations (one small matrix), shares meet in a few groups, and the driver solves one system whose
size is fixed by the number of features. Each training row is also scored by weights fitted without
its part of the rows; these unseen scores, counted in a fixed number of bins with their labels, give an
isotonic calibration (pool adjacent violators), which turns a ridge score into a probability. Labels are learned only from rows outside the held-out fold; language, source, id and
labels are never features.

Defined results: null and empty texts get the score of zero statistics; rows with a null id are
scored, never learned from, and not held out; repeated labels of one document count as their mean,
rounded; without labels of both kinds every score is the share of label 1 (0.5 without any); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.quality_rules import measure
from weftline.llm.shared import stage, texts_of

STATISTICS = 12
BINS = 1024


def statistics_of(text: str) -> list[float]:
    n, chars, symbols, dup, repeat, lines, distinct = measure(text)
    if not n:
        return [0.0] * STATISTICS
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(raw.sum()))
    return [
        np.log1p(n), np.log1p(chars / n), min(symbols / n, 4.0) ** 0.5, dup / lines, repeat / n, distinct / n, np.log1p(n / lines),
        raw[48:58].sum() / total, raw[65:91].sum() / total, raw[[33, 44, 46, 58, 59, 63]].sum() / n, (raw[128:].sum() / total), np.log1p(lines),
    ]


class Features:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, count: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), count))
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def pool_adjacent(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The isotonic fit of positive / total per bin, weighted by total; bins without rows take the fit below them."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([positive[i], total[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
    out = np.zeros(len(total))
    for k, (p, t, start) in enumerate(blocks):
        out[(0 if not k else int(start)) :] = p / t
    return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name).flatten()).reshape(-1, STATISTICS) if batch.num_rows else np.zeros((0, STATISTICS))


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _sum_shares(train: DataFrame, features, size: int, folds: int, groups: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of each fold: a share per task, summed in ``groups`` tasks, then on the driver (fixed size)."""
    one = size * size + size
    length = folds * one

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, any_rows = np.zeros((folds, one)), False
        for batch in batches:
            x = _matrix(batch, "x")
            if len(x):
                f, y, fold = features.value(x), batch.column("label").to_numpy().astype(float), batch.column("fold").to_numpy()
                for k in np.unique(fold).tolist():
                    g, z = f[fold == k], y[fold == k]
                    acc[k, : size * size] += (g.T @ g).ravel()
                    acc[k, size * size :] += g.T @ z
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "share": pa.array([acc.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, any_rows = np.zeros(length), False
        for batch in batches:
            for raw in batch.column("share").to_pylist():
                acc += np.frombuffer(raw)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"share": pa.array([acc.tobytes()], pa.binary())})

    shares = train.mapInArrow(share, "slot int, share binary").repartition(groups, "slot").mapInArrow(add, "share binary").collect()  # at most `groups`
    acc = (np.sum([np.frombuffer(r["share"]) for r in shares], axis=0) if shares else np.zeros(length)).reshape(folds, one)
    return acc[:, : size * size].reshape(folds, size, size), acc[:, size * size :]


def _solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights; the penalty grows with the rows, which the constant's own product counts."""
    return np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(len(a)), b)


#: Parts of the training rows; each is scored by weights that were fitted on the others, and calibration sees these scores alone.
INNER = 4


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = 192, width: float = 3.0, ridge: float = 1e-3, folds: int = 5, threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 where score >= threshold), ridge_score."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    rows = stage(statistics(docs, id_col, text_col), "statistics")
    moments = rows.agg(F.count("*").alias("n"), *(f(F.get("x", F.lit(i))).alias(f"{a}{i}") for i in range(STATISTICS) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(STATISTICS)])
    phi = spark.sparkContext.broadcast(Features(mean, scale, features, width, seed))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    train = stage(rows.where(~held).join(known, "doc_id").withColumn("fold", F.pmod(F.floor(code / folds), F.lit(INNER)).cast("int")), "train")
    a, b = _sum_shares(train, phi, features + 1, INNER)
    w = spark.sparkContext.broadcast(_solve(a.sum(0), b.sum(0), ridge))
    others = spark.sparkContext.broadcast(np.stack([_solve(a.sum(0) - a[k], b.sum(0) - b[k], ridge) for k in range(INNER)]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = phi.value(_matrix(batch, "x")) @ w.value
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "ridge_score"])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, fold = phi.value(_matrix(batch, "x")), batch.column("fold").to_numpy()
            s = (f * others.value[fold]).sum(1) if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(s)], names=["label", "ridge_score"])

    bin_of = F.least(F.greatest(F.floor((F.col("ridge_score") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counted = train.select("label", "x", "fold").mapInArrow(unseen, "label int, ridge_score double").groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()  # at most BINS
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        total[r["bin"]], positive[r["bin"]] = r["n"], r["p"]
    fit = pool_adjacent(total, positive) if total.any() else np.full(BINS, 0.5)
    table = F.array(*(F.lit(float(v)) for v in fit))
    out = rows.mapInArrow(raw, "doc_id long, ridge_score double")
    result = out.select("doc_id", held.alias("held_out"), F.get(table, bin_of).alias("score"), "ridge_score")
    return result.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ridge_score")
