"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidied, tidy
from .fitting import isotonic, labelled_sample, remainder

#: Labelled rows that are learned from, about; random features; folds of the calibration.
FIT_ROWS, FEATURES, FOLDS = 20_000, 256, 5
#: Width of the Gaussian kernel, in standard deviations of the statistics; ridge penalty.
KERNEL_WIDTH, RIDGE = 4.0, 1e-3
_BYTES = np.zeros((256, 7))
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*@^~<>{}[]\\|=+_", b".,;:?!'\"()-", (10, 13), range(128, 256))):
    _BYTES[list(_of), _k] = 1
NAMES = ("characters", "words", "word_length", "distinct", "repeats", "upper", "lower", "digits", "symbols", "marks", "lines", "beyond_ascii", "bang", "pipe", "line_copies")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; zeros for an empty one."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _BYTES) / len(raw)
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(text) / n), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        *shares, counts[33] / n, counts[124] / n, 1 - len(set(lines)) / len(lines),
    ]


class Model:
    """Scores of statistics: standardised, lifted to random Fourier features, ridge-weighted, calibrated."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turns = rng.standard_normal((len(mean), FEATURES)) / KERNEL_WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ self.turns + self.phase), np.ones((len(x), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.lift(x) @ self.weights, *self.knots), 0, 1)


def _solve(sums: np.ndarray) -> np.ndarray:
    gram, target, n = sums[:, :-1], sums[:, -1], max(1.0, sums[-1, -2])
    penalty = np.eye(len(gram)) * RIDGE * n / 10
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, target)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, held: int = 0) -> Model:
    """A model learned from about FIT_ROWS labelled rows whose crc32(doc_id as text) mod `by` is not `held`.

    Moments, normal equations (one set for each fold, summed by partition) and the calibration's scores are
    computed where the sample lies, in 8 partitions (of short rows; the texts are read by as many tasks as they
    have). Each row's calibration score comes from the weights
    of the other folds. Without rows of both labels every score is the labels' mean, or 0.5.
    """
    rows = labelled_sample(docs, labels, label, remainder("doc_id", by) != held, FIT_ROWS, seed=4)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "fold"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    fit = materialize(rows.select("text", "y", fold).mapInArrow(tidied(measure), "x array<double>, y int, fold int").repartition(8), "fit")

    def summed(of):
        def run(batches):
            total = 0
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(0).to_pylist())
                    total = total + of(x, batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = [np.frombuffer(r["sums"]) for r in fit.coalesce(8).mapInArrow(run, "sums binary").collect()]  # 8 partitions at most
        return np.sum(got, axis=0) if got else np.empty(0)

    d = len(NAMES)
    moments = summed(lambda x, y, fold: np.concatenate((x.sum(0), (x * x).sum(0), [len(x), y.sum()])))
    if not len(moments):
        return Model(np.zeros(d), np.ones(d))
    n, ones = moments[-2:]
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d : 2 * d] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    model.knots = (np.array([0.0]), np.array([ones / n]))
    if ones in (0, n):
        return model
    width = FEATURES + 1

    def equations(x, y, fold):
        z = model.lift(x)
        out = np.zeros((FOLDS, width, width + 1))
        for k in range(FOLDS):
            zk = z[fold == k]
            out[k] = np.hstack((zk.T @ zk, (zk.T @ y[fold == k])[:, None]))
        return out.ravel()

    sums = summed(equations).reshape(FOLDS, width, width + 1)
    whole = sums.sum(0)
    model.weights = _solve(whole)
    others = np.stack([_solve(whole - s) for s in sums])
    lift = model.lift

    def outside(batches):
        for batch in batches:
            if batch.num_rows:
                z = lift(np.array(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array((z * others[batch.column(2).to_numpy()]).sum(1)), batch.column(1)], names=["s", "y"])

    pairs = fit.mapInArrow(outside, "s double, y int").toArrow()  # the bounded sample's scores
    model.knots = isotonic(pairs.column(0).to_numpy(), pairs.column(1).to_numpy().astype(float))
    return model


def quality_of(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, held: int = 0):
    """A function of a text column: the probability of label 1, under a model fitted on docs and labels."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, by, held))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        tidy()
        return pa.array(model.value.score(np.array([statistics(t) for t in text.to_pylist()]).reshape(-1, len(NAMES))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Every whole text's probability of label 1.

    Returns (doc_id, held_out, score, predicted), one row for each row of docs. Statistics of the text alone go
    into a score. A null text counts as empty and gets the score of an empty text; a null doc_id is held out;
    repeated rows get the same score each; an empty table gives no rows; null labels teach nothing; other columns
    are not read.
    """
    score = quality_of(docs, labels, label, by, held)
    out = F.coalesce(remainder("doc_id", by) == held, F.lit(True)).alias("held_out")
    return docs.select("doc_id", out, score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
