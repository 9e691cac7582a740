"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a document (shares of capitals, symbols, repeated words and so on) are standardised and
sent through random cosines, whose inner products approximate a Gaussian kernel. Each partition of the
sample sums its own normal equations; only the sums are added up. A part of the sample that the ridge
has not seen calibrates its scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import attach, crc_bucket, cut, labelled_sample, pieces, table

#: Labelled rows that the classifier is fitted on at most, cosines, kernel width in deviations, ridge, share for calibration.
SAMPLE, COSINES, WIDTH, RIDGE, CALIBRATE = 20_000, 256, 3.0, 1e-3, 0.3
#: Score from which a document counts as good, and what the folds of the query are.
GOOD, FOLDS, HELD = 0.3, 5, 0

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_+", b"|", b"!", b".,;:?", b"\n", bytes(range(128, 256)), b"\"'()[]{}/\\"]
NAMES = ["words", "length", "distinct", "echo", "lines", "same_lines", "short", "tail"] + [f"class{i}" for i in range(len(_CLASSES))]


def statistics(text: str) -> list[float]:
    """Numbers of NAMES; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in raw.split(b"\n") if x]
    counts = [(size - len(raw.translate(None, c))) / size for c in _CLASSES]
    return [
        np.log1p(n),
        size / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        sum([len(w) <= 3 for w in words]) / n,
        float(lines[-1][-1:] in b".!?"),
        *counts,
    ]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising line through the means of pooled adjacent violators; each mean is drawn to 1/2 by one row."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    at = np.array([b[0] / b[2] for b in blocks])
    return at, np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))


class Model:
    """Everything that scoring needs: a few hundred kilobytes, whatever the size of the data."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(20240)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(len(mean), COSINES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ self.turn + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; beyond the ends of the calibration it goes on towards 0 and 1."""
        raw = self.raw(x)
        at, to = np.concatenate([[min(-1.0, self.at[0] - 1)], self.at, [max(2.0, self.at[-1] + 1)]]), np.concatenate([[self.to[0] / 2], self.to, [(1 + self.to[-1]) / 2]])
        return np.interp(raw, at, to)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Model of label `quality` from at most `sample` labelled rows outside the held-out remainder.

    Without any such row every score is 1/2. Partial sums of at most 16 partitions and the calibration
    part, a share of the sample, come to the driver.
    """
    chosen = labelled_sample(docs, labels, "quality", modulus, held, sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, x.T)], names=["doc_id", "y", *NAMES])

    measured = cut(chosen.mapInArrow(measure, "doc_id bigint, y int, " + ", ".join(f"{n} double" for n in NAMES)))
    moments = measured.agg(F.count(F.lit(1)), *[f(n) for n in NAMES for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array(moments[1::2]), np.maximum(np.array(moments[2::2]), 1e-6))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(1000)) < int(1000 * CALIBRATE)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for batch in batches:
            z = model.features(np.column_stack([c.to_numpy() for c in batch.columns[2:]]))
            total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = measured.where(~part).coalesce(16).mapInArrow(sums, "total binary").collect()
    total = sum((np.frombuffer(p.total).reshape(COSINES + 1, -1) for p in parts), np.zeros((COSINES + 1, COSINES + 2)))
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * max(1.0, total[-1, -2]) * np.eye(COSINES + 1) / COSINES, total[:, -1])
    rows = measured.where(part).select("y", *NAMES).collect()
    if rows:
        x = np.array([r[1:] for r in rows], float)
        model.at, model.to = isotonic(model.raw(x), np.array([r[0] for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = GOOD, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from the threshold on).

    A null text scores as an empty one; each row is scored by its whole text alone. Input columns of
    these two names are replaced, others stay.
    """
    stay = attach(docs, ["score", "predicted"])
    carry = [c for c in stay if c != text_col] + [text_col] * (text_col in stay)
    source = docs.select(*carry, *([] if text_col in carry else [docs[text_col]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            x = np.array([statistics(t.as_py() or "") for t in texts]).reshape(-1, len(NAMES))
            s = model.score(x)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*carry, "score", "predicted"])

    kinds = dict(docs.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["score double", "predicted int"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
