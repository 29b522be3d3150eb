"""Model-facing jobs: batch scoring, probes, features, retrieval (M1-M4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators.aggregates import stitch_overlap
from pulsegrid.scale import position, running_sum, seeded_hash
from pulsegrid.session import cut, small_rows

Scorer = Callable[[np.ndarray], np.ndarray]
CHUNK_SLICE = 4096
LANES = 16


def linear_scorer(width: int, outputs: int) -> Scorer:
    """Default scorer: fixed cosine weights, so results need no model file."""
    weights = np.cos(np.outer(np.arange(1, width + 1), np.arange(1, outputs + 1)))
    return lambda batch: batch @ weights


def score_batches(df: DataFrame, scorer: Scorer, keep: Sequence[str], vector: str = "embedding", out: str = "scores") -> DataFrame:
    """M1: apply ``scorer`` to Arrow batches; null inputs and outputs become 0.

    ``keep`` columns (ids, labels) pass through.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    names = [f.name for f in df.schema if f.name in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            matrix = np.stack([np.asarray(v, dtype=np.float64) for v in batch[vector]])
            scored = np.nan_to_num(scorer(np.nan_to_num(matrix, nan=0.0)), nan=0.0)
            result = batch[names].copy()
            result[out] = list(scored)
            yield result

    filled = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return df.select(*names, filled.alias(vector)).mapInPandas(run, f"{schema}, `{out}` array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; null cells are not a number."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


class Descent:
    """Quasi-Newton steps (limited memory) for many independent convex problems side by side.

    Every problem keeps its own point, direction and step. It is told loss and
    gradient at its trial point; a trial that lowers the loss enough becomes
    its point, any other is tried again closer by.
    """

    MEMORY, ENOUGH = 10, 1e-4

    def __init__(self, start: np.ndarray):
        self.point, self.trial = start.copy(), start.copy()
        self.loss = np.full(len(start), np.inf)
        self.gradient, self.direction = np.zeros_like(start), np.zeros_like(start)
        self.step = np.ones(len(start))
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in start]

    def tell(self, loss: np.ndarray, gradient: np.ndarray) -> None:
        for k in range(len(loss)):
            slope = float(self.gradient[k] @ self.direction[k])
            if not loss[k] <= self.loss[k] + self.ENOUGH * self.step[k] * slope + 1e-15:
                self.step[k] /= 2
            else:
                if np.isfinite(self.loss[k]):
                    moved, turned = self.trial[k] - self.point[k], gradient[k] - self.gradient[k]
                    if moved @ turned > 1e-14:
                        self.pairs[k] = [*self.pairs[k][1 - self.MEMORY :], (moved, turned)]
                first = not self.pairs[k]
                self.point[k], self.loss[k], self.gradient[k] = self.trial[k], loss[k], gradient[k]
                self.direction[k] = -self._scaled(k)
                self.step[k] = min(1.0, 1.0 / max(np.abs(gradient[k]).sum(), 1e-12)) if first else 1.0
            self.trial[k] = self.point[k] + self.step[k] * self.direction[k]

    def _scaled(self, k: int) -> np.ndarray:
        q, past = self.gradient[k].copy(), []
        for moved, turned in reversed(self.pairs[k]):
            part = (moved @ q) / (moved @ turned)
            past.append(part)
            q -= part * turned
        if self.pairs[k]:
            moved, turned = self.pairs[k][-1]
            q *= (moved @ turned) / (turned @ turned)
        for (moved, turned), part in zip(self.pairs[k], reversed(past)):
            q += (part - (turned @ q) / (moved @ turned)) * moved
        return q

    def open(self, tolerance: float) -> bool:
        """Is any gradient above the tolerance, where a step can still be seen?"""
        worth = np.abs(self.gradient).max(axis=1) > tolerance
        return bool((worth & (self.step > 1e-12)).any())


@dataclass(frozen=True)
class Probe:
    """Weights of all classifiers, intercept last; ``slope`` is the largest part of each gradient."""

    labels: tuple[str, ...]
    weights: np.ndarray
    slope: np.ndarray
    passes: int


def fit_probe(rows: DataFrame, vector: str, targets: Sequence[str], iterations: int = 100, penalty: float = 0.0, tolerance: float = 1e-6) -> Probe:
    """M2: a logistic classifier per target column, all in one weight matrix.

    Minimised per target: mean loss of its known rows plus ``penalty`` / 2
    times the squared weights without the intercept. One pass over the rows
    gives loss and gradient of all targets: a task multiplies its batches with
    the broadcast weights, sums its rows into one matrix, and the matrices of
    tasks are added in ``LANES`` lanes before they reach the driver. Passes
    end when all gradients are below ``tolerance``, or after ``iterations``.
    Targets with one class are left out. Rows with a null vector or one of another
    width than the first are an error; null components count as zero.
    """
    spark = rows.sparkSession
    body = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    known = F.array(*[F.col(f"`{t}`").cast("double") for t in targets])
    table = cut(rows.select(body.alias("x"), known.alias("y")))
    first = table.select(F.size("x").alias("n")).first()
    width, k = (first["n"] if first else 0), len(targets)
    size = width + 1

    def one_pass(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(at)

        def add(batches: Iterator[pa.RecordBatch]):
            w, total = shared.value, np.zeros((k, size + 3))
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    part = batch.slice(begin, 4096)
                    x = np.hstack([_matrix(part.column("x"), width), np.ones((part.num_rows, 1))])
                    y = _matrix(part.column("y"), k)
                    seen = ~np.isnan(y)
                    y = np.where(seen, y, 0.0)
                    z = x @ w.T
                    total[:, :size] += (np.where(seen, 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y, 0.0)).T @ x
                    total[:, size] += np.where(seen, np.logaddexp(0.0, z) - y * z, 0.0).sum(axis=0)
                    total[:, size + 1] += seen.sum(axis=0)
                    total[:, size + 2] += y.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def merge(batches: Iterator[pa.RecordBatch]):
            total, found = np.zeros((k, size + 3)), False
            for batch in batches:
                for part in batch.column("sums").to_pylist():
                    total, found = total + np.frombuffer(part).reshape(k, -1), True
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        lanes = table.mapInArrow(add, "sums binary").repartition(LANES).mapInArrow(merge, "sums binary")
        total = sum((np.frombuffer(r["sums"]).reshape(k, -1) for r in small_rows(lanes, LANES)), np.zeros((k, size + 3)))
        shared.destroy()
        n = np.maximum(total[:, size + 1], 1.0)
        ridge = np.hstack([at[:, :width], np.zeros((k, 1))])
        loss = total[:, size] / n + penalty / 2 * (ridge**2).sum(axis=1)
        return loss, total[:, :size] / n[:, None] + penalty * ridge, total[:, size + 1], total[:, size + 2]

    search = Descent(np.zeros((k, size)))
    passes, usable = 0, None
    while passes < max(1, iterations):
        loss, gradient, n, positives = one_pass(search.trial)
        if usable is None:
            usable = (positives > 0) & (positives < n)
        gradient[~usable] = 0.0
        search.tell(loss, gradient)
        passes += 1
        if not search.open(tolerance):
            break
    at = np.flatnonzero(usable)
    if not len(at):
        raise ValueError("no target has both classes in the training rows")
    return Probe(tuple(targets[i] for i in at), search.point[at], np.abs(search.gradient[at]).max(axis=1), passes)


def linear_probe(
    df: DataFrame, vector: str, targets: Sequence[str], train: Column, key: str, iterations: int = 100, penalty: float = 0.0
) -> DataFrame:
    """M2: one binary classifier per target column, fit on training rows.

    Rows with a null target stay out of that fit. Returns long
    ``(key, label, target, score)`` for the other rows, scored for all labels
    in one pass; a target with one class gets no scores.
    """
    probe = fit_probe(df.where(train), vector, targets, iterations, penalty)
    shared = df.sparkSession.sparkContext.broadcast(probe)
    body = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    known = F.array(*[F.col(f"`{t}`").cast("double") for t in probe.labels])
    held = df.where(~train).select(key, body.alias("_x"), known.alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]):
        w = shared.value.weights
        for batch in batches:
            z = _matrix(batch.column("_x"), w.shape[1] - 1) @ w[:, :-1].T + w[:, -1]
            scores = pa.array(list(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_y"), scores], names=[key, "_y", "_p"])

    scored = held.mapInArrow(run, StructType([held.schema[key], *StructType.fromDDL("_y array<double>, _p array<double>")]))
    names = F.array(*[F.lit(t) for t in probe.labels])
    cells = scored.select(key, F.explode(F.arrays_zip(names.alias("label"), F.col("_y").alias("target"), F.col("_p").alias("score"))).alias("c"))
    return cells.select(key, "c.label", "c.target", "c.score")


def export_features(
    chunks: DataFrame, by: Sequence[str], stride: int | None = None, chunk: str = "chunk", values: str = "values"
) -> DataFrame:
    """M3: features per absolute position, with the record's feature length.

    With a stride overlapping positions are averaged, without one chunks of
    any sizes are laid end to end. The long form has no limit on record length.
    """
    if stride is not None:
        feats = stitch_overlap(chunks, by, stride, chunk, values)
    else:
        sizes = chunks.select(*by, chunk, F.coalesce(F.size(values), F.lit(0)).cast("long").alias("_n"), F.col(values).alias("_values"))
        begun = running_sum(sizes, by, [chunk], {"_begin": F.col("_n")}, slice_by=F.floor(F.col(chunk) / CHUNK_SLICE))
        placed = begun.select(*by, "_begin", F.posexplode("_values").alias("_i", "value"))
        feats = placed.select(*by, (F.col("_begin") + F.col("_i")).cast("long").alias("pos"), "value")
    lengths = feats.groupBy(*by).agg(F.count(F.lit(1)).alias("length"))
    return feats.join(lengths, list(by))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def retrieval_scores(
    steps: DataFrame, ahead: int, negatives: int, seed: int, temperature: float = 1.0, cosine: bool = False,
    record: str = "record_id", step: str = "step", predicted: str = "predicted", encoded: str = "encoded",
    same_record: bool = False, interval: int = 0,
) -> DataFrame:
    """M4: per step, loss and hit of finding the true future among sampled ones.

    The positive is the encoding ``ahead`` steps later in the same record.
    Negatives are drawn by hash, never the positive itself, from the whole
    table, from the same record, or from steps around the anchor, and are
    joined by their dense position. Result: record, step, loss, hit.
    """
    if cosine:

        def unit(c: str) -> Column:
            size = F.sqrt(dot(F.col(c), F.col(c)))
            return F.transform(c, lambda x: x / size)

        steps = steps.withColumns({c: unit(c) for c in (predicted, encoded)})
    sizes = steps.groupBy(record).agg(F.max(step).alias("_last"), F.min(step).alias("_first"))
    numbered = position(steps.select(record, step), [], [record, step], "_idx")
    future = steps.select(record, (F.col(step) - ahead).alias(step), F.col(encoded).alias("_positive"))
    anchors = steps.join(future, [record, step]).select(record, step, predicted, (dot(F.col(predicted), F.col("_positive")) / temperature).alias("_hit"))
    keyed = numbered.join(sizes, record)
    draw = seeded_hash(seed, record, step, "_k")
    picks = keyed.where(F.col(step) + ahead <= F.col("_last")).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1)))
    )
    true_idx = F.col("_idx") + ahead
    if same_record or interval > 0:
        low = F.col("_first") if interval == 0 else F.greatest(F.col("_first"), F.col(step) - interval)
        high = F.col("_last") if interval == 0 else F.least(F.col("_last"), F.col(step) + interval)
        base = F.col("_idx") - F.col(step) + low
        inside = (F.col(step) + ahead >= low) & (F.col(step) + ahead <= high)
        room = high - low + 1 - inside.cast("int")
        at = base + F.pmod(draw, F.greatest(room, F.lit(1)))
        target = F.when(inside & (at >= true_idx), at + 1).otherwise(at)
        picks = picks.where(room > 0).withColumn("_pick", target)
    else:
        total = numbered.agg(F.count(F.lit(1))).scalar()
        at = F.pmod(draw, total - 1)
        picks = picks.withColumn("_pick", F.when(at >= true_idx, at + 1).otherwise(at))
    where = numbered.select(F.col("_idx").alias("_pick"), F.col(record).alias("_r"), F.col(step).alias("_s"))
    bank = steps.select(F.col(record).alias("_r"), F.col(step).alias("_s"), F.col(encoded).alias("_negative"))
    vectors = where.join(bank, ["_r", "_s"]).drop("_r", "_s")
    others = picks.select(record, step, "_pick").join(vectors, "_pick").join(anchors, [record, step])
    score = dot(F.col(predicted), F.col("_negative")) / temperature
    merged = others.withColumn("_score", score).groupBy(record, step).agg(
        F.first("_hit").alias("_hit"),
        F.max("_score").alias("_top"),
        F.sum(F.exp(F.col("_score") - F.col("_hit"))).alias("_mass"),
    )
    return merged.select(
        record, step, F.log1p("_mass").alias("loss"), (F.col("_hit") >= F.col("_top")).cast("int").alias("hit")
    )
