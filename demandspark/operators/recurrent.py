"""Two gated recurrent layers and a linear output, trained on windows of all series.

Spark keeps the windows and sums the gradient of each epoch over partitions; the driver
holds the weights alone, whose number depends on the units and not on the data. An epoch
is one step of Adam along the gradient of all windows. Units left out in training are drawn
by hash of window, epoch and unit, so that a rerun, a retried task or another partitioning
gives the same network but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# windows of one pass through the layers: bounds the memory of a task whatever the Arrow batch
ROWS = 512
UNITS = 16
EPOCHS = 60
RATE = 0.02
DROPOUT = 0.2
MEASURES = ("n", "squared", "absolute")
SPLITS = ("train", "validation")


@dataclass(frozen=True)
class Network:
    """Weights as one vector; ``units`` of each layer and ``length`` of the windows fix its parts."""

    units: int
    length: int
    weights: np.ndarray

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Next value of every row of ``windows`` (rows, length)."""
        return forward(self.weights, self.units, windows)[0]


def shapes(units: int) -> list[tuple[int, ...]]:
    """Input, recurrent and bias weights of both layers, then weights and bias of the output."""
    gates = 4 * units
    return [(1, gates), (units, gates), (gates,), (units, gates), (units, gates), (gates,), (units,), (1,)]


def parts(weights: np.ndarray, units: int) -> list[np.ndarray]:
    """Views of the weights in the order of ``shapes``."""
    out, at = [], 0
    for shape in shapes(units):
        size = int(np.prod(shape))
        out.append(weights[at:at + size].reshape(shape))
        at += size
    return out


def initial(units: int, seed: int) -> np.ndarray:
    """Uniform weights by fan-in and fan-out, zero biases, one for the gates that keep the state."""
    draw = np.random.default_rng(seed)
    weights = np.zeros(sum(int(np.prod(s)) for s in shapes(units)))
    for part in parts(weights, units):
        if part.ndim == 2:
            bound = np.sqrt(6.0 / sum(part.shape))
            part[:] = draw.uniform(-bound, bound, part.shape)
        elif part.size == 4 * units:
            part[units:2 * units] = 1.0
        elif part.size == units and units > 1:
            part[:] = draw.uniform(-1, 1, units) * np.sqrt(6.0 / (units + 1))
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _layer(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """(output at each step, what the way back needs) for ``x`` (steps, rows, inputs)."""
    units = u.shape[0]
    h = c = np.zeros((x.shape[1], units))
    out, memory = [], []
    for now in x:
        z = now @ w + h @ u + b
        take, keep, show = (_sigmoid(z[:, k * units:(k + 1) * units]) for k in (0, 1, 3))
        new = np.tanh(z[:, 2 * units:3 * units])
        before, c = c, keep * c + take * new
        shown = np.tanh(c)
        memory.append((now, h, before, take, keep, new, show, shown))
        h = show * shown
        out.append(h)
    return np.stack(out), memory


def _layer_back(d_out: np.ndarray, memory: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the layer's input and its three weights from that of its output."""
    d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(u.shape[1])
    d_h = d_c = np.zeros(d_out.shape[1:])
    d_x = []
    for step in range(len(memory) - 1, -1, -1):
        now, h, before, take, keep, new, show, shown = memory[step]
        d_h = d_h + d_out[step]
        d_c = d_c + d_h * show * (1 - shown * shown)
        d_z = np.concatenate([
            d_c * new * take * (1 - take),
            d_c * before * keep * (1 - keep),
            d_c * take * (1 - new * new),
            d_h * shown * show * (1 - show),
        ], axis=1)
        d_w += now.T @ d_z
        d_u += h.T @ d_z
        d_b += d_z.sum(axis=0)
        d_x.append(d_z @ w.T)
        d_h, d_c = d_z @ u.T, d_c * keep
    return np.stack(d_x[::-1]), d_w, d_u, d_b


def forward(weights: np.ndarray, units: int, windows: np.ndarray, masks: tuple = (1.0, 1.0)) -> tuple:
    """(predictions, what the gradient needs)."""
    w1, u1, b1, w2, u2, b2, w3, b3 = parts(weights, units)
    first, memory1 = _layer(windows.T[:, :, None], w1, u1, b1)
    second, memory2 = _layer(first * masks[0], w2, u2, b2)
    last = second[-1] * masks[1]
    return last @ w3 + b3[0], (memory1, memory2, last)


def gradient(weights: np.ndarray, units: int, windows: np.ndarray, labels: np.ndarray,
             masks: tuple = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the sum of squared errors over the rows, predictions)."""
    w1, u1, _, w2, u2, _, w3, _ = parts(weights, units)
    guess, (memory1, memory2, last) = forward(weights, units, windows, masks)
    d_guess = 2.0 * (guess - labels)
    d_second = np.zeros((len(memory2), *last.shape))
    d_second[-1] = d_guess[:, None] * w3 * masks[1]
    d_first, d_w2, d_u2, d_b2 = _layer_back(d_second, memory2, w2, u2)
    _, d_w1, d_u1, d_b1 = _layer_back(d_first * masks[0], memory1, w1, u1)
    pieces = (d_w1, d_u1, d_b1, d_w2, d_u2, d_b2, d_guess @ last, d_guess.sum())
    return np.concatenate([np.ravel(p) for p in pieces]), guess


def _uniform(ids: np.ndarray, epoch: int, count: int) -> np.ndarray:
    """(rows, count) numbers in [0, 1) that depend on id, epoch and position alone."""
    with np.errstate(over="ignore"):
        z = ids[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = z + np.uint64(epoch + 1) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0 ** -53


def masks_of(ids: np.ndarray, epoch: int, length: int, units: int, dropout: float) -> tuple:
    """Factors of both layers' outputs: 0 for units left out, the others raised to keep the mean."""
    if not dropout:
        return 1.0, 1.0
    kept = (_uniform(ids, epoch, (length + 1) * units) >= dropout) / (1.0 - dropout)
    steps = kept[:, :length * units].reshape(len(ids), length, units).transpose(1, 0, 2)
    return steps, kept[:, length * units:]


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, length)


def _pass(weights: np.ndarray, units: int, length: int, epoch: int, dropout: float, learn: bool) -> Callable:
    """One epoch of a task: (position, value) sums of the gradient, then of each split's measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.size)
        measured = np.zeros((len(SPLITS), len(MEASURES)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x, y = _matrix(rows["sequence"], length), np.asarray(rows["label"], dtype=float)
                learns = np.asarray(rows["learns"], dtype=bool)
                ids = np.asarray(rows["id"], dtype=np.int64).view(np.uint64)
                for k, here in enumerate((learns, ~learns)):
                    if not here.any():
                        continue
                    if learn and k == 0:
                        masks = masks_of(ids[here], epoch, length, units, dropout)
                        slope, guess = gradient(weights, units, x[here], y[here], masks)
                        total += slope
                    else:
                        guess = forward(weights, units, x[here])[0]
                    miss = guess - y[here]
                    measured[k] += here.sum(), (miss ** 2).sum(), np.abs(miss).sum()
        values = np.concatenate([total, measured.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values)], ["position", "value"])

    return run


def _sums(windows: DataFrame, run: Callable, size: int) -> np.ndarray:
    found = windows.mapInArrow(run, "position int, value double").groupBy("position").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in found.collect():  # as many as there are weights
        out[row.position] = row.value
    return out


def fit(windows: DataFrame, identity: list[str], length: int, units: int = UNITS, epochs: int = EPOCHS,
        rate: float = RATE, dropout: float = DROPOUT, seed: int = 7) -> tuple[Network, DataFrame, DataFrame]:
    """(network, errors per split, history) from ``windows`` (identity, sequence, label, split).

    ``identity`` names the columns that tell windows apart. Errors are mean squared and absolute
    ones of the last weights; history has them before each epoch's step, those of the training rows
    with that epoch's units left out. Windows with a null or non-finite number teach nothing and
    are left out of both. Without a window to learn from all weights are zero: every prediction is
    the mean of its series.
    """
    spark = windows.sparkSession
    sound = "forall(sequence, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    known = windows.select(
        F.xxhash64(F.lit(seed), *identity).alias("id"), "sequence", F.col("label").cast("double").alias("label"),
        (F.col("split") == SPLITS[0]).alias("learns"),
    ).filter(F.expr(f"{sound} AND label IS NOT NULL AND NOT isnan(label) AND abs(label) < double('Infinity')"))
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    # one wave of tasks an epoch, without moving rows
    dealt = known.coalesce(max(1, spark.sparkContext.defaultParallelism))
    weights = initial(units, seed)
    speed, square = np.zeros_like(weights), np.zeros_like(weights)
    history = []
    for epoch in range(epochs + 1):
        last = epoch == epochs
        sums = _sums(dealt, _pass(weights, units, length, epoch, dropout, not last),
                     weights.size + len(SPLITS) * len(MEASURES))
        measured = sums[weights.size:].reshape(len(SPLITS), len(MEASURES))
        n = measured[0, 0]
        if not n:
            weights = np.zeros_like(weights)
        for split, (count, squared, absolute) in zip(SPLITS, measured):
            if count and n:
                history.append((epoch, split, int(count), float(squared / count), float(absolute / count)))
        if last or not n:
            break
        slope = sums[:weights.size] / n
        speed, square = 0.9 * speed + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        step = (speed / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(square / (1 - 0.999 ** (epoch + 1))) + 1e-7)
        weights = weights - rate * step
    known.unpersist()
    table = spark.createDataFrame(history, "epoch int, split string, n long, mse double, mae double")
    return Network(units, length, weights), table.filter(F.col("epoch") == epochs).drop("epoch"), table


def with_path(start: DataFrame, network: Network, horizon: int) -> DataFrame:
    """Adds ``_path``: ``horizon`` predictions after the array ``state``, each fed back as the newest value.

    A state that holds a null or non-finite number has a path of nulls.
    """
    schema = StructType([*start.schema.fields, StructField("_path", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                window = _matrix(rows["state"], network.length)
                steps = []
                for _ in range(horizon):
                    steps.append(network.predict(window))
                    window = np.column_stack([window[:, 1:], steps[-1]])
                path = np.array(steps).T
                paths = [row.tolist() if np.isfinite(row).all() else [None] * horizon for row in path]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(paths, pa.list_(pa.float64()))], [*rows.schema.names, "_path"])

    return start.mapInArrow(run, schema)
