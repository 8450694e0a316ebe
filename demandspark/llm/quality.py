"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence are shape features of its own and of the lines
before and after it; transition weights tie neighbours together. Documents are labelled,
so in training all lines of a document carry its label. A document's score is the mean of
its lines' forward-backward marginals, weighted by their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches

SAMPLE_DOCS = 6000
# documents of more lines are not drawn for training; they are scored like all others
SAMPLE_LINES = 400
STEPS = 200
RATE = 0.1
PENALTY = 1e-3
# classes of code points: space, lower, upper, digit, sentence punctuation, bar, other
_CLASSES: list[np.ndarray] = []
_N_CLASSES = 7
N_OWN = 14


def _classes() -> np.ndarray:
    if not _CLASSES:
        table = np.full(0x110000, 6, np.int8)
        for c in range(0x110000):
            x = chr(c)
            if x.isspace():
                table[c] = 0
            elif x.isalpha():
                table[c] = 2 if x.isupper() else 1
            elif x.isdigit():
                table[c] = 3
        table[[ord(x) for x in ".,;:?'\"()-"]] = 4
        table[ord("|")] = 5
        _CLASSES.append(table)
    return _CLASSES[0]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths) of a whole text; an empty text is one empty line."""
    lines = (text or "").split("\n")
    lengths = np.array([len(x) for x in lines])
    kinds = _classes()[np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "replace"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    of = np.repeat(np.arange(len(lines)), lengths + 1)
    counts = np.bincount(of * _N_CLASSES + kinds, minlength=len(lines) * _N_CLASSES).reshape(-1, _N_CLASSES).astype(float)
    size = np.maximum(lengths, 1)
    letters = counts[:, 1] + counts[:, 2]
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    last = kinds[np.maximum(starts + lengths - 1, 0)]
    own = np.column_stack([
        np.log1p(lengths) / 5,
        letters / size,
        counts[:, 2] / np.maximum(letters, 1),
        counts[:, 3] / size,
        counts[:, 4] / size,
        counts[:, 5] / size * 5,
        counts[:, 6] / size,
        distinct / np.maximum(n_words, 1),
        np.log1p(n_words - distinct) / 3,
        np.minimum(letters / np.maximum(n_words, 1), 30) / 10,
        last == 4,
        np.minimum(counts[:, 6] / np.maximum(n_words, 1), 5),
        n_words <= 3,
        n_words == 0,
    ]).astype(float)
    edge = np.zeros((1, N_OWN))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    first, final = np.zeros((len(lines), 1)), np.zeros((len(lines), 1))
    first[0], final[-1] = 1, 1
    return np.hstack([own, before, after, first, final]), lengths + 1


@dataclass
class ChainModel:
    """Good against bad: feature weights, a bias, and the log weights of transitions [from, to]."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def score(self, text: str | None) -> float:
        features, lengths = line_features(text)
        logit = np.clip((features - self.centre) / self.scale @ self.weights + self.bias, -12, 12)
        odds = np.exp(logit).tolist()
        (t00, t01), (t10, t11) = np.exp(self.moves).tolist()
        # odds of good against bad: messages from the left and from the right
        left, r = [], None
        for e in odds:
            r = e if r is None else e * (r * t11 + t01) / (r * t10 + t00)
            left.append(r)
        total, b = 0.0, 1.0
        for i in range(len(odds) - 1, -1, -1):
            p = left[i] * b
            total += lengths[i] * p / (1 + p)
            r = odds[i] * b
            b = (t10 + t11 * r) / (t00 + t01 * r)
        return min(1.0, max(0.0, total / float(lengths.sum())))


def fit(documents: list[tuple[np.ndarray, int]]) -> ChainModel:
    """Maximum conditional likelihood, penalised, of documents (features, label); each weighs the same."""
    if not documents:
        n = 3 * N_OWN + 2
        return ChainModel(np.zeros(n), np.ones(n), np.zeros(n), 0.0, np.zeros((2, 2)))
    documents = sorted(documents, key=lambda d: -len(d[0]))
    x = np.vstack([d[0] for d in documents])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - centre) / scale
    sizes = np.array([len(d[0]) for d in documents])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label = np.array([d[1] for d in documents], float)
    at = [starts[: int((sizes > t).sum())] + t for t in range(sizes[0])]
    y = np.repeat(label, sizes)
    weight = np.repeat(1.0 / sizes, sizes) / len(documents)
    links = (sizes - 1) / sizes / len(documents)
    params = np.zeros(x.shape[1] + 5)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        emit = np.exp(np.clip(x @ params[:-5] + params[-5], -12, 12))
        t = np.exp(params[-4:].reshape(2, 2))
        left, right = np.empty(len(x)), np.ones(len(x))
        for k, rows in enumerate(at):
            if k:
                r = left[at[k - 1][: len(rows)]]
                left[rows] = emit[rows] * (r * t[1, 1] + t[0, 1]) / (r * t[1, 0] + t[0, 0])
            else:
                left[rows] = emit[rows]
        pair = np.zeros(4)
        for k in range(len(at) - 1, 0, -1):
            rows, prior = at[k], at[k - 1][: len(at[k])]
            r = emit[rows] * right[rows]
            right[prior] = (t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)
            a = left[prior]
            joint = np.column_stack([np.full(len(r), t[0, 0]), t[0, 1] * r, a * t[1, 0], a * t[1, 1] * r])
            pair += (joint / joint.sum(1, keepdims=True) * weight[rows][:, None]).sum(0)
        good = left * right / (1 + left * right)
        gap = (y - good) * weight
        seen = np.array([(links * (label == 0)).sum(), 0, 0, (links * (label == 1)).sum()])
        slope = np.concatenate([x.T @ gap, [gap.sum()], seen - pair]) - PENALTY * params
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        params += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return ChainModel(centre, scale, params[:-5], float(params[-5]), params[-4:].reshape(2, 2))


def learn(labelled: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", sample: int = SAMPLE_DOCS) -> ChainModel:
    """Fits on about ``sample`` labelled documents at most, the same part of each label.

    Drawn by a hash of their id among documents of at most ``SAMPLE_LINES`` lines; null
    texts and labels teach nothing. Without labelled rows every text scores 0.5.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("text IS NOT NULL AND label IN (0, 1)").filter(F.size(F.split("text", "\n", -1)) <= SAMPLE_LINES)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return fit([])
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = min(1.0, sample / sum(sizes.values()))
    chosen = rows.filter(draw < part).select("text", "label")

    def features(batches):
        for batch in batches:
            for value, y in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                x, _ = line_features(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()), pa.array([y], pa.int32())], names=["x", "label"])

    width = 3 * N_OWN + 2
    got = in_batches(chosen).mapInArrow(features, "x binary, label int").collect()
    documents = sorted((bytes(r["x"]), r["label"]) for r in got)  # reruns add in one order
    return fit([(np.frombuffer(x, np.float32).reshape(-1, width).astype(float), y) for x, y in documents])


def score(docs: DataFrame, model: ChainModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null and empty texts score as one empty line. Other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.score(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
