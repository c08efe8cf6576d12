"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line gets features of its own and of the lines before and after it; the chain labels every line good or bad.
Forward-backward gives each line's marginal, and a document's score is their mean weighted by line length. The model
is fitted by gradient descent on the lines of at most SAMPLE labelled documents (those of least hash, so the choice is
fixed), whose features, not texts, reach the driver; scoring runs over all documents in Arrow batches.

Null text and empty text are one empty line and get a score like any other. Copies get equal scores. Only the text is
an input of a score. Labels of documents that do not exist are ignored; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, fresh, map_arrow

#: Most labelled documents that a model is fitted on.
SAMPLE = 4000
THRESHOLD, FOLDS = 0.3, 5
OWN = ("chars", "words", "upper", "symbols", "bars", "bangs", "repeats", "digits", "word_length", "commas", "stops", "longest")
NEAR = ("upper", "symbols", "bars", "bangs", "repeats", "digits")
_UPPER, _SYMBOLS, _DIGITS = bytes(range(65, 91)), b"#$%&*<>@^~_=+{}[]\\", b"0123456789"


def line_features(line: bytes) -> tuple[float, ...]:
    """Features OWN of one line of UTF-8."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * len(OWN)
    share = lambda chars: size - len(line.translate(None, chars))
    return (
        min(size, 2000) ** 0.5 / 10, min(n, 400) ** 0.5 / 5, share(_UPPER) / size, min(share(_SYMBOLS) / n, 3.0), min(line.count(b"|") / n, 2.0),
        min(line.count(b"!") / n, 3.0), 1 - len(set(words)) / n, share(_DIGITS) / size, min((size - n + 1) / n, 30.0) / 10,
        min(line.count(b",") / n, 1.0), min(line.count(b".") / n, 1.0), min(max(map(len, words)), 60) / 20,
    )


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features with those of the neighbours) and the lengths of the lines, at least 1 each."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    own = np.array([line_features(x) for x in lines], np.float32)
    near = own[:, [OWN.index(x) for x in NEAR]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    return np.concatenate([own, before, after], 1), np.array([max(len(x), 1) for x in lines], np.float64)


@dataclass
class LineCrf:
    """Weights of the good label for standardized features, and the transitions between bad (0) and good (1)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the marginals of the good label, for each document's (features, lengths)."""
        if not docs:
            return np.zeros(0)
        sizes = np.array([len(w) for _, w in docs])
        order = np.argsort(-sizes, kind="stable")
        flat = self.unary(np.concatenate([docs[i][0] for i in order]))
        marginal, _, _ = chain(flat, sizes[order], self.transition)
        weight = np.concatenate([docs[i][1] for i in order])
        starts = np.cumsum(sizes[order]) - sizes[order]
        out = np.empty(len(docs))
        out[order] = np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts)
        return np.clip(out, 0.0, 1.0)


def chain(unary: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once; sizes fall, unary (score of label 1) is laid out chain by chain.

    Gives the marginals of label 1, the expected transition counts and the sum of the log partition functions.
    """
    starts, steps = np.cumsum(sizes) - sizes, int(sizes.max())
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than i
    fore, back = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    emit = np.stack([np.zeros_like(unary), unary], 1)
    fore[starts] = emit[starts]
    for i in range(1, steps):
        at = starts[: live[i]] + i
        fore[at] = np.logaddexp(fore[at - 1, 0, None] + transition[0], fore[at - 1, 1, None] + transition[1]) + emit[at]
    for i in range(steps - 1, 0, -1):
        at = starts[: live[i]] + i
        nxt = emit[at] + back[at]
        back[at - 1] = np.logaddexp(nxt[:, 0, None] + transition[:, 0], nxt[:, 1, None] + transition[:, 1])
    ends = starts + sizes - 1
    total = np.logaddexp(fore[ends, 0], fore[ends, 1])
    z = np.repeat(total, sizes)
    marginal = np.exp(np.minimum(fore[:, 1] + back[:, 1] - z, 0))
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = np.exp(fore[at - 1][:, :, None] + transition[None] + (emit[at] + back[at])[:, None, :] - z[at, None, None]).sum(0)
    return marginal, pair, float(total.sum())


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 150, l2: float = 1e-3) -> LineCrf:
    """Maximum likelihood of each document's lines carrying its label, by Adam on all lines."""
    width = len(OWN) + 2 * len(NEAR)
    model = LineCrf(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    if not docs or len(set(labels)) < 2:
        model.bias = 0.0 if not labels else 6.0 * (2 * labels[0] - 1)
        return model
    sizes = np.array([len(w) for _, w in docs])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    x = np.concatenate([docs[i][0] for i in order]).astype(np.float64)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - model.mean) / model.scale
    y = np.repeat(np.array(labels)[order], sizes)
    labelled = np.array(labels)[order]
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = (sizes[labelled == v] - 1).sum()
    theta, m, s = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5)
    for t in range(1, steps + 1):
        w, b, a = theta[:width], theta[width], theta[width + 1 :].reshape(2, 2)
        marginal, pair, _ = chain(x @ w + b, sizes, a)
        miss = (y - marginal) / len(y)
        grad = np.concatenate([x.T @ miss - l2 * w, [miss.sum()], ((seen - pair) / len(y) - l2 * a).ravel()])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    model.weights, model.bias, model.transition = theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from fitting: crc32 of its id as text, modulo FOLDS, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineCrf:
    """A model fitted on at most sample labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = checkpointed(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    ids = chosen.select(F.col("doc_id").alias("_id"), "quality")
    ids = F.broadcast(ids) if sample <= BROADCAST_ROWS else ids
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("_id", "text", "quality")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f.ravel() for f, _ in found], pa.list_(pa.float32())), pa.array([w for _, w in found], pa.list_(pa.float64()))], names=["id", "quality", "features", "weights"])

    got = map_arrow(rows, work, "id long, quality int, features array<float>, weights array<double>").toArrow().sort_by("id")
    weights = got.column("weights").to_pylist()
    features = [np.array(f, np.float32).reshape(len(w), -1) for f, w in zip(got.column("features").to_pylist(), weights, strict=True)]
    return fit([*zip(features, map(np.array, weights), strict=True)], got.column("quality").to_pylist())


def scored(docs: DataFrame, model: LineCrf, columns: list[str], out: str = "score") -> DataFrame:
    """The given columns of docs and the score of each text."""
    frame = docs.select(*columns, F.col("text").alias(fresh("_text", columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema[: len(columns)]) + f", `{out}` double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.scores([document_features(t) for t in b.column(len(columns)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(score, pa.float64())], names=[*columns, out])

    return map_arrow(frame, work, schema)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, trained(docs, labels, sample), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: LineCrf) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    score = fresh("_score", docs.columns)
    return scored(docs, model, docs.columns, score).where(F.col(score) >= THRESHOLD).drop(score)
