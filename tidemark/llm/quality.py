"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing: every piece of text (a run of word characters or of signs) is
hashed to one of ``BUCKETS`` rows and has a random index vector with two non-zero
entries. A row's vector is the sum of the index vectors of all pieces that stand
within two places of it, over all whole texts. Sums are whole numbers, added in
each task first, so the result does not depend on the order of tasks; the table
has a fixed size.

A document is the mean, the spread and the product of neighbours of its pieces'
vectors. A network with one hidden layer, fitted with numpy on a bounded sample of
labelled documents, gives a score; a temperature fitted on other labelled
documents makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbits import BLANK_WORDS, binary, chunks, extend, map_batches, mix, word_hashes

BUCKETS, DIM, BLOCK = 1 << 14, 32, 512
HIDDEN = 24
#: Most labelled rows that the network is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = 3 * DIM + 2

_SIGN = BLANK_WORDS.copy()
_SIGN[0x30:0x3A] = _SIGN[0x41:0x5B] = _SIGN[0x61:0x7B] = False
_SIGN[0x80:] = False
_LETTER = BLANK_WORDS & ~_SIGN


def pieces(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of word characters or signs, and the index of its text."""
    kind = _LETTER[buf].astype(np.int8) + 2 * _SIGN[buf].astype(np.int8)
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    ends = np.r_[edge[1:], buf.size]
    some = kind[edge] != 0
    starts, ends = edge[some], ends[some]
    text = np.searchsorted(at, starts, "right") - 1
    return (word_hashes(buf, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64), text


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places of the +1 and of the -1 in each bucket's index vector."""
    h = mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(0xABCDEF))
    plus = (h % np.uint64(DIM)).astype(np.int64)
    minus = (plus + 1 + ((h >> np.uint64(32)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM
    return plus, minus


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The unit vectors of all buckets (BUCKETS x DIM); a bucket that no piece fell into has zeros."""
    blocks = BUCKETS // BLOCK

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors()
        total = np.zeros(BUCKETS * DIM, dtype=np.int64)
        for batch in batches:
            for c in chunks(binary(batch.column(0))):
                bucket, text = pieces(c.buf, c.at)
                for step in (1, 2):
                    near = np.flatnonzero(text[:-step] == text[step:])
                    left, right = bucket[near], bucket[near + step]
                    for a, b in ((left, right), (right, left)):
                        total += np.bincount(a * DIM + plus[b], minlength=total.size)
                        total -= np.bincount(a * DIM + minus[b], minlength=total.size)
        if total.any():
            parts = [total[i * BLOCK * DIM : (i + 1) * BLOCK * DIM].tobytes() for i in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(parts, pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, dtype=np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    parts = map_batches(docs.select(f"`{text_col}`"), gather, schema)
    table = map_batches(parts.repartition(blocks, "block"), add, schema).toArrow()
    out = np.zeros((blocks, BLOCK * DIM))
    for block, sums in zip(table.column("block").to_pylist(), table.column("sums").to_pylist()):
        out[block] = np.frombuffer(sums, dtype=np.int64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean, spread and neighbour product of its pieces' vectors, their number, and whether there is any."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for c in chunks(texts):
        bucket, text = pieces(c.buf, c.at)
        n = np.bincount(text, minlength=c.hi - c.lo)
        own = np.flatnonzero(n)
        if not own.size:
            continue
        first = (np.cumsum(n) - n)[own]
        size = n[own][:, None].astype(np.float32)
        v = vectors[bucket]
        mean = np.add.reduceat(v, first, axis=0) / size
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / size - mean * mean, 0))
        product = np.zeros_like(v)
        product[:-1] = v[:-1] * v[1:]
        product[first + n[own] - 1] = 0
        near = np.add.reduceat(product, first, axis=0) / np.maximum(size - 1, 1)
        out[c.lo + own] = np.hstack([mean, spread, near, np.log1p(size), np.ones_like(size)])
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """Fit on the rows outside ``calibrate``, set the temperature on those inside; without both labels the score is constant."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    shift = x.mean(axis=0) if x.size else np.zeros(FEATURES)
    scale = np.maximum(x.std(axis=0), 1e-3) if x.size else np.ones(FEATURES)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
    net = Network(shift, scale, weights)
    use = np.flatnonzero(~calibrate)
    if np.unique(y[use]).size < 2:
        net.weights[3][0] = 4.0 * (2 * y[use].mean() - 1) if use.size else 0.0
        return net
    weights[2][:] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1))
    xs = (x - shift) / scale
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(use)
        for i in range(0, order.size, 256):
            rows = order[i : i + 256]
            hidden = np.maximum(xs[rows] @ weights[0] + weights[1], 0)
            out = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
            d_out = (out - y[rows][:, None]) / rows.size
            d_hidden = (d_out @ weights[2].T) * (hidden > 0)
            grads = [xs[rows].T @ d_hidden, d_hidden.sum(0), hidden.T @ d_out, d_out.sum(0)]
            step += 1
            for w, g, m in zip(weights, grads, moment):
                g = g + 1e-4 * w
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(calibrate)
    if held.size:
        z, label = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, np.where(label > 0, -z, z) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def remainder(id_: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_.cast("string").cast("binary")) % 4


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    exclude: int = 2,
    most: int = SAMPLE_ROWS,
) -> Classifier:
    """Word vectors of all texts, and a network fitted on at most ``most`` labelled documents.

    Rows whose ``remainder`` is ``exclude`` and rows without a label are never learnt from; of more than ``most``
    others those with the smallest hash of their id are taken. One in five of them sets the temperature. Only
    texts enter the features.
    """
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    key = F.col(f"`{id_col}`")
    usable = labels.where((remainder(key) != exclude) & F.col(f"`{label_col}`").isNotNull())
    usable = usable.groupBy(key.alias("_id")).agg(F.max(f"`{label_col}`").cast("int").alias("_label"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id").limit(most))  # at most ``most`` rows of two numbers
    rows = docs.select(key.alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(chosen, F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # of a repeated id the smallest text
    rows = rows.select("_id", "_label", "_text", (F.pmod(F.xxhash64("_id"), F.lit(5)) == 0).alias("_calibrate"))
    made = extend(rows, "_text", {"_x": ("binary", pa.binary())}, lambda texts: [[r.tobytes() for r in pooled(texts, shared.value)]])
    table = made.select("_id", "_label", "_calibrate", "_x").toArrow().sort_by("_id")
    x = np.frombuffer(b"".join(table.column("_x").to_pylist()), dtype=np.float32).reshape(-1, FEATURES)
    return Classifier(vectors, fit_network(x, table.column("_label").to_numpy(), np.array(table.column("_calibrate").to_pylist(), dtype=bool)))


def score(docs: DataFrame, model: Classifier, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the calibrated probability of label 1 for every whole text.

    A null, empty or blank text has features of zero and a score like any other. Rows and other columns are kept,
    a column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return extend(docs, text_col, {out: ("double", pa.float64())}, lambda texts: [shared.value.network.score(pooled(texts, shared.value.vectors))])
