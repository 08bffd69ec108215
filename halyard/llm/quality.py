"""Document quality by a byte-level convolutional network in numpy.

The bytes of a whole document are laid into overlapping chunks. In each chunk learned filters run over the embedded bytes and
are max-pooled over the chunk; a hidden layer reads the pooled responses (so that it sees which responses a chunk lacks too);
its units are max-pooled over the chunks of the document and combined into one probability.

Training happens on the driver, on at most about `sample_rows` labelled rows chosen by a hash of doc_id, leaving out texts of
more than `sample_chars` characters; both bounds are parameters and independent of the corpus. Scoring reads every text whole,
a bounded number of chunks at a time.

Cases: a null or empty text is a document of padding and gets a score like any other; rows without a label or doc_id are not
learned from, but scored (a null doc_id counts as held out); labels of one doc_id that differ count as separate rows; with no
labels of both kinds the score is the share of label 1, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, prepare, spread
from halyard.llm.langid import held_out

CHUNK, HOP, WIDTH, STRIDE = 192, 168, 8, 2
EMBEDDED, FILTERS, HIDDEN = 6, 32, 24
THRESHOLD = 0.3
PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            normal(256, EMBEDDED, scale=0.5), normal(WIDTH * EMBEDDED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32),
            normal(FILTERS, HIDDEN, scale=0.25), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=0.25), np.zeros(1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, and where it was."""
        x = self.embedding[chunks]
        windows = np.lib.stride_tricks.as_strided(x, (len(x), PLACES, WIDTH * EMBEDDED), (x.strides[0], x.strides[1] * STRIDE, x.strides[2]))
        r = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBEDDED) @ self.filters
        r = r.reshape(len(x), PLACES, FILTERS)
        if places:
            at = r.argmax(axis=1)
            return np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + self.filter_bias, at
        return r.max(axis=1) + self.filter_bias, None

    def units(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.hidden + self.hidden_bias, 0)

    def score(self, text: str | None, at_once: int = 256) -> float:
        best = np.zeros(HIDDEN, np.float32)
        data = to_bytes(text)
        for i in range(0, len(starts(len(data))), at_once):
            best = np.maximum(best, self.units(self.pooled(to_chunks(data, i, i + at_once))[0]).max(axis=0))
        return float(1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias[0], -30, 30))))


def to_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def starts(length: int) -> range:
    return range(0, max(1, length - CHUNK + HOP), HOP)


def to_chunks(data: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Chunks first to last of the document, the end filled up with zeros."""
    own = starts(len(data))[first:last]
    piece = data[own[0] : own[-1] + CHUNK]
    padded = np.zeros((len(own) - 1) * HOP + CHUNK, np.uint8)
    padded[: len(piece)] = piece
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(own), CHUNK), (HOP, 1)))


def fit(texts: list[str], labels: np.ndarray, steps: int = 1000, at_once: int = 32, rate: float = 0.004, seed: int = 42) -> Network:
    """Adam on the log loss; the gradient of a maximum goes to where it was taken."""
    net = Network.fresh(seed)
    rng = np.random.default_rng(seed)
    data = [to_bytes(t) for t in texts]
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    per_epoch = -(-len(data) // at_once)
    total = max(1, round(steps / per_epoch)) * per_epoch
    while step < total:
        order = rng.permutation(len(data))
        for i in range(0, len(order), at_once):
            batch = order[i : i + at_once]
            grads = _gradients(net, [to_chunks(data[k]) for k in batch], labels[batch])
            step += 1
            pace = rate * min(1.0, step / 50) * (1 - 0.9 * step / total)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, docs: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    chunks = np.concatenate(docs)
    parts = [net.pooled(chunks[i : i + 512], places=True) for i in range(0, len(chunks), 512)]
    pooled, at = np.concatenate([p for p, _ in parts]), np.concatenate([a for _, a in parts])
    active = np.maximum(pooled, 0)
    units = net.units(pooled)
    spans = list(zip(ends - sizes, ends, strict=True))
    chosen = np.stack([a + units[a:b].argmax(axis=0) for a, b in spans])  # chunk of each document and unit
    top = np.take_along_axis(units, chosen, axis=0)
    p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias[0], -30, 30)))
    error = ((p - labels) / len(docs)).astype(np.float32)
    d_units = np.zeros_like(units)
    np.add.at(d_units, (chosen, np.arange(HIDDEN)), error[:, None] * net.out * (top > 0))
    d_pooled = (d_units @ net.hidden.T) * (pooled > 0)
    live = np.flatnonzero(d_pooled.any(axis=1))
    g, where, own = d_pooled[live], at[live], chunks[live]
    spots = where[:, :, None] * STRIDE + np.arange(WIDTH)
    seen = own[np.arange(len(live))[:, None, None], spots]  # bytes under each filter where it responded most
    x = net.embedding[seen].reshape(len(live), FILTERS, WIDTH * EMBEDDED)
    d_filters = np.einsum("nf,nfk->kf", g, x)
    d_x = (g[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
    flat = seen.reshape(-1)
    d_embedding = np.stack([np.bincount(flat, d_x[:, k], 256) for k in range(EMBEDDED)], axis=1).astype(np.float32)
    return [d_embedding, d_filters, g.sum(axis=0), active.T @ d_units, d_units.sum(axis=0), error @ top, error.sum(keepdims=True)]


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 50_000, steps: int = 1000) -> Network | float:
    """A network from labelled rows (label column quality) that are not held out; a constant if there is only one kind of label."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", (F.col("quality") == 1).cast("int").alias("_y"))
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    wanted = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = documents.where(~held_out(F.col("doc_id"), 5, 0)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "text")
    # About sample_rows; should doc_ids repeat much, those with the smallest hashes, so that the driver's share is bounded all the same.
    rows = texts.join(wanted, "doc_id").where(F.length("text") <= sample_chars).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "_y", "text").limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_y"], r["text"]))
    y = np.array([r["_y"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    return fit([r["text"] for r in rows], y, steps)


def score(documents: DataFrame, model: Network | float) -> DataFrame:
    """doc_id and score of every document."""
    prepare(documents.sparkSession)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model if isinstance(model, float) else model.score(t.as_py()) for t in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(by_batch(each), "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(documents, labels, sample_rows)
    return score(documents, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
