"""Quality classifier: a byte-level convolutional network written in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that together cover the whole document; the overlap is
longer than a filter, so no window of bytes is lost at a cut. Learned filters slide over two kinds of input:
a learned embedding of each byte, and a plane that says whether the last four bytes already stood a few places
before. Filter responses are max-pooled inside each chunk and over all chunks of the document, and a logistic
layer combines the pooled responses into one probability.

Defined results: a null text is an empty one; an empty text is scored by the bias alone, as pooled responses
start at zero. Without usable labels of both kinds the network is untrained and every score is the share of
label 1 (0.5 without any label). Repeated label rows of a document count once, with the smallest label. Rows
that repeat an id are each scored. Other columns of the input are ignored. Training reads at most
`TrainingBounds.rows` labelled rows of each kind, whatever their length: a text that is longer than
`TrainingBounds.chunks` chunks gives so many of them, drawn from equal stretches of the whole text. Scoring reads
whole texts and has no bound. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CHUNK, LAGS = 1024, range(1, 25)


@dataclass(frozen=True)
class TrainingBounds:
    """What training may read: rows of each label, and chunks of a text."""

    rows: int = 700
    chunks: int = 16
    epochs: int = 12
    seed: int = 7


@dataclass
class Network:
    embedding: np.ndarray  # 256 x width of a byte's embedding
    filters: np.ndarray  # taps x (embedding and repeat plane) x filters
    offsets: np.ndarray
    weights: np.ndarray
    bias: float

    @property
    def taps(self) -> int:
        return self.filters.shape[0]


def chunks_of(data: bytes, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and repeat plane of a text as rows of `CHUNK` bytes, each row sharing `taps` bytes with the next."""
    raw = np.frombuffer(data, np.uint8)
    plane = repeats(raw)
    step = CHUNK - taps
    rows = max(1, -(-max(0, len(raw) - taps) // step))
    padded = np.zeros((2, rows * step + taps), np.uint8)
    padded[0, : len(raw)], padded[1, : len(raw)] = raw, plane
    view = np.lib.stride_tricks.as_strided(padded, (2, rows, CHUNK), (padded.strides[0], step, 1))
    return view[0], view[1]


def repeats(raw: np.ndarray) -> np.ndarray:
    """1 where the last four bytes equal those a few places before."""
    plane = np.zeros(len(raw), np.uint8)
    if len(raw) < 5:
        return plane
    wide = raw.astype(np.uint32)
    code = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
    found = np.zeros(len(code), bool)
    for lag in LAGS:
        if lag < len(code):
            found[lag:] |= code[lag:] == code[:-lag]
    plane[3:] = found
    return plane


def responses(net: Network, rows: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """filters x places, without the offsets; places run through one chunk after the other."""
    n, length = rows.shape
    width, places = net.embedding.shape[1] + 1, length - net.taps + 1
    inputs = np.empty((n, length, width), np.float32)
    inputs[..., :-1], inputs[..., -1] = net.embedding[rows], plane
    windows = np.lib.stride_tricks.as_strided(inputs, (n, places, net.taps * width), inputs.strides)
    flat = windows.reshape(n * places, net.taps * width)
    return net.filters.reshape(net.taps * width, -1).T @ flat.T


def pooled(net: Network, data: bytes, at_once: int = 4) -> np.ndarray:
    """The largest response of each filter over the whole text, at least 0. Memory is bounded by `at_once` chunks."""
    best = np.full(len(net.offsets), -np.inf, np.float32)
    if not data:
        return np.zeros_like(best)
    rows, plane = chunks_of(data, net.taps)
    for start in range(0, len(rows), at_once):
        part = slice(start, start + at_once)
        np.maximum(best, responses(net, rows[part], plane[part]).max(axis=1), out=best)
    return np.maximum(best + net.offsets, 0)


def probability(net: Network, data: bytes) -> float:
    z = float(pooled(net, data).astype(np.float64) @ net.weights.astype(np.float64)) + net.bias
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def untrained(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((256, 1), np.float32), np.zeros((1, 2, 1), np.float32), np.zeros(1, np.float32),
                   np.zeros(1, np.float32), float(np.log(share / (1 - share))))


def pieces_of(data: Column, chunks: int, seed: int, doc_id: Column) -> Column:
    """A text as one piece, or the chunks drawn from it: one at random from each of `chunks` stretches."""
    spare = F.octet_length(data) - F.lit(CHUNK)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.substring(
        data, F.floor((i + F.pmod(F.xxhash64(F.lit(seed), doc_id, i), F.lit(1 << 20)) / (1 << 20)) * spare / chunks).cast("int") + 1, F.lit(CHUNK)))
    return F.when(spare <= (chunks - 1) * CHUNK, F.array(data)).otherwise(drawn)


def prepared_of(pieces: Sequence[bytes], taps: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all pieces of a text."""
    parts = [chunks_of(p, taps) for p in pieces]
    return np.concatenate([rows for rows, _ in parts]), np.concatenate([plane for _, plane in parts])


def train(texts: Sequence[Sequence[bytes]], labels: list[int], bounds: TrainingBounds, width: int = 4, taps: int = 6, filters: int = 12) -> Network:
    """Adam on the logistic loss, one document at a time; the gradient runs through each filter's best place."""
    rng = np.random.default_rng(bounds.seed)
    if len(set(labels)) < 2:
        return untrained(float(np.mean(labels)) if labels else 0.5)
    params = {
        "embedding": rng.normal(0, 0.5, (256, width)), "filters": rng.normal(0, 0.25, (taps, width + 1, filters)),
        "offsets": np.zeros(filters), "weights": rng.normal(0, 0.3, filters), "bias": np.zeros(1),
    }
    params = {k: v.astype(np.float32) for k, v in params.items()}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    prepared = [prepared_of(t, taps) for t in texts]
    step = 0
    for epoch in range(bounds.epochs):
        rate = 0.01 * (1 - epoch / bounds.epochs) + 0.0005
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 16)):
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            net = Network(params["embedding"], params["filters"], params["offsets"], params["weights"], float(params["bias"][0]))
            for i in batch:
                _gradient(net, prepared[i], labels[i], grads)
            step += 1
            for k, g in grads.items():
                g = g / len(batch) + (1e-4 * params[k] if k in ("filters", "weights") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return Network(params["embedding"], params["filters"], params["offsets"], params["weights"], float(params["bias"][0]))


def _gradient(net: Network, prepared: tuple[np.ndarray, np.ndarray], label: int, grads: dict[str, np.ndarray]) -> None:
    rows, plane = prepared
    out = responses(net, rows, plane)
    places = CHUNK - net.taps + 1
    at = out.argmax(axis=1)
    best = out[np.arange(len(at)), at] + net.offsets
    active = best > 0
    hidden = np.where(active, best, 0)
    error = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.bias, -30, 30))) - label
    grads["weights"] += error * hidden
    grads["bias"] += error
    back = error * net.weights * active
    grads["offsets"] += back
    width = net.embedding.shape[1]
    for f in np.flatnonzero(back):
        row, place = divmod(int(at[f]), places)
        codes = rows[row, place : place + net.taps]
        inputs = np.concatenate([net.embedding[codes], plane[row, place : place + net.taps, None].astype(np.float32)], axis=1)
        grads["filters"][:, :, f] += back[f] * inputs
        np.add.at(grads["embedding"], codes, back[f] * net.filters[:, :width, f])


def held_out(doc_id: Column) -> Column:
    """Rows that no training may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> Network:
    """Train on a bounded sample of the labelled rows, the same rows at every run."""
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("_label")).where("doc_id IS NOT NULL AND _label IN (0, 1)")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    )
    order = (F.xxhash64(F.lit(bounds.seed), "doc_id"), F.col("doc_id"))
    chosen = [marked.where(F.col("_label") == k).orderBy(*order).limit(bounds.rows) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows pairs of numbers
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = (
        documents.select("doc_id", text.alias("_bytes")).join(sample, "doc_id")
        .select("doc_id", "_label", pieces_of(F.col("_bytes"), bounds.chunks, bounds.seed, F.col("doc_id")).alias("_pieces"))
        .groupBy("doc_id").agg(F.min("_label").alias("_label"), F.min("_pieces").alias("_pieces"))
        .orderBy("doc_id").collect()  # 2 * rows texts of at most `chunks` chunks
    )
    return train([[bytes(p) for p in r["_pieces"]] for r in rows], [r["_label"] for r in rows], bounds)


def score(documents: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """`documents` with the probability of label 1 for each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the input

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for part in texts:
            yield pd.Series([probability(net, (t or "").encode("utf-8", "surrogatepass")) for t in part], dtype="float64")

    return documents.withColumn(name, F.pandas_udf(scored, "double")(F.col(text)))
