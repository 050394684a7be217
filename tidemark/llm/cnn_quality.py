"""Quality classifier: a byte-level convolutional network in numpy.

Six-byte filters run over every position of the text. The text is cut into chunks of ``CHUNK``
positions that overlap by half; each chunk max-pools every filter, and the chunks of a document are
joined by mean, maximum and minimum into one vector, which a small hidden layer turns into one
probability. Filters, hidden layer and output are learned together by gradient descent; a max-pool
passes its gradient to the position that won, so a step touches few bytes.

When scoring, the six one-byte tables of a filter bank become three two-byte tables, so a position
costs three lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tables import seeded_sample
from tidemark.llm.words import flat, slices

WIDTH, FILTERS, HIDDEN = 6, 16, 16
CHUNK = 256
HALF = CHUNK // 2
#: Labelled documents fitted on, at most, and of each the half-chunks looked at in one pass, at most.
TRAIN_ROWS = 3_000
TRAIN_HALVES = 64
SLICE_BYTES = 1 << 18


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # 3 FILTERS + 1 x HIDDEN
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        deep = 3 * FILTERS + 1
        return cls(
            rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            rng.normal(0, 1 / np.sqrt(deep), (deep, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pairs(self) -> list[np.ndarray]:
        t = self.tables
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in half-chunks of HALF positions, short ones filled with zero bytes, and the
    first half-chunk of each (n + 1 entries). Each text has one half-chunk at least, and one of zeros after
    it, so that no filter reads into the next text."""
    halves = np.maximum(1, -(-np.diff(offsets) // HALF)) + 1
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
    out[np.repeat(first[:-1] * HALF - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data
    return out, first


def respond(laid: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """Filter responses at every position: positions x FILTERS."""
    n = len(laid) - WIDTH
    two = laid[:-1].astype(np.int64) * 256 + laid[1:]
    z = pairs[0].take(two[:n], 0, mode="clip")
    other = np.empty_like(z)
    for j in (1, 2):
        z += pairs[j].take(two[2 * j : n + 2 * j], 0, other, "clip")
    return z


def half_maxima(laid: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """Largest response of each filter in each half-chunk, a few at a time so that they stay in the cache."""
    count = (len(laid) - WIDTH) // HALF
    out = np.empty((count, FILTERS), np.float32)
    for at in range(0, count, 64):
        to = min(at + 64, count)
        z = respond(laid[at * HALF : to * HALF + WIDTH], pairs).reshape(to - at, HALF, FILTERS)
        size = HALF
        while size > 1:
            size //= 2
            z = np.maximum(z[:, :size], z[:, size : 2 * size])
        out[at:to] = z[:, 0]
    return out


def chunk_rows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as pairs of neighbouring half-chunks (i, i + 1), a lone half-chunk with itself; first chunk of each text."""
    halves = np.diff(first) - 1
    count = np.maximum(1, halves - 1)
    starts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(halves)), count)
    left = first[row] + np.arange(len(row)) - starts[row]
    return np.stack([left, np.minimum(left + 1, first[row + 1] - 2)]), starts


def joined(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Document vectors from chunk vectors, and what the gradient needs."""
    count = np.diff(starts)[:, None]
    mean = np.add.reduceat(pool, starts[:-1]) / count
    high, low = np.maximum.reduceat(pool, starts[:-1]), np.minimum.reduceat(pool, starts[:-1])
    return np.concatenate([mean, high, low, np.log1p(sizes)[:, None] / 8], axis=1), (count, high, low)


def head(net: Network, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(v @ net.w1 + net.b1)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2[0], -40, 40))), hidden


def pooled(laid: np.ndarray, first: np.ndarray, pairs: list[np.ndarray], bias: np.ndarray, trace: bool = False):
    sides, starts = chunk_rows(first)
    if not trace:
        half = np.maximum(half_maxima(laid, pairs) + bias, 0)
        return np.maximum(half[sides[0]], half[sides[1]]), starts, None
    z = respond(laid, pairs).reshape(-1, HALF, FILTERS) + bias
    won = z.argmax(axis=1)
    half = np.take_along_axis(z, won[:, None, :], axis=1)[:, 0]
    won = won + np.arange(len(z))[:, None] * HALF
    right = half[sides[1]] > half[sides[0]]
    best = np.where(right, half[sides[1]], half[sides[0]])
    return np.maximum(best, 0), starts, (np.where(right, won[sides[1]], won[sides[0]]), best > 0)


def scores(net: Network, pairs: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    laid, first = padded(data, offsets)
    pool, starts, _ = pooled(laid, first, pairs, net.bias)
    return head(net, joined(pool, starts, np.diff(offsets))[0])[0]


def fit(texts: list[bytes], y: np.ndarray, *, steps: int = 700, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the cross-entropy. Both classes weigh as in the sample; without rows the score is near 0.5."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    if not texts:
        return net
    moments = [(np.zeros(p.shape, p.dtype), np.zeros(p.shape, p.dtype)) for p in net.parts()]
    most = TRAIN_HALVES * HALF
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(texts))])
        pick, order = order[:batch], order[batch:]
        part = []
        for i in pick:
            # of a very long text a pass looks at one stretch, each time another
            at = int(rng.integers(0, max(1, len(texts[i]) - most + 1)))
            part.append(texts[i][at : at + most])
        data = np.frombuffer(b"".join(part), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        sizes = np.array([len(texts[i]) for i in pick])
        laid, first = padded(data, offsets)
        pool, starts, (won, alive) = pooled(laid, first, net.pairs(), net.bias, True)
        v, (count, high, low) = joined(pool, starts, sizes)
        p, hidden = head(net, v)
        slope = (p - y[pick]) / len(pick)
        d_hidden = slope[:, None] * net.w2 * (1 - hidden**2)
        d_v = d_hidden @ net.w1.T
        row = np.repeat(np.arange(len(pick)), np.diff(starts))
        k = FILTERS
        d_pool = d_v[row, :k] / count[row] + d_v[row, k : 2 * k] * (pool == high[row]) + d_v[row, 2 * k : 3 * k] * (pool == low[row])
        d_pool = np.where(alive, d_pool, 0).astype(np.float32)
        d_tables = np.zeros_like(net.tables)
        filters = np.broadcast_to(np.arange(k), won.shape)
        for j in range(WIDTH):
            flat_at = laid[won + j].astype(np.int64) * k + filters
            d_tables[j] = np.bincount(flat_at.ravel(), d_pool.ravel(), 256 * k).reshape(256, k)
        grads = [d_tables, d_pool.sum(0), v.T @ d_hidden, d_hidden.sum(0), hidden.T @ slope, np.array([slope.sum()])]
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        for value, g, (m, s) in zip(net.parts(), grads, moments):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            value -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
    return net


def held_out(id) -> F.Column:
    """Rows kept apart for measuring: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, seed: int = 3) -> Network:
    """A network for ``labels.quality``, from at most ``most`` labelled documents outside the held-out third."""
    marked = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = marked.join(F.broadcast(seeded_sample(marked, most, seed)), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("y"))
    clip = TRAIN_HALVES * HALF * 4
    # ``most`` rows of an id and a label: small enough for every task, and the texts are not shuffled
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        # one stretch of a very long text, from a seeded place
        F.coalesce(F.substring("text", F.greatest(F.lit(1), (F.abs(F.xxhash64("doc_id")) % F.greatest(F.lit(1), F.length("text") - clip) + 1).cast("int")), F.lit(clip)), F.lit("")).alias("t"),
        "y", "doc_id").limit(2 * most).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["t"]))
    return fit([r["t"].encode() for r in rows], np.array([r["y"] for r in rows], float))


def classify(documents: DataFrame, net: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): one row for each row in, from the whole text and nothing else.

    Defined cases: a null text scores as an empty one; equal texts score alike; a null id stays null;
    other columns are ignored; no rows give no rows. Memory is bounded by a slice or the longest text.
    """
    kind = documents.schema[id].dataType.simpleString()

    def run(batches):
        pairs = net.pairs()
        for part in slices(batches, text, SLICE_BYTES):
            yield pa.record_batch([part.column(0), pa.array(scores(net, pairs, *flat(part.column(1))))], [id, "score"])

    return documents.select(id, text).mapInArrow(run, f"{id} {kind}, score double")


def keep_good(documents: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The documents scored ``least`` or more, with all their columns."""
    names = documents.columns

    def run(batches):
        pairs = net.pairs()
        for part in slices(batches, "text", SLICE_BYTES):
            score = scores(net, pairs, *flat(part.column("text")))
            yield part.filter(pa.array(score >= least))

    return documents.mapInArrow(run, documents.schema).select(names)
