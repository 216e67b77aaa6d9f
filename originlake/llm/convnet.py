"""A byte-level convolutional network in numpy that scores whole documents.

Bytes are embedded, learned filters run over overlapping windows, and their
responses are pooled within overlapping chunks that cover the whole document. A
second learned layer reads each chunk; its maximum and its mean over all chunks
are combined into one probability. Training sees a bounded sample of labelled
documents; scoring sees every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originlake.llm.quality_rules import labelled_sample
from originlake.llm.text import text_buffers

WIDTH, STEP = 8, 4
CHUNK = 64  # windows in a chunk; chunks start every CHUNK // 2 windows
EMBED, FILTERS, HIDDEN = 6, 20, 16
#: Half-chunks whose responses scoring holds at once; a text takes about ten bytes a byte besides.
PIECE = 2048
#: Labelled documents to train on, at most, and the bytes of them, at most.
SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
EPOCHS, BATCH, RATE = 10, 24, 0.004
THRESHOLD = 0.7


def start_weights(prior: float, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = np.float32
    return {
        "embed": r.normal(0, 0.5, (256, EMBED)).astype(f),
        "w1": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f),
        "b1": np.zeros(FILTERS, f),
        "w2": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)).astype(f),
        "b2": np.zeros(HIDDEN, f),
        "w3": np.zeros(2 * HIDDEN, f),
        "b3": np.array([np.log(prior / (1 - prior))], f),
    }


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows and chunks of texts laid end to end, each padded to whole half-chunks.

    Half-chunks of CHUNK // 2 windows are the unit: a chunk is two neighbours of one
    text (or its only one), so chunks overlap by half and cover every byte.
    """
    half = CHUNK // 2 * STEP
    halves = np.maximum(1, -(-lengths // half))
    first = np.cumsum(halves) - halves
    return halves, first


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with zero padding, half-chunks of each text and its first one.

    Each text begins with the bytes by which a window reaches beyond its step, so that
    the last window of the text before reads zeros only.
    """
    lengths = np.diff(offsets)
    lead = WIDTH - STEP
    halves, first = _layout(lengths + lead)
    half = CHUNK // 2 * STEP
    out = np.zeros(int(halves.sum()) * half + WIDTH, np.uint8)
    for x, a, b in zip((first * half + lead).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[x : x + b - a] = data[a:b]
    return out, halves, first


def _windows(w: dict, padded: np.ndarray) -> np.ndarray:
    e = w["embed"][padded]
    n = (len(padded) - WIDTH) // STEP
    return np.lib.stride_tricks.as_strided(
        e, (n, WIDTH * EMBED), (STEP * EMBED * e.itemsize, e.itemsize), writeable=False
    ), e


def _chunks(halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right half of each chunk and each text's first chunk."""
    count = np.maximum(1, halves - 1)
    start = np.cumsum(count) - count
    left = np.repeat(first - start, count) + np.arange(int(count.sum()))
    right = left + np.repeat(halves > 1, count)
    return left, right, start


def forward(w: dict, data: np.ndarray, offsets: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Scores (log-odds) of each text."""
    padded, halves, first = _padded(data, offsets)
    half = CHUNK // 2 * STEP
    n = (len(padded) - WIDTH) // half
    top, mean = (np.empty((n, FILTERS), w["w1"].dtype) for _ in range(2))
    piece = PIECE if keep is None else n  # of scoring, only a piece's responses are held
    for a in range(0, n, piece):
        b = min(a + piece, n)
        x, e = _windows(w, padded[a * half : b * half + WIDTH])
        y = x @ w["w1"]
        y += w["b1"]
        np.maximum(y, 0, out=y)
        y = y.reshape(-1, CHUNK // 2, FILTERS)
        top[a:b], mean[a:b] = y.max(1), y.mean(1)
    left, right, start = _chunks(halves, first)
    cmax = np.maximum(top[left], top[right])
    cmean = (mean[left] + mean[right]) / 2
    z = np.concatenate([cmax, cmean], 1)
    h = np.maximum(z @ w["w2"] + w["b2"], 0)
    dmax = np.maximum.reduceat(h, start)
    counts = np.diff(np.append(start, len(h)))[:, None]
    davg = np.add.reduceat(h, start) / counts
    d = np.concatenate([dmax, davg], 1)
    if keep is not None:
        pick = np.where(top[left] >= top[right], left[:, None], right[:, None])
        keep.update(padded=padded, e=e, x=x, y=y, top=top, left=left, right=right, pick=pick, z=z, h=h, dmax=dmax, d=d, start=start, counts=counts)
    return d @ w["w3"] + w["b3"][0]


def gradients(w: dict, data: np.ndarray, offsets: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
    k: dict = {}
    out = forward(w, data, offsets, k)
    p = 1 / (1 + np.exp(-out))
    g_out = ((p - target) * weight / weight.sum()).astype(np.float32)
    g = {"w3": k["d"].T @ g_out, "b3": g_out.sum(keepdims=True)}
    g_d = g_out[:, None] * w["w3"]
    doc = np.repeat(np.arange(len(out)), k["counts"][:, 0])
    g_h = (g_d[:, HIDDEN:] / k["counts"])[doc]
    hit = k["h"] >= k["dmax"][doc]
    ties = np.add.reduceat(hit, k["start"]).astype(np.float32)
    g_h += hit * (g_d[:, :HIDDEN] / ties)[doc]
    g_h *= k["h"] > 0
    g["w2"], g["b2"] = k["z"].T @ g_h, g_h.sum(0)
    g_z = g_h @ w["w2"].T
    g_top = np.zeros_like(k["top"])
    cols = np.broadcast_to(np.arange(FILTERS), k["pick"].shape)
    np.add.at(g_top, (k["pick"], cols), g_z[:, :FILTERS])
    g_mean = np.zeros_like(k["top"])
    np.add.at(g_mean, k["left"], g_z[:, FILTERS:] / 2)
    np.add.at(g_mean, k["right"], g_z[:, FILTERS:] / 2)
    y = k["y"]
    best = y >= k["top"][:, None, :]
    g_y = best * (g_top / best.sum(1))[:, None, :] + (g_mean / (CHUNK // 2))[:, None, :]
    g_y *= y > 0
    g_y = g_y.reshape(-1, FILTERS).astype(np.float32)
    g["w1"], g["b1"] = k["x"].T @ g_y, g_y.sum(0)
    g_x = (g_y @ w["w1"].T).reshape(-1, WIDTH, EMBED)
    g_e = np.zeros_like(k["e"])
    n = len(g_x)
    for j in range(WIDTH):
        g_e[j : j + STEP * n : STEP] += g_x[:, j]
    order = np.argsort(k["padded"], kind="stable")
    bs = k["padded"][order]
    starts = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]])
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][bs[starts]] = np.add.reduceat(g_e[order], starts)
    return g


def train(texts: list[bytes], y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on whole texts; without both classes, the constant share of label 1 (1 if unlabelled)."""
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.99
    w = start_weights(prior, seed)
    if len(y) == 0 or y.min() == y.max():
        return w
    r = np.random.default_rng(seed)
    w["w3"] = r.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    weight = np.ones(len(y), np.float32)
    step, total = 0, EPOCHS * -(-len(y) // BATCH)
    size = np.array([len(t) for t in texts])
    for _ in range(EPOCHS):
        for at in np.array_split(r.permutation(len(y)), -(-len(y) // BATCH)):
            data = np.frombuffer(b"".join(texts[i] for i in at), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size[at])])
            g = gradients(w, data, offsets, y[at], weight[at])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Train on labelled rows outside the held-out fold: ``most`` rows and of them, in order of a hash,
    ``most_bytes`` of text, without texts of over a sixteenth of that.

    All bounds hold before anything reaches the driver; the window is over those rows only. Of rows that share an id,
    the one with the smallest text counts, so the weights do not depend on the order of rows.
    """
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        labelled_sample(docs, labels, most).where(F.octet_length("text") <= most_bytes // 16)
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
        .withColumn("bytes", F.sum(F.octet_length("text")).over(so_far))
        .where(F.col("bytes") <= most_bytes).select("doc_id", "text", "y").collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, weights: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null text scores as empty. Map-only.

    A long text is read in pieces, of which only the pooled responses are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_buffers(b.column(1), 1 << 18):
                p = 1 / (1 + np.exp(-forward(weights, data, offsets).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, weights: dict[str, np.ndarray], text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """Rows, with all their columns, whose text scores at least ``least``. Map-only."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_buffers(b.column(at), 1 << 18):
                p = 1 / (1 + np.exp(-forward(weights, data, offsets).astype(np.float64)))
                yield b.slice(i, j - i).filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
