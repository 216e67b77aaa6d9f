"""Pattern packing: documents as token pieces into fixed-length sequences with few of them.

The plan needs only the histogram of piece lengths, which has at most
``seq_len`` entries at any size: patterns of few lengths that fill a sequence
exactly are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded down, and what is left is packed best-fit
in decreasing length, also on counts. Each piece then finds its slot from its
rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originlake.llm.bpe import bpe
from originlake.llm.text import cut, text_buffers

SEQ_LEN = 2048


def patterns(lengths: np.ndarray, seq_len: int) -> np.ndarray:
    """Rows of three lengths (0 for none) from ``lengths`` that sum to ``seq_len``, largest first."""
    have = np.zeros(seq_len + 1, bool)
    have[lengths] = True
    have[0] = True
    rows = []
    for a in lengths[lengths < seq_len]:
        b = np.arange((seq_len - a + 1) // 2, min(a, seq_len - a) + 1)
        b = b[have[b] & (b > 0)]
        c = seq_len - a - b
        b, c = b[have[c]], c[have[c]]
        rows.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def nnls_counts(pats: np.ndarray, hist: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative repeat counts x with A x near the histogram in least squares, by multiplicative updates."""
    weight = hist.astype(float).copy()
    weight[0] = 0
    used = pats > 0
    x = np.full(len(pats), max(weight.sum() / (3 * max(len(pats), 1)), 1e-9))
    goal = np.where(used, weight[pats], 0).sum(1)
    for _ in range(steps):
        fit = np.bincount(pats.ravel(), np.repeat(x, 3), minlength=len(hist))
        fit[0] = 0
        x *= goal / np.maximum(np.where(used, fit[pats], 0).sum(1), 1e-12)
    return x


def best_fit(hist: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, repeats) of the bins it makes."""
    groups: dict[int, list[list]] = {}  # space left -> [lengths, bins]
    for ln in range(seq_len, 0, -1):
        n = int(hist[ln])
        while n:
            room = min((r for r in groups if r >= ln), default=None)
            if room is None:
                k = seq_len // ln
                for each, bins in ((k, n // k), (n % k, 1)):
                    if each and bins:
                        groups.setdefault(seq_len - each * ln, []).append([(ln,) * each, bins])
                n = 0
                continue
            items, bins = groups[room].pop()
            put = min(n, bins)
            if bins > put:
                groups[room].append([items, bins - put])
            if not groups[room]:
                del groups[room]
            groups.setdefault(room - ln, []).append([(*items, ln), put])
            n -= put
    return [(tuple(items), bins) for g in groups.values() for items, bins in g]


def plan(hist: np.ndarray, seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each length as often as the histogram says."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[seq_len]:
        out.append(((seq_len,), int(left[seq_len])))
        left[seq_len] = 0
    pats = patterns(np.flatnonzero(left), seq_len)
    if len(pats):
        x = np.floor(nnls_counts(pats, left) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            items = tuple(int(v) for v in pats[i] if v)
            fits = min(int(left[v]) // items.count(v) for v in set(items))
            if n := min(int(x[i]), fits):
                for v in items:
                    left[v] -= n
                out.append((items, n))
    return out + best_fit(left, seq_len)


def slots(planned: list[tuple[tuple[int, ...], int]], seq_len: int = SEQ_LEN) -> list[tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of slots, in order of ranks."""
    taken = np.zeros(seq_len + 1, np.int64)
    by: list[list[tuple[int, int, int]]] = [[] for _ in range(seq_len + 1)]
    base = 0
    for items, n in planned:
        at = 0
        for v in items:
            by[v].append((int(taken[v]), base, at))
            taken[v] += n
            at += v
        base += n
    return [tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else () for rows in by]


def pieces(
    docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = 0, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32, part, local (and ids).

    A document's ids end with ``end_id``; only documents longer than ``seq_len``
    are cut, and then the first piece is the short one. Null text is empty: one
    piece of the end id alone. ``local`` numbers a task's pieces of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = bpe(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (seq_len + 1)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for i, j, data, offsets in text_buffers(batch.column(1)):
                cols: list[list] = [[] for _ in range(7 + keep_ids)]
                for k, ids in zip(range(i, j), enc.encode_buffer(data, offsets), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % seq_len + 1
                    start = 0
                    for p, stop in enumerate(range(first, n + 1, seq_len)):
                        own = ids[4 * start : 4 * stop]
                        ln = stop - start
                        row = (ids_of[k], p, start, ln, zlib.crc32(own), part, seen[ln], own)
                        for c, v in zip(cols, row, strict=False):
                            c.append(v)
                        seen[ln] += 1
                        start = stop
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, keep_ids: bool = False, **columns) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The pieces are written once to the shared folder; ranks come from counts by
    task and length, so no length, however common, is ever ordered in one task.
    Repeated rows are packed as often as they stand; an empty table gives none.
    """
    rows = cut(pieces(docs, path, seq_len, keep_ids=keep_ids, **columns))
    per = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(seq_len + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most seq_len rows
        hist[r["length"]] = r["n"]
    table = slots(plan(hist, seq_len), seq_len)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ln, rank = b.column("length").to_numpy(), b.column("local").to_numpy() + b.column("base").to_numpy()
            seq, off = np.empty(len(ln), np.int64), np.empty(len(ln), np.int64)
            order = np.argsort(ln, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(ln[order])) + 1) if len(ln) else []:
                first, bases, offs = table[ln[at[0]]]
                k = np.searchsorted(first, rank[at], "right") - 1
                seq[at], off[at] = bases[k] + rank[at] - first[k], offs[k]
            keep = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kind = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return rows.join(base, ["part", "length"]).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
