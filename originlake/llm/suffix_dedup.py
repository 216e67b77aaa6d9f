"""Removal of repeated 100-byte strings by prefix-free parsing.

1. Each chunk is parsed and its positions put in corpus order by the suffix arrays
   of its dictionary and its parse (see ``phrases``): strings that repeat within
   the chunk are settled there, on their bytes.
2. What is left goes between chunks as phrases that hold whole windows, of which
   only (trigger key, content hash, place) is shuffled. Of phrases with equal
   content the earliest stands, all windows of the others are repeats.
3. Distinct phrases that share a trigger with another one may still share some
   windows. Their bytes, in parts of neighbouring windows, go to one place by the
   bytes that all windows of a part have in common. There a suffix array over the
   parts' bytes brings equal windows together, and the order of places (doc_id,
   start) tells the earliest of each run.

A row is known by its id and a hash of its text, so rows that share an id keep
their own spans. No step holds a group: streams are sorted and keep one row of
state, repeats within a chunk are settled before the shuffle, and a part that
more than HOT rows share is dealt anew by single windows. Long texts are read in
segments that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlake.llm.phrases import TRIGGER, WINDOW, earlier_copy, phrases, repeated, runs, suffix_order, whole_windows
from originlake.llm.text import cut, mix, prefix_hash, span_hash, text_buffers

NO_ID = -(1 << 63)
#: Windows of a phrase go in parts by their distance to the trigger, so many distances a part.
PART = 20
#: Rows of one part that a task sorts; beyond, they are dealt by single windows.
HOT = 20_000
#: Window starts that one suffix array covers, about.
SORTED = 50_000
#: Bytes of text that one parse covers, about: its arrays take some 150 times as much.
CHUNK = 1 << 18


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _rows(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_i64(c) for c in cols], names=names)


def _segments(data: np.ndarray, offsets: np.ndarray, beyond: int = WINDOW - 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A chunk as it is, or a long text in pieces that reach ``beyond`` into the next: start, bytes, offsets."""
    if len(data) <= CHUNK + beyond or len(offsets) != 2:
        yield 0, data, offsets
        return
    for x in range(0, len(data), CHUNK):
        part = data[x : x + CHUNK + beyond]
        yield x, part, np.array([0, len(part)])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases as key, content, doc, at (start, distance to the trigger, further windows), row; content 0: known repeat."""
    for b in batches:
        ids, row = b.column("_id").to_numpy(), b.column("_row").to_numpy()
        for i, j, whole, ends in text_buffers(b.column("text"), CHUNK):
            for x, data, offsets in _segments(whole, ends):
                if len(data) < WINDOW or not (ok := whole_windows(offsets, len(data))).any():
                    continue
                c = prefix_hash(data)
                p = phrases(data, offsets, c, ok)
                rank = np.unique(ids[i:j], return_inverse=True)[1]
                starts = np.arange(len(ok))
                own = np.searchsorted(offsets, starts, "right") - 1
                again = np.concatenate([[0], np.cumsum(repeated(data, c, ok, rank[own] << 40 | starts - offsets[own]))])
                known = again[p["hi"] + 1] - again[p["lo"]] == p["hi"] + 1 - p["lo"]
                doc, of = ids[i:j][p["doc"]], row[i:j][p["doc"]]
                at = ((x + p["lo"] - offsets[p["doc"]]) << 20) | ((p["trigger"] - p["lo"]) << 10) | (p["hi"] - p["lo"])
                spread = mix((doc ^ of).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64))
                key = np.where(known, spread, p["key"])
                yield _rows(["key", "content", "doc", "at", "row"], key, np.where(known, np.uint64(0), p["content"] | np.uint64(1)), doc, at, of)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted phrases to repeats (shared 0) and to first ones of a key that has several contents (shared 1).

    Phrases at the first one's own place, in other rows of its id, are told as shared, too.
    """
    carry, told = [np.zeros(0, np.int64)] * 5, True  # the latest first phrase, and whether it was given out
    for b in batches:
        rows = [b.column(n).to_numpy() for n in ("key", "content", "doc", "at", "row")]
        known = rows[1] == 0
        repeats, firsts = [[x[known] for x in rows[2:]]], []
        k, c, d, a, r = (np.concatenate([x, y[~known]]) for x, y in zip(carry, rows, strict=True))
        n = len(k)
        if n:
            new = np.ones(n, bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            there = (d == d[head]) & (a == a[head])
            repeats.append([x[~there] for x in (d, a, r)])
            firsts.append([x[there & ~new] for x in (d, a, r)])
            f = np.flatnonzero(new)
            shared = np.zeros(len(f), bool)
            shared[1:] = k[f][1:] == k[f][:-1]
            shared[:-1] |= shared[1:]
            was = len(carry[0]) > 0 and told
            last_told = bool(shared[-1]) or (was and len(f) == 1)
            if was:
                shared[0] = False
            firsts.append([x[f[shared]] for x in (d, a, r)])
            carry, told = [x[f[-1] : f[-1] + 1] for x in (k, c, d, a, r)], last_told
        doc, at, row = (np.concatenate(x) for x in zip(*repeats, *firsts, strict=True))
        yield _rows(["doc", "at", "row", "shared"], doc, at, row, np.arange(len(doc)) >= sum(len(x[0]) for x in repeats))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared phrases of a text as parts: sub (hash of what all windows of the part have), doc, start, row, body."""
    for b in batches:
        ids, row, ats = b.column("_id").to_numpy(), b.column("_row").to_numpy(), b.column("ats")
        for i, j, whole, ends in text_buffers(b.column("text"), CHUNK):
            own = ats.slice(i, j - i)
            every = own.flatten().to_numpy()
            text = np.repeat(np.arange(j - i), own.value_lengths().to_numpy())
            for x, data, offsets in _segments(whole, ends, 3 * WINDOW):
                here = slice(None) if len(data) == len(whole) else (every >> 20 >= x) & (every >> 20 < x + CHUNK)
                at, doc = every[here], text[here]
                yield from _pieces(data, (at >> 20) - x + offsets[doc], at, ids[i:j][doc], x - offsets[doc], row[i:j][doc])


def _pieces(data: np.ndarray, lo: np.ndarray, at: np.ndarray, ids: np.ndarray, shift: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    trig, hi = lo + ((at >> 10) & 1023), lo + (at & 1023)
    c = prefix_hash(data)
    raw = data.tobytes()
    for q in range((WINDOW - TRIGGER) // PART + 1):
        near = trig - q * PART  # windows of this part start in (near - PART, near]
        first, last = np.maximum(lo, near - PART + 1), np.minimum(hi, near)
        has = np.flatnonzero(first <= last)
        if not len(has):
            continue
        first, last, near = first[has], last[has], near[has]
        sub = mix(span_hash(c, near, near - PART + 1 + WINDOW) + np.uint64(q + 1))
        body = [raw[x:y] for x, y in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [_i64(sub), _i64(ids[has]), _i64(first + shift[has]), _i64(row[has]), pa.array(body, pa.binary())], names=["sub", "doc", "start", "row", "body"]
        )


_NONE = np.zeros(0, np.int64)


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, window: np.ndarray | None = None) -> pa.RecordBatch:
    w = pa.nulls(len(doc), pa.int64()) if window is None else _i64(window)
    return pa.RecordBatch.from_arrays([*map(_i64, (doc, start, end, row)), w], names=["doc", "start", "end", "row", "window"])


def _joined(doc: np.ndarray, start: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """Repeated windows as spans, by rows."""
    which, of = np.unique(np.stack([doc, row]), axis=1, return_inverse=True) if len(doc) else (np.zeros((2, 0), np.int64), doc)
    own, a, e = runs(of.ravel(), start)
    return _spans(which[0][own], a, e, which[1][own])


def _unfold(bodies: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the parts: the bytes, window starts in them, and each window's part and place."""
    raw = b"".join(bodies.to_pylist())
    data = np.frombuffer(raw, np.uint8)
    size = np.fromiter(map(len, bodies.to_pylist()), np.int64, len(bodies))
    count = size - WINDOW + 1
    row = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return data, np.repeat(np.cumsum(size) - size, count) + inner, row, start[row] + inner


def _by_suffix(sub: np.ndarray, doc: np.ndarray, start: np.ndarray, row: np.ndarray, bodies: pa.Array) -> pa.RecordBatch:
    """Repeated windows among whole groups of parts, as spans."""
    alike = np.zeros(len(sub), bool)
    alike[1:] = sub[1:] == sub[:-1]
    alike[:-1] |= alike[1:]
    keep = np.flatnonzero(alike)
    if not len(keep):
        return _spans(_NONE, _NONE, _NONE, _NONE)
    data, at, part, wstart = _unfold(bodies.take(pa.array(keep)), start[keep])
    wdoc = doc[keep][part]
    order, same = suffix_order(data, at)
    hit = earlier_copy(order, same, wdoc, wstart)
    return _joined(wdoc[hit], wstart[hit], row[keep][part][hit])


def matcher(hot_rows: int = HOT, sorted_windows: int = SORTED):
    """Sorted parts to spans of repeated windows; a part with over ``hot_rows`` gives its single windows instead."""

    def settle(t: pa.Table, rows: int) -> pa.RecordBatch:
        t = t.slice(0, rows)
        return _by_suffix(*(t[c].to_numpy() for c in ("sub", "doc", "start", "row")), t["body"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of groups that may go on
        hot = None  # the group that is given out by single windows
        step = max(1, hot_rows // 4)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                if hot is not None:
                    other = np.flatnonzero(b.column("sub").to_numpy() != hot)
                    n = int(other[0]) if len(other) else b.num_rows
                    yield from _singles(b.slice(0, n))
                    if n == b.num_rows:
                        continue
                    b, hot = b.slice(n), None
                held.append(b)
                if sum(x.num_rows for x in held) * PART // 2 < sorted_windows:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                sub = t["sub"].to_numpy()
                other = np.flatnonzero(sub != sub[-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield settle(t, whole)
                held = t.slice(whole).to_batches()
                if t.num_rows - whole > hot_rows:
                    hot = sub[-1]
                    for x in held:
                        yield from _singles(x)
                    held = []
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield settle(t, t.num_rows)

    return run


def _singles(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every window of the parts by itself, with its hash; repeats within the batch are settled here."""
    for x in range(0, b.num_rows, 5000):
        t = b.slice(x, 5000)
        data, at, part, start = _unfold(t.column("body"), t.column("start").to_numpy())
        doc, row = t.column("doc").to_numpy()[part], t.column("row").to_numpy()[part]
        c = prefix_hash(data)
        h = span_hash(c, at, at + WINDOW)
        order = np.lexsort((start, doc, h))
        hit = earlier_copy(order, h[order][1:] == h[order][:-1], doc, start)
        yield _joined(doc[hit], start[hit], row[hit])
        yield _spans(doc[~hit], start[~hit], start[~hit] + WINDOW, row[~hit], h[~hit])


def _match_singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are; of single windows, sorted, those that equal an earlier one."""
    head = [np.zeros(0, np.int64)] * 3
    for b in batches:
        w = b.column("window")
        plain = np.asarray(w.is_null())
        d, s, e, r = (b.column(n).to_numpy() for n in ("doc", "start", "end", "row"))
        out = [(d[plain], s[plain], e[plain], r[plain])]
        single = w.filter(pa.array(~plain)).to_numpy()
        h, d, s = (np.concatenate([x, y]) for x, y in zip(head, (single, d[~plain], s[~plain]), strict=True))
        r = np.concatenate([head[0], r[~plain]])  # the head's own is never used
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            hit = ~new & ((d != d[first]) | (s != s[first]))
            out.append((d[hit], s[hit], s[hit] + WINDOW, r[hit]))
            head = [x[first[-1] : first[-1] + 1] for x in (h, d, s)]
        yield _rows(["doc", "start", "end", "row"], *(np.concatenate(x) for x in zip(*out, strict=True)))


def _with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    plain = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c).alias(f"o_{i}") for i, c in enumerate(rest)],
    )
    return plain.withColumn("_row", F.xxhash64("text"))


def with_spans(plain: DataFrame) -> DataFrame:
    """Rows with ``spans``: byte ranges that repeat an earlier string, in no order, or null.

    Texts are joined with what was found in them by id and text hash; where copies of one row are very many, the
    planner may split them, as nothing here fixes how they are dealt.
    """
    parsed = plain.select("_id", "_row", "text").mapInArrow(_parse, "key bigint, content bigint, doc bigint, at bigint, row bigint")
    told = cut(
        parsed.repartition("key")
        .sortWithinPartitions("key", "content", "doc", "at")
        .mapInArrow(_settle, "doc bigint, at bigint, row bigint, shared bigint")
    )
    of = [F.col("doc").alias("_id"), F.col("row").alias("_row")]
    shared = told.where("shared = 1").groupBy(*of).agg(F.collect_set("at").alias("ats"))
    parts = plain.join(shared, ["_id", "_row"]).mapInArrow(_parts, "sub bigint, doc bigint, start bigint, row bigint, body binary")
    matched = (
        parts.repartition("sub")
        .sortWithinPartitions("sub", "doc", "start")
        .mapInArrow(matcher(HOT, SORTED), "doc bigint, start bigint, end bigint, row bigint, window bigint")
        .repartition(F.coalesce("window", F.xxhash64("doc", "start")))
        .sortWithinPartitions("window", "doc", "start")
        .mapInArrow(_match_singles, "doc bigint, start bigint, end bigint, row bigint")
    )
    whole = told.where("shared = 0").select(
        "doc",
        F.shiftright("at", 20).alias("start"),
        (F.shiftright("at", 20) + F.col("at").bitwiseAND(F.lit(1023)) + WINDOW).alias("end"),
        "row",
    )
    spans = whole.unionByName(matched).groupBy(*of).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return plain.join(spans, ["_id", "_row"], "left")


def _merged(spans: pa.Array, i: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs of one row."""
    s = spans[i]
    if not s.is_valid:
        return []
    v = s.values
    a, e = v.field("start").to_numpy(), np.minimum(v.field("end").to_numpy(), size)
    order = np.argsort(a, kind="stable")
    a, e = a[order], e[order]
    ok = a < e
    a, e = a[ok], np.maximum.accumulate(e[ok])
    if not len(a):
        return []
    new = np.flatnonzero(np.concatenate([[True], a[1:] > e[:-1]]))
    return list(zip(a[new].tolist(), e[np.append(new[1:], len(a)) - 1].tolist(), strict=True))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, e in gone:
        out.append(raw[at:a])
        at = e
    return b"".join([*out, raw[at:]])


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Every byte covered by a 100-byte string that also starts earlier (in a smaller
    doc_id, or before in the same text) is removed, judged on the input. Null text
    is empty. Null ids come first in order. Rows that share an id are one document
    whose places are told by their start alone: of two rows with one id, a string
    goes from the one in which it starts later, and from neither where it starts
    alike. Other columns are ignored.
    """
    plain = _with_id(docs.select(id_col, text_col), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column("text"), b.column("spans")
            rows = []
            for i in range(b.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                gone = _merged(spans, i, len(raw))
                rows.append((len(raw), sum(e - a for a, e in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    out = with_spans(plain).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without their repeated strings: all rows and columns stay, ``n_chars`` is renewed if there.

    Bytes of characters that the removal cuts through are dropped too, so the text stays valid. Null text becomes empty.
    """
    plain = _with_id(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column("text"), b.column("spans")
            new = []
            for i in range(b.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                new.append(_kept(raw, _merged(spans, i, len(raw))).decode("utf-8", "ignore"))
            names = [n for n in b.schema.names if n not in ("spans", "_row")]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    out = with_spans(plain).mapInArrow(run, plain.drop("_row").schema)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    of = {id_col: F.expr(f"nullif(_id, {NO_ID + 1} - 1)").cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    of |= {c: F.col(f"o_{i}") for i, c in enumerate(rest)}
    if "n_chars" in rest:
        of["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[of[c].alias(c) for c in docs.columns])
