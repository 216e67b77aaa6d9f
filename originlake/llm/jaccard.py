"""Exact n-gram Jaccard join by size-banded tiles and hashed bitmap signatures.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Sets that
overlap enough share a hash among their rarest quarter, so these hashes deal the
documents into tiles; in a tile, ordered by size, only sizes within the
threshold's ratio meet. A bitmap with about one bit for each set member, where
each member flips its bit, bounds the overlap of two sets from above; pairs that
survive the bound are decided by intersecting their sorted arrays.

Rarity comes from a hashed count sketch of fixed size. Equal sets are one node.
Tiles that share a member form candidate groups; the texts of a group go to one
task, once each, which runs the tiles in order of size and skips what is linked
already, so a dense group costs no more than a sparse one. Groups with more
shingles than a task should hold are not sent anywhere whole: there each node is
first compared with the partner it shares most tiles with, components are taken,
and only tiles in which more than one component remains are compared pair by
pair, in blocks where the sketch knows them to be large.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originlake.llm.graph import components
from originlake.llm.text import cut, drop, mix, text_buffers, window_hash, word_hashes

WORDS = 5
#: Similarity as a fraction: links have NUM * union <= DEN * intersection.
NUM, DEN = 3, 4
NO_ID = -(1 << 63)

SKETCH_BITS = 22
SLICE = 1 << 16
#: Documents of one block of a large tile, about; partners that one task compares with a copy of one document.
BLOCK, FAN = 4096, 256
#: Shingles of a candidate group, summed over its members, that one task may hold.
LARGE = 8_000_000
#: Members of candidate groups (16 bytes each) up to which they are broadcast to the texts; beyond, they are joined.
BROADCAST_ROWS = 300_000
CHUNK = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts have one for all their words, empty ones none."""
    wh, first = word_hashes(data, offsets)
    sh = window_hash(wh, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            v = np.sort(sh[a : b - WORDS + 1])
            new = np.empty(len(v), bool)
            new[0] = True
            np.not_equal(v[1:], v[:-1], out=new[1:])
            out.append(v[new])
        elif b > a:
            out.append(mix(window_hash(wh[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(v: np.ndarray) -> bytes:
    """Parity bitmap: as many bits as the next power of two from the set's size, 64 at least."""
    bits = max(64, 1 << int(len(v) - 1).bit_length()) if len(v) else 64
    return _parity(v, bits).tobytes()


def _parity(v: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((v & np.uint64(bits - 1)).view(np.int64), minlength=bits)
    return np.packbits((odd & 1).astype(np.uint8), bitorder="little")


def flipped(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps (as 64-bit words) differ, the longer folded to the shorter: at most the sets' difference."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest intersection that links sets of these sizes."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's doc, n, f1, f2, bits; then the task's counts of hashes, in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    names = ["doc", "n", "f1", "f2", "bits", "slice", "counts"]
    for b in batches:
        ids = b.column(0)
        for i, j, data, offsets in text_buffers(b.column(1), CHUNK):
            sets = shingle_sets(data, offsets)
            np.add.at(counts, np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
            f1 = np.array([mix(v).sum(dtype=np.uint64) for v in sets], np.uint64)
            f2 = np.array([mix(v ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for v in sets], np.uint64)
            null = pa.nulls(j - i)
            cols = [ids.slice(i, j - i), pa.array(map(len, sets)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.array(map(bitmap, sets), pa.binary()), null, null]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds, strict=True)], names=names)
    for k in range(0, len(counts), SLICE):
        part = counts[k : k + SLICE]
        if part.any():
            cols = [pa.nulls(1)] * 5 + [pa.array([k // SLICE]), pa.array([zlib.compress(part.tobytes(), 1)])]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.frombuffer(zlib.decompress(c), np.uint32)
            total[k] = total[k] + v if k in total else v.astype(np.uint64)
    for k, v in total.items():
        level = np.minimum(255, np.floor(4 * np.log2(np.maximum(v, 1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([float(v.sum())])],
            names=["slice", "levels", "total"],
        )


class Sketch:
    """Quarter-octave levels of how often hashes of a bucket occur, for all data: SKETCH_BITS decide its size."""

    def __init__(self, rows, block: int = BLOCK):
        self.block = block
        self.packed = {r["slice"]: bytes(r["levels"]) for r in rows}
        self.mean = sum(r["total"] for r in rows) / (1 << SKETCH_BITS)
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def levels(self, v: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << SKETCH_BITS, np.uint8)
            for k, c in self.packed.items():
                self.table[k * SLICE : (k + 1) * SLICE] = np.frombuffer(zlib.decompress(c), np.uint8)
        return self.table[v >> np.uint64(64 - SKETCH_BITS)]

    def blocks(self, levels: np.ndarray) -> np.ndarray:
        """Into how many blocks a tile is dealt; the sketch never counts too few."""
        most = np.exp2((levels.astype(float) + 1) / 4) - 4 * self.mean
        return np.maximum(1, np.ceil(most / self.block)).astype(np.int64)


def rarest(sketch: Sketch, v: np.ndarray) -> np.ndarray:
    """The rarest quarter of a set, in the order that all sets share."""
    n = len(v)
    p = n - -(-NUM * n // DEN) + 1
    rank = (sketch.levels(v).astype(np.uint64) << np.uint64(56)) | (v >> np.uint64(8))
    if p >= n // 2:
        return v[np.argsort(rank, kind="stable")[:p]]
    near = np.flatnonzero(rank <= np.partition(rank, p)[p])
    return v[near[np.argsort(rank[near], kind="stable")][:p]]


def prefixes(sketch: Sketch):
    """Rows of the rarest hashes of each set: tok, block, blocks, doc, n, pos; equal sets of a chunk go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offsets in text_buffers(b.column(1), CHUNK):
                toks, docs, sizes, places = [], [], [], []
                seen = set()
                order = np.argsort(ids[i:j], kind="stable")
                sets = shingle_sets(data, offsets)
                for k in order.tolist():
                    v = sets[k]
                    n = len(v)
                    if n == 0 or (mark := (n, int(v[0]), v.tobytes() if n < 4 else int(mix(v).sum(dtype=np.uint64)))) in seen:
                        continue
                    seen.add(mark)
                    toks.append(rarest(sketch, v))
                    p = len(toks[-1])
                    docs.append(np.full(p, ids[i + k]))
                    sizes.append(np.full(p, n))
                    places.append(np.arange(p))
                if not toks:
                    continue
                tok, doc = np.concatenate(toks), np.concatenate(docs)
                blocks = sketch.blocks(sketch.levels(tok))
                block = (mix(doc.view(np.uint64) ^ np.uint64(77)) % blocks.astype(np.uint64)).astype(np.int64)
                at = (np.concatenate(sizes) << 32) | np.concatenate(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tok.view(np.int64)), pa.array(block << 32 | blocks), pa.array(doc), pa.array(at)], names=["tok", "block", "doc", "at"]
                )

    return run


def _centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tiles to the rows of those with company, each with the tile's center for its size.

    Rows whose hash stands too late in their order to be the first one in common go. Of a tile in several blocks all
    other rows stay, as their company may be in another block.

    The center is the first document, by size, that is not too small; one row of state.
    """
    held = None  # last tile's rows that may go on: the center's and the latest one
    names = ["tok", "block", "doc", "at"]
    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
        tok, block, doc, at = cols
        if not len(tok):
            continue
        n = at >> 32
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (block[1:] != block[:-1])
        tile = np.cumsum(new)
        line = tile << 32
        # the first row of the tile whose size is within the ratio: no partner asks for less overlap; other blocks'
        # partners may ask for the least there can be
        smallest = n[np.searchsorted(line + n, line + -(-NUM * n // DEN))]
        smallest = np.where(block & 0xFFFFFFFF > 1, -(-NUM * n // DEN), smallest)
        able = n - (at & 0xFFFFFFFF) >= least_overlap(n, smallest)
        skip = 0
        if held is not None:  # of the tile that goes on, rows between are gone: ask for the least there can be
            skip = held[1]
            able[tile == 1] = (n - (at & 0xFFFFFFFF) >= least_overlap(n, -(-NUM * n // DEN)))[tile == 1]
            able[:skip] = True
        tok, block, doc, at, tile, line, n = (x[able] for x in (tok, block, doc, at, tile, line, n))
        cols = [tok, block, doc, at]
        if not len(tok):
            continue
        shared = (np.bincount(tile)[tile] > 1) | (block & 0xFFFFFFFF > 1)
        center = np.searchsorted(line + n, line + -(-NUM * n // DEN))
        out = np.flatnonzero(shared)
        out = out[(out >= skip) | ~np.isin(out, held[2])] if held is not None else out
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[out]) for x in cols] + [pa.array(doc[center[out]])], names=[*names, "center"]
        )
        # rows that later ones of the last tile may need: its center for the largest size so far
        last = np.flatnonzero(tile == tile[-1])
        keep = np.unique([center[len(tok) - 1], len(tok) - 1])
        held = ([c[keep] for c in cols], len(keep), np.arange(len(keep)) if shared[-1] else np.zeros(0, np.int64))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles, or pairs of blocks, to pairs of nodes of different components that size, place and bitmaps allow."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tile = t["tile"].to_numpy()
        n = t["at"].to_numpy() >> 32
        pos = t["at"].to_numpy() & 0xFFFFFFFF
        side, doc, label = (t[c].to_numpy() for c in ("side", "doc", "label"))
        line = np.cumsum(np.r_[True, tile[1:] != tile[:-1]]) << 32
        count = np.arange(len(tile)) - np.searchsorted(line + n, line + -(-NUM * n // DEN))  # earlier rows in the band
        start = np.arange(len(tile)) - count
        bits = t["bits"].combine_chunks()
        done: set[tuple[int, int]] = set()
        at = 0
        while at < len(tile):
            end = at + max(1, int(np.searchsorted(np.cumsum(count[at:]), 1 << 20)))
            c = count[at:end]
            x = np.repeat(np.arange(at, min(end, len(tile))), c)
            y = np.repeat(start[at:end], c) + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            at = end
            most = np.minimum(n[x] - pos[x], n[y] - pos[y])
            ok = (label[x] != label[y]) & (most >= least_overlap(n[x], n[y])) & ((side[x] != side[y]) | (side[x] == 0))
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            a, b = np.maximum(doc[x], doc[y]), np.minimum(doc[x], doc[y])
            order = np.lexsort((b, a))
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            pairs = []
            for k in order[new].tolist():
                if (key := (int(a[k]), int(b[k]))) in done:
                    continue
                done.add(key)
                u, v = (np.frombuffer(bits[int(z)].as_buffer(), np.uint64) for z in (x[k], y[k]))
                if (NUM + DEN) * flipped(u, v) <= int(n[x[k]] + n[y[k]]):
                    pairs.append(key)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*pairs, strict=True)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 4 * BLOCK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        tile = t["tile"].to_numpy()
        other = np.flatnonzero(tile != tile[-1])
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield from settle(t.slice(0, whole))
        held = t.slice(whole).to_batches()
    if held:
        yield from settle(pa.Table.from_batches(held).combine_chunks())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (center, salt), the center's own text first, to links."""
    key, own, own_bits = None, np.zeros(0, np.uint64), None
    for b in batches:
        center, salt, doc, mine = (b.column(c).to_numpy(zero_copy_only=False) for c in ("center", "salt", "doc", "own"))
        links = []
        for i, j, data, offsets in text_buffers(b.column("text"), CHUNK):
            for k, v in zip(range(i, j), shingle_sets(data, offsets), strict=True):
                if mine[k] == 0:
                    key, own, own_bits = (center[k], salt[k]), v, np.frombuffer(bitmap(v), np.uint64)
                elif key == (center[k], salt[k]) and len(v) and len(own):
                    n = len(v) + len(own)
                    if (NUM + DEN) * flipped(np.frombuffer(bitmap(v), np.uint64), own_bits) > n:
                        continue
                    small, large = (v, own) if len(v) < len(own) else (own, v)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= 75 * (n - both):
                        links.append((int(doc[k]), int(center[k])))
        cols = zip(*links, strict=True) if links else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _wide(v: np.ndarray) -> np.ndarray:
    """A bitmap of about eight bits for each member."""
    bits = 64 << max(0, int(8 * len(v) - 1).bit_length() - 6)
    return _parity(v, bits).view(np.uint64)


def group_links(sketch: Sketch, docs: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join a candidate group's members: enough for its components, and each of them exact."""
    order = sorted(range(len(docs)), key=lambda k: (len(sets[k]), docs[k]))
    docs, sets = [docs[k] for k in order], [sets[k] for k in order]
    n = np.array([len(v) for v in sets])
    heads = [rarest(sketch, v) for v in sets]
    of = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    pos = np.concatenate([np.arange(len(h)) for h in heads])
    tok = np.concatenate(heads)
    line = np.argsort(tok, kind="stable")  # tiles, members in order of size
    tok, of, pos = tok[line], of[line], pos[line]
    first = np.searchsorted(tok, tok)
    own = np.empty(len(line), np.int64)
    own[line] = np.arange(len(line))
    ends = np.cumsum([len(h) for h in heads])
    bits = [_wide(v) for v in sets]
    width = np.array([len(x) for x in bits])
    rows = np.zeros(len(sets), np.int64)
    mats = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        rows[at] = np.arange(len(at))
        mats[w] = np.stack([bits[k] for k in at])
    label = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        mine = own[ends[i] - len(heads[i]) : ends[i]]
        tiles = [(first[m], m) for m in mine.tolist() if first[m] < m]
        if not tiles:
            continue
        cand = np.concatenate([of[a:b] for a, b in tiles])
        most = np.concatenate([np.minimum(n[i] - pos[b], n[of[a:b]] - pos[a:b]) for a, b in tiles])
        ok = (NUM * n[i] <= DEN * n[cand]) & (most >= least_overlap(n[i], n[cand]))
        cand = np.unique(cand[ok])
        diff = np.empty(len(cand), np.int64)
        x = bits[i]
        while len(cand):
            same = width[cand] == len(x)
            if same.any():
                diff[same] = np.bitwise_count(mats[len(x)][rows[cand[same]]] ^ x).sum(1)
            if len(x) == 1 or not (width[cand] < len(x)).any():
                break
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        ok = (NUM + DEN) * diff <= n[i] + n[cand]
        cand = cand[ok][np.argsort(diff[ok], kind="stable")]
        while len(cand := cand[label[cand] != label[i]]):
            k, cand = int(cand[0]), cand[1:]
            at = np.minimum(np.searchsorted(sets[i], sets[k]), n[i] - 1)
            both = int((sets[i][at] == sets[k]).sum())
            if 100 * both >= 75 * (n[i] + n[k] - both):
                links.append((docs[i], docs[k]))
                label[label == label[i]] = label[k]
    return links


def grouped(sketch: Sketch):
    """Texts sorted by candidate group to links; holds one group's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, docs, sets = None, [], []

        def close() -> pa.RecordBatch:
            links = group_links(sketch, docs, sets) if len(docs) > 1 else []
            cols = zip(*links, strict=True) if links else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for b in batches:
            ids, groups = b.column("_id").to_pylist(), b.column("label").to_pylist()
            for i, j, data, offsets in text_buffers(b.column("text"), CHUNK):
                for k, v in zip(range(i, j), shingle_sets(data, offsets), strict=True):
                    if groups[k] != group:
                        yield close()
                        group, docs, sets = groups[k], [], []
                    if len(v) and not (docs and docs[-1] == ids[k] and np.array_equal(sets[-1], v)):
                        docs.append(ids[k])
                        sets.append(v)
        yield close()

    return run


def _needed(ids: DataFrame, col: str):
    """A fixed-size filter of ids (as a Spark condition): lets all of them pass, and at small sizes few others."""
    bits = 20
    rows = ids.select((F.xxhash64(col).bitwiseAND(F.lit((1 << bits) - 1))).alias("h")).select(
        F.shiftright("h", 15).alias("k"), F.shiftright(F.col("h"), 6).bitwiseAND(F.lit(511)).alias("w"), F.col("h").bitwiseAND(F.lit(63)).alias("z")
    )
    words = rows.groupBy("k", "w").agg(F.bit_or(F.expr("shiftleft(1L, cast(z as int))")).alias("v"))
    lists = [[0] * 512 for _ in range(32)]
    for r in words.collect():  # at most 2**14 rows, whatever the number of ids
        lists[r["k"]][r["w"]] = r["v"]
    return lists


def _keep_needed(docs: DataFrame, lists: list[list[int]]) -> DataFrame:
    import struct

    table = bytearray(b"".join(struct.pack(">512q", *x) for x in lists))
    h = F.xxhash64("_id").bitwiseAND(F.lit((1 << 20) - 1))
    words = F.conv(F.hex(F.substring(F.lit(table), (F.shiftright(h, 6) * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("bigint")
    return docs.where(F.getbit(words, (h % 64).cast("int")) == 1)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those (a, b) pairs whose texts' sets link. Each text goes once to each of its partners b.

    A partner that very many ask for is copied to several tasks.
    """
    fan = cut(pairs.groupBy("b").agg((F.ceil(F.count(F.lit(1)) / FAN)).cast("int").alias("s")))
    asked = pairs.join(fan, "b").select(
        F.col("a").alias("_id"), F.col("b").alias("center"), F.pmod(F.xxhash64("a"), F.col("s")).cast("int").alias("salt"), F.lit(1).alias("own")
    )
    own = fan.select(F.col("b").alias("_id"), F.col("b").alias("center"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.lit(0).alias("own"))
    need = cut(asked.unionByName(own))
    some = _keep_needed(docs, _needed(need, "_id"))
    return (
        some.join(need, "_id")
        .select("center", "salt", "own", F.col("_id").alias("doc"), "text")
        .repartition("center", "salt")
        .sortWithinPartitions("center", "salt", "own")
        .mapInArrow(_compare, "a bigint, b bigint")
    )


def _large_links(plain: DataFrame, member: DataFrame, shared: DataFrame, stars: DataFrame, rep_of: DataFrame, large: DataFrame) -> DataFrame:
    """Links within candidate groups too large for a task."""
    best = stars.join(large, F.col("doc") == F.col("node")).groupBy("doc").agg(F.max(F.struct("k", "center"))["center"].alias("b"))
    pairs = cut(best.select(F.col("doc").alias("a"), "b"))
    links = cut(verified(plain, pairs))
    labels = components(links)
    copies = rep_of.join(large, F.col("rep") == F.col("node")).select("doc")
    asked = cut(large.select(F.col("node").alias("doc")).unionByName(copies).distinct())
    own_rows = shared.select("tok", "block", "doc", "at").join(asked, "doc", "left_semi")
    node = cut(
        _as_reps(own_rows, rep_of, "doc").distinct()
        .join(labels, F.col("doc") == F.col("node"), "left")
        .select("tok", "block", "doc", "at", F.coalesce("label", "doc").alias("label"))
    )
    mixed = cut(node.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("tok"))
    some = node.join(mixed, "tok", "left_semi")
    bits = member.where("doc = rep").select("doc", "bits").dropDuplicates(["doc"])
    blocks = F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    own = F.shiftright("block", 32).cast("int")
    dealt = (
        some.join(bits, "doc")
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.xxhash64("tok", F.least(own, F.col("other")), F.greatest(own, F.col("other"))).alias("tile"),
            F.when(own == F.col("other"), 0).when(own < F.col("other"), 1).otherwise(2).cast("bigint").alias("side"),
            "doc", "at", "label", "bits",
        )
    )
    more = cut(
        dealt.repartition("tile").sortWithinPartitions("tile", F.shiftright("at", 32), "doc")
        .mapInArrow(_cross, "a bigint, b bigint").distinct()
    )
    out = cut(links.unionByName(verified(plain, more)))
    drop(pairs, links, labels, asked, node, mixed, more)
    return out


def _across(heads: DataFrame) -> DataFrame:
    """Edges (a, b) that join the blocks of a tile wherever sizes are within the ratio.

    ``heads`` has the smallest document, a, of each tok, block and size n.

    Rows of one size join through their smallest document, sizes to the next one below, unless it is too small; what
    lies between two sizes within the ratio is within it, too.
    """
    over = heads.groupBy("tok", "n").agg(F.min("a").alias("b"))
    line = Window.partitionBy("tok").orderBy("n")
    below = over.select("b", "n", F.lag("b").over(line).alias("a"), F.lag("n").over(line).alias("m"))
    chain = below.where(F.col("m") * DEN >= F.col("n") * NUM).select("a", "b")
    return heads.join(over, ["tok", "n"]).select("a", "b").unionByName(chain).where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, large: int = LARGE
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, its own included) of every row.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing. Rows that share an id are one document and so linked. Null ids count
    as one id below all others and stay null, as does a component that has it as
    its smallest. Other columns are ignored.
    """
    plain = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    first = cut(plain.mapInArrow(_signatures, "doc bigint, n bigint, f1 bigint, f2 bigint, bits binary, slice int, counts binary"))
    sig = first.where("slice is null").drop("slice", "counts")
    sketch = Sketch(
        first.where("slice is not null").select("slice", "counts").repartition("slice")
        .mapInArrow(_add_up, "slice int, levels binary, total double").collect(),  # 64 slices
        block,
    )
    same = cut(
        sig.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    )
    member = cut(sig.join(same, ["n", "f1", "f2"], "left").select("doc", F.coalesce("rep", "doc").alias("rep"), "n", "bits"))
    twice = cut(member.groupBy("doc").agg(F.min("rep").alias("r"), F.max("rep").alias("s")).where("r <> s"))
    edges = member.join(twice, "doc").select(F.col("rep").alias("a"), F.col("r").alias("b")).where("a <> b").distinct()

    tiles = (
        plain.mapInArrow(prefixes(sketch), "tok bigint, block bigint, doc bigint, at bigint")
        .repartition("tok", "block")
        .sortWithinPartitions("tok", "block", F.shiftright("at", 32), "doc")
        .mapInArrow(_centers, "tok bigint, block bigint, doc bigint, at bigint, center bigint")
    )
    shared = cut(tiles)
    rep_of = cut(member.where("doc <> rep").select("doc", "rep").distinct())
    blocks = F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    stars = _as_reps(_as_reps(shared.where("doc <> center").groupBy("doc", "center").agg(F.count(F.lit(1)).alias("k")), rep_of, "doc"), rep_of, "center")
    stars = cut(stars.where("doc <> center"))
    heads = cut(shared.where(blocks > 1).groupBy("tok", "block", F.shiftright("at", 32).alias("n")).agg(F.min("doc").alias("a")))
    across = _as_reps(_as_reps(_across(heads), rep_of, "a"), rep_of, "b")
    of = components(stars.select(F.col("doc").alias("a"), F.col("center").alias("b")).unionByName(across))
    size = member.where("doc = rep").select(F.col("doc").alias("node"), "n").dropDuplicates(["node"])
    sizes = cut(of.join(size, "node").groupBy("label").agg(F.sum("n").alias("n")).withColumn("large", F.col("n") > large).drop("n"))
    group = cut(of.join(sizes, "label"))
    small = cut(group.where("not large").select(F.col("node").alias("_id"), "label"))
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = cut(
        (plain.join(F.broadcast(small), "_id") if few else _keep_needed(plain, _needed(small, "_id")).join(small, "_id")).select("label", "_id", "text")
        .repartition("label").sortWithinPartitions("label", "_id").mapInArrow(grouped(sketch), "a bigint, b bigint")
        .unionByName(edges)
    )
    links = [found]
    if group.where("large").limit(1).count():
        links.append(_large_links(plain, member, shared, stars, rep_of, group.where("large").select("node")))
    labels = components(functools.reduce(DataFrame.unionByName, links))
    drop(first, same, twice, shared, rep_of, stars, heads, of, sizes, group, small, *links)
    out = member.select("doc", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    real = lambda c: F.when(c != F.lit(NO_ID), c)
    return out.select(
        real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("label", "rep")).alias("component_id")
    )


def _as_reps(df: DataFrame, rep_of: DataFrame, col: str) -> DataFrame:
    to = rep_of.select(F.col("doc").alias(col), F.col("rep").alias("_rep"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_rep", col)).drop("_rep")
