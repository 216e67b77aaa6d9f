"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that stands inside no vocabulary token can never be
joined by a merge, so the text may be cut there with certainty and the fragments
encoded alone, most of them from memory. Three conditions keep the cuts at one
with the tokenizer's own splitting pattern: both sides are whole characters, the
character before the cut is no white space (its run looks ahead), and the one
after it is no apostrophe (it may open a contraction).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from originlake.llm.text import text_buffers

# Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Encoded fragments that a worker remembers; at the bound it starts afresh.
MEMORY = 800_000
LONGEST_KEPT = 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBPE:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * top
        joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            if token.encode() in self.special:
                continue
            raw = bytes(of[c] for c in token)
            self.tokens[i] = raw
            b = np.frombuffer(raw, np.uint8)
            joined[b[:-1], b[1:]] = True
        for raw, i in self.special.items():
            self.tokens[i] = raw
        apart = ~joined
        apart[:, 0x80:0xC0] = False  # inside a character
        apart[:, ord("'")] = False
        apart[[0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F], :] = False
        self.apart, self.apart_flat = apart, apart.ravel()
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        low = sum(len(t) == 1 for t in vocab)
        if low < 256 or any(vocab[m.replace(" ", "")] != low + k for k, m in enumerate(merges)):
            raise ValueError(f"{path}: ids are not in order of the merges")
        ranks = {raw: i for i, raw in enumerate(self.tokens) if raw and i not in self.special.values()}
        self.merge = tiktoken.Encoding("fragments", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memory: dict[bytes, bytes] = {}

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions before which the bytes may be cut."""
        at = np.flatnonzero(self.apart_flat[(data[:-1].astype(np.uint16) << 8) | data[1:]]) + 1
        if data.max(initial=0) >= 0x80:  # white space of more than one byte ends in these
            last = data[at - 1]
            wide = np.flatnonzero(last >= 0x80)
            if len(wide):
                p = at[wide]
                b1, b2 = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
                two = (b1 == 0xC2) & ((last[wide] == 0x85) | (last[wide] == 0xA0))
                three = ((b2 == 0xE2) & ((b1 == 0x80) | (b1 == 0x81))) | (
                    (last[wide] == 0x80) & (((b2 == 0xE3) & (b1 == 0x80)) | ((b2 == 0xE1) & (b1 == 0x9A)))
                )
                keep = np.ones(len(at), bool)
                keep[wide[two | three]] = False
                at = at[keep]
        return at

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        merge = self.merge
        return {m: array("I", merge(m.decode("utf-8", "replace"))).tobytes() for m in missing}

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if len(data) == 0:
            return [b""] * (len(offsets) - 1)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data) > 1:
            edge[self._cuts(data)] = True
        bounds = np.flatnonzero(edge)
        raw = data.tobytes()
        ends = bounds.tolist()
        parts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        memory = self.memory
        missing = list({p for p in parts if p not in memory})
        extra = {}
        if missing:
            found = self._learn(missing)
            if len(memory) + len(found) > MEMORY:
                memory.clear()
                extra = found
                missing = list({p for p in parts if p not in found})
                extra |= self._learn(missing) if missing else {}
                memory.update((k, v) for k, v in extra.items() if len(k) <= LONGEST_KEPT)
            else:
                extra = {k: v for k, v in found.items() if len(k) > LONGEST_KEPT}
                memory.update((k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT)
        get = (lambda p: memory.get(p) or extra[p]) if extra else memory.__getitem__
        ids = list(map(get, parts))
        first = np.searchsorted(bounds, offsets).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:], strict=False)]

    def encode_buffer(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text; special tokens' strings become their ids, as in the library."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return self._encode_plain(data, offsets)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            pieces = []
            rest = raw[a:b]
            while rest:
                at, s = min(((p, s) for s in self.special if (p := rest.find(s)) >= 0), default=(len(rest), b""))
                if at:
                    u = np.frombuffer(rest[:at], np.uint8)
                    pieces += self._encode_plain(u, np.array([0, len(u)]))
                if s:
                    pieces.append(np.array([self.special[s]], "<u4").tobytes())
                rest = rest[at + len(s) :]
            out.append(b"".join(pieces))
        return out

    def encode(self, text: str) -> list[int]:
        u = np.frombuffer(text.encode(), np.uint8)
        return np.frombuffer(self.encode_buffer(u, np.array([0, len(u)]))[0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character become U+FFFD, as in the library."""
        raw = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def bpe(path: str) -> ForcedBPE:
    """One encoder a worker process and file."""
    return ForcedBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and the decoded text of every row: doc_id, ids (binary, little-endian 32-bit), decoded (binary UTF-8).

    Null text counts as empty (no ids); rows repeat as they come; other columns are ignored.
    Map-only: no shuffle, memory bounded by a chunk of text and the fragment memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            for i, j, data, offsets in text_buffers(batch.column(1)):
                ids = enc.encode_buffer(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(map(enc.decode_bytes, ids), pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with the results reduced to count and digests where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        sha = hashlib.sha256
        for batch in batches:
            for i, j, data, offsets in text_buffers(batch.column(1)):
                ids = enc.encode_buffer(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                        pa.array([sha(enc.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
