"""Phrases by rolling-hash triggers: a chunk's prefix-free parse in corpus order, and what chunks exchange.

``corpus_order`` is prefix-free parsing proper. Positions whose rolling hash of
MARK bytes hits a fixed residue cut a chunk into phrases that overlap by these
bytes, so no phrase's suffix is a prefix of another's. The distinct phrases are
the dictionary, their ranks in a row the parse; suffix arrays of both, by prefix
doubling, give the order of all positions of the chunk: first by the suffix of
the phrase that a position stands in, then by the parse after that phrase.

Between chunks, phrases must hold whole windows: a trigger is there the position
of the smallest hash of TRIGGER bytes within a window of WINDOW bytes, so every
window has exactly one, the same wherever its bytes stand. Windows in a row that
share a trigger form a phrase, from the first window's start to the last one's
end. Equal windows have equal triggers at equal offsets, so only phrases with the
same trigger bytes can share a window.
"""

from __future__ import annotations

import numpy as np

from originlake.llm.text import mix, powers, span_hash

WINDOW = 100
TRIGGER = 24
#: The parse of a chunk is cut where the hash of MARK bytes is 0 modulo PERIOD.
MARK, PERIOD = 10, 48


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours (len(v) - width + 1 of them), by doubling."""
    m, have = v, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        d = width - have
        m = np.minimum(m[:-d], m[d:])
    return m


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value: how many are smaller; and the places of values that are not alone."""
    order = np.argsort(key)
    line = key[order]
    new = np.concatenate([[True], line[1:] != line[:-1], [True]])
    first = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first[:-1], np.diff(first))
    return rank, order[~(new[:-1] & new[1:])]


def _doubled(rank: np.ndarray, open_at: np.ndarray, left: np.ndarray, have: int, depth: int) -> np.ndarray:
    """Ranks of suffixes by their first ``depth`` symbols, from those by ``have``.

    ``left``: symbols up to a suffix's end; ``open_at``: suffixes that share their rank. Only these are sorted again.
    """
    while have < depth and len(open_at):
        step = min(have, depth - have)
        more = left[open_at] > step
        key = rank[open_at] << 32
        key[more] |= rank[open_at[more] + step] + 1
        order = np.argsort(key)
        line, places = key[order], open_at[order]
        old = line >> 32
        new = np.concatenate([[True], line[1:] != line[:-1], [True]])
        first = np.flatnonzero(new)
        of = first[:-1]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), np.arange(len(old)), 0))
        rank[places] = np.repeat(old[of] + of - group[of], np.diff(first))
        open_at = places[~(new[:-1] & new[1:])]
        have += step
    return rank


def suffix_ranks(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of byte suffixes by their first ``depth`` bytes; an end comes before any byte."""
    n, first = len(data), 7
    packed = np.zeros(n, np.int64)
    for j in range(first):
        packed <<= 9
        part = data[j:].astype(np.int64) + 1
        part[left[: n - j] <= j] = 0
        packed[: n - j] |= part
    return _doubled(*_ranks(packed), left, first, depth)


def corpus_order(data: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All positions of a chunk in order of the WINDOW bytes from there, as far as they tell; ``c``: its prefix hash."""
    n = len(data)
    g = mix((c[MARK:] - c[:-MARK]) * powers(n + 1 - MARK, True))
    cuts = np.flatnonzero(g[1:] % np.uint64(PERIOD) == 0) + 1
    starts, ends = np.concatenate([[0], cuts]), np.append(cuts + MARK, n)
    raw = data.tobytes()
    said = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    words = sorted(set(said))  # the dictionary
    number = {w: k for k, w in enumerate(words)}
    parse = np.fromiter(map(number.__getitem__, said), np.int64, len(said))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    text = np.frombuffer(b"".join(words), np.uint8)
    left = np.repeat(end, size) - np.arange(len(text))
    by_word = suffix_ranks(text, left, WINDOW)
    m = len(parse)
    by_parse = _doubled(*_ranks(parse), m - np.arange(m), 1, WINDOW)
    phrase = np.repeat(np.arange(m), np.diff(np.append(starts, n)))
    at = (end - size)[parse[phrase]] + np.arange(n) - starts[phrase]
    rest = np.append(by_parse[1:] + 1, 0)[phrase]
    rest[left[at] >= WINDOW] = 0
    return np.argsort(by_word[at] << 32 | rest)


def repeated(data: np.ndarray, c: np.ndarray, ok: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Mask of window starts whose WINDOW bytes also start at a smaller place; windows that are not ``ok`` do not count."""
    order = corpus_order(data, c)
    order = order[order < len(ok)]
    order = order[ok[order]]
    out = np.zeros(len(ok), bool)
    if len(order) < 2:
        return out
    h = ((c[WINDOW:] - c[:-WINDOW]) * powers(len(c), True)[: len(ok)])[order]
    same = h[1:] == h[:-1]
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    like = np.flatnonzero(same)  # hashes agree: compare the bytes
    for k in range(0, len(like), 1 << 14):
        x = like[k : k + (1 << 14)]
        same[x] = (view[order[x]] == view[order[x + 1]]).all(1)
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(place[order], new)
    run = np.zeros(len(order), np.int64)
    run[new[1:]] = 1
    out[order] = place[order] > least[np.cumsum(run)]
    return out


def whole_windows(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of the window starts 0 .. n - WINDOW have all their bytes in one text."""
    valid = np.zeros(n + 1, np.int8)
    full = np.diff(offsets) >= WINDOW
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - WINDOW + 1, -1)
    return np.cumsum(valid)[: n - WINDOW + 1] > 0


def phrases(data: np.ndarray, offsets: np.ndarray, c: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of each text: doc (row), trigger, lo and hi (first and last window start), key and content hash.

    Positions are in the chunk; ``c`` is its prefix hash, ``ok`` its whole windows. Texts shorter than a window have none.
    """
    g = c[TRIGGER:] - c[:-TRIGGER]
    g *= powers(len(g), True)
    g = mix(g)
    v = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    m = sliding_min(v, WINDOW - TRIGGER + 1)
    trig = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of windows 0 .. n - WINDOW
    at = np.flatnonzero(ok)
    t = trig[at]
    new = np.ones(len(at), bool)
    new[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    t = t[first]
    body = span_hash(c, lo, hi + WINDOW)
    shape = (t - lo).astype(np.uint64) * np.uint64(1024) + (hi - lo).astype(np.uint64)
    return {
        "doc": np.searchsorted(offsets, lo, "right") - 1,
        "trigger": t,
        "lo": lo,
        "hi": hi,
        "key": g[t],
        "content": mix(body + mix(shape)),
    }


def earlier_copy(order: np.ndarray, same: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of items with an equal one strictly before them.

    ``order`` puts equal items together and each run in corpus order (doc, at);
    ``same[i]``: item order[i + 1] equals order[i].
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    new = np.concatenate([[True], ~same])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out[order] = ~new & ((doc[order] != doc[head]) | (at[order] != at[head]))
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in order of their first WINDOW bytes, ties as given, and which neighbours are equal there.

    This is the suffix array of a phrase dictionary, cut at the depth that matters.
    """
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts]
    keys = np.ascontiguousarray(view).view(f"S{WINDOW}").ravel()
    order = np.argsort(keys, kind="stable")
    lined = keys[order]
    return order, lined[1:] == lined[:-1]


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (doc, start, end) covered by windows at these places, neighbours joined."""
    order = np.lexsort((at, doc))
    d, p = doc[order], at[order]
    if not len(d):
        return d, p, p
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], p[first], p[last] + WINDOW
