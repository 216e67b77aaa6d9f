"""License scans: base phrases at word level and fuzzy search for short notices.

A notice found with at most k edits, cut into k + 1 pieces, has one piece
unchanged. The pieces are looked up exactly over whole chunks of normal text;
only around such a seed does bounded-error matching run, which verifies the edits
and gives the span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlake.llm.text import lower_ascii, runs_of, text_buffers

#: Base phrases, as words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Edits allowed in a notice: one for each so many characters, none in texts of fewer than twice as many.
CHARS_AN_EDIT = 12

#: Short notices in normal form (lower case, words apart by one space) after their labels; a label may have several.
NOTICES = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: licensed under the mit license
apache: licensed under the apache license version 2 0
apache: distributed under the license is distributed on an as is basis without warranties or conditions of any kind
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice
bsd: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
gpl: under the terms of the gnu general public license
gpl: you should have received a copy of the gnu general public license
lgpl: under the terms of the gnu lesser general public license
lgpl: you should have received a copy of the gnu lesser general public license
agpl: under the terms of the gnu affero general public license
agpl: you should have received a copy of the gnu affero general public license
mpl: subject to the terms of the mozilla public license
epl: under the terms of the eclipse public license
cc-by: licensed under a creative commons attribution
cc-by: creative commons attribution 4 0 international license
cc-by-sa: creative commons attribution sharealike
cc-by-nc: creative commons attribution noncommercial
cc-by-nd: creative commons attribution noderivatives
cc0: creative commons zero v1 0 universal
cc0: has waived all copyright and related or neighboring rights
isc: permission to use copy modify and or distribute this software for any purpose
unlicense: this is free and unencumbered software released into the public domain
boost: boost software license version 1 0
zlib: this software is provided as is without any express or implied warranty
reserved: no part of this publication may be reproduced distributed or transmitted in any form
"""
#: Identifiers after ``SPDX-License-Identifier:``, in normal form, and their labels; these allow no edits.
SPDX = {
    "mit": "mit", "apache 2 0": "apache", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl", "gpl 3 0": "gpl",
    "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 2 0": "mpl", "epl 2 0": "epl", "isc": "isc",
    "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "bsl 1 0": "boost", "zlib": "zlib",
}

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


class Notice:
    """A notice that may differ by ``edits``, the seeds one of which stands unchanged in each copy, and its pattern."""

    def __init__(self, label: str, text: str, edits: int | None = None):
        self.label, self.text = label, text
        few = len(text) < 2 * CHARS_AN_EDIT
        self.edits = edits if edits is not None else 0 if few else len(text) // CHARS_AN_EDIT
        step = len(text) / (self.edits + 1)
        cuts = [round(i * step) for i in range(self.edits + 2)]
        self.seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        fuzzy = f"{{e<={self.edits}}}" if self.edits else ""
        self.match = regex.compile(rf"(?b)(?<![0-9a-z\x80-\xff])(?:{regex.escape(text, special_only=True)}){fuzzy}(?![0-9a-z\x80-\xff])".encode())


def notices(text: str = NOTICES, spdx: dict[str, str] = SPDX) -> list[Notice]:
    """The notices of a table in the form of NOTICES and of identifiers."""
    fuzzy = [Notice(*map(str.strip, line.split(":", 1))) for line in text.strip().splitlines()]
    return fuzzy + [Notice(label, f"spdx license identifier {name}", 0) for name, label in spdx.items()]


_NOTICES = notices()


def normal_text(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Chunk text as words apart by single spaces, texts apart by a line end.

    Returns it with the start of each word in it, the first word of each text (and
    the end), and the span of each text's part: every word has a space before it.
    """
    low = lower_ascii(data)
    s, e, first = runs_of(_WORD[low], offsets)
    n = len(offsets) - 1
    size = (e - s) + 1
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.cumsum(size) - size + 2 * doc + 1  # after earlier words, their spaces, and two marks for each earlier text
    total = int(size.sum()) + 2 * n
    out = np.full(total, 0x20, np.uint8)
    per = np.bincount(doc, size, minlength=n).astype(np.int64) + 2
    ends = np.cumsum(per)
    out[ends - 1] = 0x0A
    inside = _WORD[low]
    shift = np.repeat(at - s, e - s)
    out[np.flatnonzero(inside) + shift] = low[inside]
    return out.tobytes(), at, first, np.concatenate([[0], ends])


def _finds(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _copies(notice: Notice, text: bytes, lo: int, hi: int) -> list:
    """Matches of a notice in order: the best one, then those in what is left before and after it."""
    found, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= len(notice.text) - notice.edits and (m := notice.match.search(text, lo, hi)):
            found.append(m)
            todo += [(lo, m.start()), (m.end(), hi)]
    return sorted(found, key=lambda m: m.start())


def scan_chunk(data: np.ndarray, offsets: np.ndarray, known: list[Notice] = _NOTICES) -> list[dict]:
    """For each text: n_words, places (start word, label) of base phrases, and fuzzy hits.

    A fuzzy hit is (label, first word, last word, edits, score).
    """
    text, at, first, ends = normal_text(data, offsets)
    starts = ends.tolist()
    out = [{"n_words": int(k), "places": [], "hits": []} for k in np.diff(first)]

    def where(pos: int) -> tuple[int, int]:
        d = bisect_right(starts, pos) - 1
        return d, int(np.searchsorted(at, pos, "right")) - 1 - int(first[d])

    for phrase, label in PHRASES.items():
        for pos in _finds(text, b" " + phrase.encode() + b" "):
            d, w = where(pos + 1)
            out[d]["places"].append((w, label))
    for notice in known:
        seen: dict[int, list[tuple[int, int]]] = {}
        for seed, lead in notice.seeds:
            for pos in _finds(text, seed):
                d = bisect_right(starts, pos) - 1
                lo = max(starts[d], pos - lead - notice.edits - 1)
                hi = min(starts[d + 1], pos - lead + len(notice.text) + notice.edits + 1)
                seen.setdefault(d, []).append((lo, hi))
        for d, windows in seen.items():
            windows.sort()
            merged = [windows[0]]
            for lo, hi in windows[1:]:
                if lo <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                else:
                    merged.append((lo, hi))
            for lo, hi in merged:
                for m in _copies(notice, text, lo, hi):
                    a = m.start() + (text[m.start()] in b" \n")
                    edits = sum(m.fuzzy_counts)
                    out[d]["hits"].append((notice.label, where(a)[1], where(max(a, m.end() - 2))[1], edits, 1 - edits / len(notice.text)))
    for r in out:
        r["places"].sort()
    return out


HITS = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,score:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Notice] = _NOTICES) -> DataFrame:
    """doc_id, n_words, ``places`` (word, label of each base phrase) and ``hits`` (fuzzy notices, those ``known``) of whole texts.

    Null text has no words; repeated rows repeat; other columns are ignored. Map-only.
    """
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    hit = pa.list_(
        pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_buffers(b.column(1)):
                rows = scan_chunk(data, offsets, known)
                keys = ("label", "first_word", "last_word", "edits", "score")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array([r["n_words"] for r in rows], pa.int64()),
                        pa.array([[{"word": w, "label": x} for w, x in r["places"]] for r in rows], place),
                        pa.array([[dict(zip(keys, h, strict=True)) for h in r["hits"]] for r in rows], hit),
                    ],
                    names=["doc_id", "n_words", "places", "hits"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, hits {HITS}"
    )


def license_digest(docs: DataFrame, **columns) -> DataFrame:
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.transform("hits", lambda h: h["label"])
    words = F.transform("places", lambda p: p["word"])
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0))
    return scan(docs, **columns).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, more))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        F.size("hits").cast("bigint").alias("n_fuzzy"),
    )
