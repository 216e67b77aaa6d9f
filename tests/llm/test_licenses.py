import random
import re

import numpy as np
import pytest

from originlake.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(places)


def test_query_against_words(docs, texts, empty):
    rows = licenses.license_digest(docs).collect()
    assert len(rows) == len(texts)
    want = {i: base(t) for i, t in texts}
    for r in rows:
        n, places = want[r["doc_id"]]
        labels = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(labels)), r["doc_id"]
        assert r["first_word"] == (places[0][0] if places else None)
        assert r["last_word"] == (places[-1][0] if places else None)
        got = r["labels"].split(",") if r["labels"] else []
        assert set(labels) <= set(got) and got == sorted(set(got)) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in rows}
    assert by[9014]["labels"] == "mit" and by[9014]["n_base"] == 0 and by[9014]["n_fuzzy"] == 1
    assert licenses.license_digest(empty).count() == 0


def scan(text, known=licenses._NOTICES):
    u = np.frombuffer(text.encode(), np.uint8)
    return licenses.scan_chunk(u, np.array([0, len(u)]), known)[0]


@pytest.mark.parametrize("notice", licenses._NOTICES, ids=lambda n: f"{n.label}-{len(n.text)}")
def test_every_notice_survives_its_edits(notice):
    for k in range(notice.edits + 1):
        text = list(notice.text)
        step = len(text) // (notice.edits + 1)
        for j in range(k):
            text[j * step + step // 2] = "q"
        hits = scan("some words before " + "".join(text).title() + " and after")["hits"]
        h = next(h for h in hits if h[0] == notice.label)
        assert h[1] <= 3 and h[3] <= notice.edits, k


def least_edits(what, text):
    """Edit distance of ``what`` to the nearest run of whole words of ``text``."""
    words = text.split()
    best = len(what)
    for a in range(len(words)):
        row = list(range(len(what) + 1))
        own = " ".join(words[a:])
        ends = {len(" ".join(words[a:b])) for b in range(a + 1, len(words) + 1)}
        for i, c in enumerate(own[: 2 * len(what)], 1):
            last, row = row, [i]
            for j, d in enumerate(what, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            if i in ends:
                best = min(best, row[-1])
    return best


def test_fuzzy_hits_against_edit_distance():
    r = random.Random(3)
    known = licenses.notices("mit: licensed under the mit license\ncc0: creative commons zero v1 0 universal", {})
    found = 0
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 3)):
            t = list(r.choice(known).text)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = r.choice(["", "x", "e", " "])
            parts += ["".join(t), r.choice(["", "and so", "the"])]
        text = " ".join(" ".join(parts).split())
        hits = scan(text, known)["hits"]
        for n in known:
            own = [h for h in hits if h[0] == n.label]
            assert bool(own) == (least_edits(n.text, text) <= n.edits), text
            found += len(own)
    assert found > 60


def test_no_loose_matches():
    assert scan("all rights preserved and all nights reserved")["hits"] == []
    assert [h[0] for h in scan("// SPDX-License-Identifier: LGPL-2.1-or-later")["hits"]] == ["lgpl"]
    assert scan("SPDX-License-Identifier: GPLX-2.1")["hits"] == []


def test_a_worse_copy_before_a_better_one():
    exact = "under the terms of the gnu general public license"
    own = " ".join(["so", exact.replace("gnu", "gnv"), exact, exact.replace("terms", "term"), "end"])
    hits = [h for h in scan(own)["hits"] if h[0] == "gpl"]
    assert [(h[1], h[2], h[3]) for h in hits] == [(1, 9, 1), (10, 18, 0), (19, 27, 1)]
