import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from originlake.llm import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, seq_len):
    """Sequences are gapless from 0 and within the length; returns their number."""
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values(), default=0) <= seq_len
    return len(at)


def test_every_token_once(docs, texts, empty):
    lib = Tokenizer.from_file(PATH)
    rows = [r.asDict() for r in pack.pack(docs, PATH, keep_ids=True).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(x == i for x, _ in texts)
        own = sorted(by[i], key=lambda r: r["piece"])[::copies]
        k = -(-len(ids) // 2048)
        assert [r["piece"] for r in own] == list(range(k))
        assert all(r["length"] == 2048 for r in own[1:])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
        assert len(by[i]) == copies * k
    used = check(rows, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert pack.pack(empty, PATH).count() == 0


def test_plan_uses_each_length_as_often_as_it_stands():
    r = np.random.default_rng(1)
    for lens in (r.integers(1, 65, 3000), np.full(500, 40), np.array([64] * 7 + [1]), r.choice([33, 31, 17], 999), np.zeros(0, int)):
        hist = np.bincount(lens, minlength=65)
        done = np.zeros(65, int)
        bins = 0
        for items, n in pack.plan(hist, 64):
            assert sum(items) <= 64
            bins += n
            for v in items:
                done[v] += n
        assert (done[1:] == hist[1:]).all()
        assert bins <= len(pack.best_fit(hist, 64)) or bins <= 1.05 * sum(n for _, n in pack.best_fit(hist, 64)) + 1
