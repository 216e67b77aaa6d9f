import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from originlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll ", "12", "!", "...", "é", " ", "　", " ", "\u0085",
         "漢", "の", "🙂", "<|endoftext|>", "<|", "\r\n", "_", "The", "\x1c", "\x00", "٣", " ", "%%%", " ", " ", "à"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_any_mixture_equals_the_library(lib):
    enc, r = bpe.ForcedBPE(PATH), random.Random(11)
    for _ in range(5000):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert enc.encode(s) == ids, repr(s)
        raw = np.array(ids, "<u4").tobytes()
        assert enc.decode_bytes(raw) == lib.decode(ids, skip_special_tokens=False).encode()


def test_query_equals_the_library(docs, texts, empty, lib):
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs, PATH).collect()}
    assert bpe.encode_digests(docs, PATH).count() == len(texts)
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_memory_starts_afresh_at_its_bound(lib, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    enc = bpe.ForcedBPE(PATH)
    for k in range(60):
        s = " ".join(f"w{j}q{k}" for j in range(40)) + " the end"
        assert enc.encode(s) == lib.encode(s, add_special_tokens=False).ids
