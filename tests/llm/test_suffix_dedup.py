import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from originlake.llm import phrases, suffix_dedup
from originlake.llm.text import prefix_hash


def brute(rows):
    """By definition: all 100-byte strings in order of their places (id, null first, and start)."""
    key = lambda i: -1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            w, at = b[p : p + 100], (key(i), p)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (key(i), p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def compare(df, rows):
    got = suffix_dedup.dedup_digest(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_query_against_definition(docs, texts, empty):
    compare(docs, [r for r in texts])
    assert suffix_dedup.dedup_digest(empty).count() == 0
    assert suffix_dedup.dedup_digest(docs).count() == len(texts)


@pytest.mark.parametrize("hot", [20_000, 40])
def test_planted_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED", 4000 if hot == 40 else 150_000)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(13)[:95]
    rows = []
    for i in range(220):
        t = text(r.randint(0, 60))
        if i % 3 == 0:
            t = t[: r.randint(0, 40)] + common[r.randint(0, 30) :] + text(9)
        if i % 4 == 1:
            t += "\n" + line + "\n" + text(30)
        if i % 10 == 7 and rows:
            src = r.choice(rows)[1]
            k = r.randint(0, len(src))
            t = src[:k] + r.choice(["", "x", "some more words"]) + src[k:]
        if i % 25 == 3:
            t += "z" * r.randint(90, 260)
        if i % 25 == 4:
            t += "ab" * 90 + t[:150]
        rows.append((i * 3, t))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    compare(df, rows)


@pytest.mark.parametrize("hot", [20_000, 30])
def test_rows_that_share_an_id_or_have_none(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(n))
    a, u = text(80), text(70)
    rows = [(1, a), (5, a), (5, u), (None, text(40)), (None, a[:300]), (None, a[:300]), (None, text(5) + a)]
    common = text(40)
    for k in range(60):
        rows.append((r.choice([None, 3, 3, k]), r.choice([common, ""]) + text(r.randint(0, 30)) + r.choice([common, common[50:], a[90:]]) + text(3)))
    rows += rows[-9:]
    r.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows)
    alone = [(1, a), (5, a), (5, u)]
    got = {(x["doc_id"], x["n_bytes"]): x["n_removed"] for x in suffix_dedup.dedup_digest(spark.createDataFrame(alone, "doc_id bigint, text string")).collect()}
    assert got == {(1, len(a.encode())): 0, (5, len(a.encode())): len(a.encode()), (5, len(u.encode())): 0}


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    common = text(400)
    rows = [(k, text(r.randint(0, 2500)) + common[r.randint(0, 200) :] + text(r.randint(0, 1500)) + common[: r.randint(0, 400)]) for k in range(25)]
    rows.append((90, "z" * 3000))
    compare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rows)


def test_corpus_order_is_the_suffix_order():
    r = random.Random(7)
    for n in (1, 9, 60, 400, 3000):
        raw = "".join(r.choice("ab ") for _ in range(n)) * r.choice([1, 3])
        raw = raw[: len(raw) // 2] + "q" * 300 + raw
        data = np.frombuffer(raw.encode(), np.uint8)
        order = phrases.corpus_order(data, prefix_hash(data)).tolist()
        b = raw.encode()
        whole = [p for p in order if p <= len(b) - 100]
        strings = [b[p : p + 100] for p in whole]
        assert sorted(order) == list(range(len(b))) and strings == sorted(strings)


def test_a_long_text_takes_bounded_memory():
    r = np.random.default_rng(8)
    base = r.integers(97, 123, 1 << 20, dtype=np.uint8).tobytes()
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([(base * 16).decode()], pa.large_string())], names=["_id", "_row", "text"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in suffix_dedup._parse(iter([b.slice(0, 1)])))
    assert rows > 1 << 18 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_documents_keep_rows_and_columns(docs, texts):
    own = docs.drop("length")
    out = suffix_dedup.dedup(own)
    assert out.schema.names == own.schema.names and out.count() == len(texts)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[9004]["text"] == "one two three"
