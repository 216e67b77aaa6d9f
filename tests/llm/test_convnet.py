import tracemalloc
import zlib

import numpy as np

from originlake.llm import convnet, entry


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(32, 120, n, dtype=np.uint8)) for n in (0, 5, 700, 130)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    y = np.array([1, 0, 1, 0.0])
    w = {k: v.astype(float) for k, v in convnet.start_weights(0.7).items()}
    w["w3"] = r.normal(0, 0.3, 2 * convnet.HIDDEN)

    def loss():
        o = convnet.forward(w, data, off)
        return np.mean(np.log1p(np.exp(-o)) * y + np.log1p(np.exp(o)) * (1 - y))

    g = convnet.gradients(w, data, off, y, np.ones(4))
    for k in w:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = w[k][i]
        w[k][i] = old + 1e-5
        up = loss()
        w[k][i] = old - 1e-5
        down = loss()
        w[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-4


def test_scores_do_not_depend_on_neighbours():
    w = convnet.start_weights(0.8)
    w["w3"] += 0.1
    texts = [b"", b"abc", b"x" * 1000, b"some longer text " * 40]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    alone = [convnet.forward(w, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(convnet.forward(w, data, off), alone, atol=1e-5)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.96


def test_edges(spark, docs, texts, empty, labels):
    w = convnet.fit(docs, labels.limit(0))
    assert convnet.score(docs, w).where("score between 0 and 1").count() == len(texts)
    assert convnet.score(docs, w).where("score < 0.7").count() == 0
    assert convnet.score(empty, w).count() == 0


def test_sample_is_bounded(spark, docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(convnet, "train", lambda texts, y: seen.append(texts))
    convnet.fit(docs, labels, most_bytes=40_000)
    convnet.fit(docs, labels, most=10)
    assert seen[0] and sum(map(len, seen[0])) <= 40_000 and max(map(len, seen[0])) <= 2500
    assert 0 < len(seen[1]) <= 10


def test_pieces_of_a_long_text(monkeypatch):
    r = np.random.default_rng(1)
    w = convnet.start_weights(0.8)
    w["w3"] = r.normal(0, 0.3, 2 * convnet.HIDDEN).astype(np.float32)
    data = r.integers(32, 250, 70_001, dtype=np.uint8)
    whole = convnet.forward(w, data, np.array([0, 30_000, len(data)]))
    monkeypatch.setattr(convnet, "PIECE", 7)
    assert np.allclose(convnet.forward(w, data, np.array([0, 30_000, len(data)])), whole, atol=1e-5)


def test_memory_of_a_long_text():
    data = np.frombuffer(b"some words of a very long text, " * (1 << 21), np.uint8)  # 64 MB
    w = convnet.start_weights(0.8)
    tracemalloc.start()
    convnet.forward(w, data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 12 * len(data)
    tracemalloc.stop()
