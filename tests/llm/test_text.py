import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from originlake.llm import jaccard, text


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_words_of_long_texts_in_segments(monkeypatch):
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("aB \n" if r.random() < 0.7 else "xyz") for _ in range(r.choice([0, 1, 7, 40, 90]))) for _ in range(5)]
        data, offsets = buffers(texts)
        monkeypatch.setattr(text, "CHUNK_BYTES", 1 << 20)
        want = text.word_hashes(data, offsets)
        monkeypatch.setattr(text, "CHUNK_BYTES", r.choice([1, 3, 8, 30]))
        got = text.word_hashes(data, offsets)
        assert got[1].tolist() == want[1].tolist() and got[0].tolist() == want[0].tolist()


def test_shingles_of_a_long_text_take_bounded_memory():
    r = np.random.default_rng(2)
    words = [b"w%d " % k for k in r.integers(0, 1 << 40, 1 << 16)]
    data = np.frombuffer(b"".join(words[k] for k in r.integers(0, 1 << 16, 64 * (1 << 20) // 14)), np.uint8)
    assert len(data) > 50 << 20
    tracemalloc.start()
    sets = jaccard.shingle_sets(data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 8 * len(data) and len(sets[0]) > 1 << 21
    tracemalloc.stop()


def test_tables_are_written_and_removed(spark, tmp_path):
    t = text.cut(spark.range(9).select(F.col("id").alias("a")))
    assert t.count() == 9
    text.drop(t)
    with pytest.raises(Exception, match="(?i)not.*(found|exist)"):
        spark.read.parquet(t._cut_path)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        text.shared_dir(Session())


def test_settled_results_leave_nothing_else(spark):
    made = []

    def make():
        made.append(text.cut(spark.range(5)))
        made.append(text.settled(lambda: text.cut(made[0].where("id > 1"))))
        return made[1].where("id > 2")

    out = text.settled(make)
    assert out.count() == 2
    for t in made:
        with pytest.raises(Exception, match="(?i)not.*(found|exist)"):
            spark.read.parquet(t._cut_path)
