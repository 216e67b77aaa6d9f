import re
from collections import Counter

import numpy as np

from originlake.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, hit = Counter(wins), set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            hit.update(range(i, i + 8))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)]


def test_counts_and_base(docs, texts, labels, empty):
    rows = q.quality_rules(docs, labels).collect()
    assert len(rows) == len(texts)
    want = {i: counts(t) for i, t in texts}
    for r in rows:
        c = want[r["doc_id"]]
        assert [r[n] for n in q.COUNTS] == c, r["doc_id"]
        assert r["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r["base_failed"] and r["kept"])
    assert q.quality_rules(empty, labels).count() == 0
    assert q.quality_rules(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_learned_list_finds_a_planted_rule():
    r = np.random.default_rng(3)
    x = {"a": r.random(900), "b": r.random(900), "c": r.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] < 0.5))
    rules = q.learn_list(x, bad)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= q._covers(rule, x)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * (~bad).sum()


def test_list_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = q.quality_rules(docs, lab).join(lab, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")
    n = {(r["kept"], r["quality"]): r["count"] for r in got.where("n_words >= 20").groupBy("kept", "quality").count().collect()}
    assert n.get((False, 1), 0) <= 0.03 * sum(v for (k, y), v in n.items() if y == 1)
    assert n.get((False, 0), 0) >= 0.7 * sum(v for (k, y), v in n.items() if y == 0)
