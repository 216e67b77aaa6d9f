import random
import re

import numpy as np
import pytest

from originlake.llm import graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return sorted((i, len(a), top(i)) for i, a in sets)


def near_groups(seed, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = [word() for _ in range(70)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and rows:
            w = r.choice(rows[-40:])[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                if w:
                    k = r.randrange(len(w))
                    w[k : k + r.randint(0, 1)] = [word()] * r.randint(0, 2)
        else:
            w = [word() for _ in range(r.choice([0, 2, 4, 5, 6, 20, 60, 150, 400]))]
            if kind > 0.8:
                w[len(w) // 2 : len(w) // 2] = common[: r.randint(5, 70)]
        t = " ".join(w)
        rows.append((i * 7 % 1009, t.upper() if r.random() < 0.2 else t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = near_groups(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(df).collect())
    want = brute(rows)
    assert got == want
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df, large=300).collect()) == want
    assert len({c for _, _, c in want}) < len(rows) - 60


def test_blocks_and_copied_partners(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 5)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    base = near_groups(3, 60)
    r = random.Random(9)
    big = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = list(base)
    for k in range(90):
        w = list(big)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"x{k}"
        rows.append((5000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = brute(rows)
    assert sorted(tuple(x) for x in jaccard.near_duplicates(df).collect()) == want
    assert sorted(tuple(x) for x in jaccard.near_duplicates(df, block=8, large=900).collect()) == want


def test_hot_tiles_in_blocks():
    sketch = jaccard.Sketch([])
    sketch.mean = 1.0
    assert sketch.blocks(np.array([0, 40, 60])).tolist() == [1, 1, 10]


def test_few_rows_of_a_frequent_hash_in_several_blocks(spark):
    notice = [f"n{k}" for k in range(24)]  # frequent in all texts, among the rarest of the short ones only
    rows = [(k, " ".join([f"r{k}x{j}" for j in range(300)] + notice)) for k in range(160)]
    rows += [(1000 + k, " ".join([*notice, f"t{k}"])) for k in range(5)]
    want = brute(rows)
    assert {c for i, _, c in want if i >= 1000} == {1000}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    assert sorted(tuple(x) for x in jaccard.near_duplicates(df, block=4).collect()) == want


@pytest.mark.parametrize("large", [jaccard.LARGE, 300])
def test_blocks_with_rows_of_distant_sizes(spark, large):
    notice = [f"n{k}" for k in range(84)]
    rows = [(k, " ".join([f"r{k}x{j}" for j in range(400)] + notice)) for k in range(160)]
    rows += [(1000 + k, " ".join(notice[:14] + [f"s{k}"])) for k in range(6)]  # 11 shingles
    rows += [(2000 + k, " ".join([f"t{k}", *notice])) for k in range(6)]  # 81 shingles
    rows += [(3000 + k, " ".join([*notice, *(f"u{k}x{j}" for j in range(25 - k))])) for k in range(6)]
    want = brute(rows)
    assert {c for i, _, c in want if i >= 1000} == {1000, 2000}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    assert sorted(tuple(x) for x in jaccard.near_duplicates(df, block=4, large=large).collect()) == want


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 70, 500, 3000):
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 1 << 62, n // 3, dtype=np.uint64)]))
        diff = len(np.setxor1d(a, b))
        assert jaccard.flipped(*(np.frombuffer(jaccard.bitmap(v), np.uint64) for v in (a, b))) <= diff


def test_query_edges(spark, docs, texts, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()))
    once = sorted(dict(texts).items())
    want = {i: (n, c) for i, n, c in brute(once)}
    assert len(got) == len(texts)
    assert all((n, c) == want[i] for i, n, c in got)
    assert jaccard.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "A b c d e f"), (5, "other words stand in this one"), (6, "other words stand in this one")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard.near_duplicates(odd).collect()) == [(-1, None), (5, None), (5, None), (6, None)]


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 499), (499, 700), (700, 650)]
    r.shuffle(edges)
    df = spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "a bigint, b bigint")
    got = dict(map(tuple, graph.components(df).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {i: 499 for i in (499, 500, 650, 700)}
    assert graph.components(df.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    # hubs whose own id is the largest, repeated and reversed edges, loops, ids below zero, long paths out of order
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(70)] + [(10_000, i) for i in range(200, 260)]
    path = r.sample(range(1000, 1200), 200)
    edges += [*zip(path, path[1:], strict=False), (5000, 5000), *[(300, 301)] * 3]
    least = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(least)
    assert dict(map(tuple, got)) == least
