import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from originlake.llm import jaccard, pii, suffix_dedup
from originlake.llm.text import cut

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    for d in seen[1:-1]:
        assert d.columns == docs.columns
    n = [d.count() for d in seen[:-1]]
    assert n[0] >= n[1] > n[2] >= n[3] == n[4]
    # what each stage promises about its own output
    assert jaccard.near_duplicates(seen[2]).where("doc_id <> component_id").count() == 0
    assert suffix_dedup.dedup_digest(seen[3]).agg({"n_removed": "sum"}).first()[0] < 400  # only strings that removal made
    assert pii.pii_digest(seen[4]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(seen[5].collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["ids"])
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert ids == {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in texts.items()}
    assert corpus_pipeline.run(spark, SF).count() == seen[5].count()


def test_one_row_of_copies_with_shared_or_null_ids(spark):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(5, words(1, 40)), (5, words(1, 40)), (5, words(2, 40)), (3, words(2, 40) + " more"), (None, words(3, 40)), (None, words(3, 40))]
    rows += [(None, words(4, 40)), (9, words(4, 41)), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    want = [(5, words(1, 40)), (3, words(2, 40) + " more"), (None, words(3, 40)), (None, words(4, 40)), (7, ""), (7, ""), (8, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_texts_stay_when_passages_go(spark):
    rows = [(1, "", "a"), (2, None, "b"), (3, "x" * 50 + "y" * 70, "c"), (4, "x" * 50 + "y" * 70, "d"), (5, "short", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(tuple(r) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect())
    assert got == [(1, "", "a"), (2, "", "b"), (3, "x" * 50 + "y" * 70, "c"), (5, "short", "e")]
