import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

EDGE = [
    (9001, None),
    (9002, ""),
    (9003, " \t\n"),
    (9004, "one two three"),
    (9005, "x" * 70_000),
    (9006, "Same line here.\nSame line here.\n\nother | * # $ % & < >\nSame line here."),
    (9007, "mail a.b@c-d.example.org, x@y, @z.com 1.2.3.4 1.2.3.400 0001.2.3.4.5 10.0.0.0007"),
    (9008, "4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 +1 2 +49 30 1234 5678 9012 3456 +441234567890."),
    (9009, "All rights reserved. CC-BY 4.0, GNU General Public License; cc  by general public license"),
    (9010, "Ünïcödé é ̈ 漢字 の 🙂 　 <|endoftext|>'s don't  \r\n  end<|endoftext|>"),
    (9011, "the same words again and again and then " * 30),
    (9011, "the same words again and again and then " * 30),
    (9012, "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789 call 555-123-4567 or 555-123-4567"),
    (9013, "a@b.c@d.e f@g.h.i1+2@j.k 1.1.1.1.1.1.1.1 " + "7" * 5000 + " " + "1 " * 40),
    (9014, "Permission is hereby granted, free of charge, to any person obtainin a copy of this sofware"),
]


@pytest.fixture(scope="session")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edge = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    both = base.unionByName(edge)
    # other columns, some of them named like the operators' own results
    return both.select(
        "doc_id", "text", F.lit("x").alias("spans"), F.lit(1).alias("n_words"), F.lit(None).alias("length"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"),
    )


@pytest.fixture(scope="session")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
