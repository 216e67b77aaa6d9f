"""Schemas, constants and the two small fixed relations of the data model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMAT_VERSION = 2
ASN_MAX = 4294967295
MAX_LEN_MAX = 255
PAGE_SIZE_DEFAULT = 100
PAGE_SIZE_CAP = 1000
EPOCH = dt.date(1970, 1, 1)

#: Logical key of a history row; the trust anchor is used for file-level dedup only.
KEY = ["fam", "plen", "lo", "max_len", "origin"]

RANGE = T.StructType([T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])

OBS_SCHEMA = T.StructType(
    [
        T.StructField("tal", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("max_len", T.IntegerType()),
        T.StructField("asn", T.LongType()),
        T.StructField("date", T.DateType()),
    ]
)

#: JSON-lines transport; wider than the value ranges so that bad values can be rejected by predicate.
JSONL_SCHEMA = T.StructType(
    [
        T.StructField("p", T.StringType()),
        T.StructField("m", T.LongType()),
        T.StructField("o", T.LongType()),
        T.StructField("r", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("_corrupt", T.StringType()),
    ]
)

# Trust anchors and the base addresses of their dumps.
TAL_URLS = {
    "afrinic": "https://ftp.ripe.net/rpki/afrinic.tal",
    "apnic": "https://ftp.ripe.net/rpki/apnic.tal",
    "arin": "https://ftp.ripe.net/rpki/arin.tal",
    "lacnic": "https://ftp.ripe.net/rpki/lacnic.tal",
    "ripencc": "https://ftp.ripe.net/rpki/ripencc.tal",
}

# Known gaps in the published dumps, first and last missing day of each.
KNOWN_GAPS_TEXT = """
2016-01-27 2016-01-29
2018-12-28 2019-01-02
2019-10-22 2019-10-22
2019-11-24 2019-11-24
2020-02-24 2020-02-24
2020-04-06 2020-04-06
2020-08-03 2020-08-03
2021-01-04 2021-01-04
2021-02-28 2021-02-28
2021-04-22 2021-04-22
2021-04-25 2021-04-27
2021-07-15 2021-07-15
2021-07-19 2021-07-19
2021-07-23 2021-07-23
2021-07-31 2021-07-31
2021-08-06 2021-08-09
2021-08-10 2021-08-10
2021-08-11 2021-08-11
2021-08-13 2021-08-14
2021-08-16 2021-08-16
2021-08-20 2021-08-23
2021-08-26 2021-08-28
2021-09-03 2021-09-03
2021-09-04 2021-09-05
2021-09-06 2021-09-07
2021-09-08 2021-09-09
2021-09-10 2021-09-25
2021-09-26 2021-09-26
2021-09-27 2021-09-28
2021-11-12 2021-11-12
2021-12-03 2021-12-10
2021-12-13 2021-12-15
2022-01-03 2022-01-06
2022-01-08 2022-01-14
2022-01-15 2022-01-15
2022-01-16 2022-01-18
2022-01-19 2022-01-19
2022-01-20 2022-01-22
2022-01-24 2022-01-24
2022-01-25 2022-02-01
2022-02-02 2022-02-03
2022-02-04 2022-02-04
2022-02-05 2022-02-12
2022-02-13 2022-02-15
2022-02-16 2022-02-17
2022-06-14 2022-06-14
2022-08-27 2022-08-27
2022-09-06 2022-09-06
2022-09-08 2022-09-08
2022-09-10 2022-09-10
2022-09-14 2022-09-14
2022-09-17 2022-09-17
2022-09-20 2022-09-22
2022-09-24 2022-09-24
2022-09-26 2022-09-26
2022-09-30 2022-09-30
2022-10-03 2022-10-03
2022-10-05 2022-10-05
2022-10-07 2022-10-07
2022-10-10 2022-10-10
2022-10-14 2022-10-14
2022-10-16 2022-10-16
2022-10-19 2022-10-20
2022-10-22 2022-10-23
2022-10-26 2022-10-26
2023-06-24 2023-06-24
2023-07-14 2023-07-17
2023-08-04 2023-08-04
2026-03-27 2026-04-03
2026-04-04 2026-04-04
2026-04-05 2026-04-10
2026-04-24 2026-04-24
2026-04-30 2026-05-03
2026-05-28 2026-05-28
2026-06-13 2026-06-13
2026-06-28 2026-06-28
"""

KNOWN_GAPS = [
    tuple(dt.date.fromisoformat(d) for d in line.split()) for line in KNOWN_GAPS_TEXT.split("\n") if line
]


def known_gaps(spark: SparkSession) -> DataFrame:
    """known_gaps(gap_start, gap_end): 76 inclusive ranges, small enough to broadcast always."""
    return spark.createDataFrame(KNOWN_GAPS, "gap_start date, gap_end date")


def tal_catalog(spark: SparkSession, tal: str | None = None) -> DataFrame:
    """tal_catalog(tal, url); an unknown name is a ValueError."""
    if tal is not None and tal not in TAL_URLS:
        raise ValueError(f"unknown trust anchor {tal!r}; one of {', '.join(TAL_URLS)}")
    rows = [(k, v) for k, v in TAL_URLS.items() if tal in (None, k)]
    return spark.createDataFrame(rows, "tal string, url string")
