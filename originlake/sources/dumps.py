"""Daily dumps: listing a mirrored tree and parsing ``.csv.xz`` files.

Spark's text readers take ``.xz`` for plain text without any error, so files are
read whole as binary and decompressed in the task, one file a row.
"""

from __future__ import annotations

import datetime as dt
import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.functions.dates import file_date, in_bounds
from originlake.functions.prefix import strip_as, with_prefix_key
from originlake.model import TAL_URLS

_TAL = r"/([^/]+?)\.tal/\d{4}/\d{2}/\d{2}/[^/]*$"


def list_dumps(
    spark: SparkSession,
    base: str,
    tal: str | None = None,
    since: dt.date | None = None,
    until: dt.date | None = None,
    name: str = "roas.csv.xz",
) -> DataFrame:
    """Files of ``<base>/<tal>.tal/YYYY/MM/DD/<name>`` as (url, tal, file_date), bounds inclusive.

    Only paths are read: the content column is pruned from the scan.
    """
    if tal is not None and tal not in TAL_URLS:
        raise ValueError(f"unknown trust anchor {tal!r}")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(base)
    )
    rows = files.select(
        F.col("path").alias("url"),
        F.regexp_extract("path", _TAL, 1).alias("tal"),
        file_date(F.col("path")).alias("file_date"),
    ).where((F.col("tal") != "") & in_bounds(F.col("file_date"), since, until))
    return rows if tal is None else rows.where(F.col("tal") == tal)


def _lines(content: bytes, path: str) -> Iterator[str]:
    if path.endswith(".xz"):
        content = lzma.decompress(content)
    elif path.endswith(".gz"):
        content = gzip.decompress(content)
    return iter(content.decode("utf-8").splitlines())


def _split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each file's lines (comma fields 1 to 3), or one row with the file's error."""
    names = ["path", "f1", "f2", "f3", "error"]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            rows, error, seen = [], None, False
            try:
                for line in _lines(content, path):
                    if line.startswith("URI"):
                        seen = True
                    elif not seen:
                        raise ValueError("data before the header")
                    else:
                        f = line.split(",")
                        if len(f) < 4:
                            raise ValueError("too few fields")
                        rows.append((path, f[1], f[2], f[3], None))
            except (ValueError, lzma.LZMAError, OSError) as e:
                rows, error = [], str(e)
            if error is not None:
                rows = [(path, None, None, None, error)]
            for i in range(0, len(rows), 50_000):
                cols = list(zip(*rows[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


def parse_dumps(spark: SparkSession, paths: list[str] | str, glob: str = "roas.csv*") -> DataFrame:
    """Observations of the given files or trees, with a row's or file's problem in ``error`` (else null).

    Columns: tal, prefix, fam, plen, lo, hi, max_len, asn, date, path, error. The
    maximum length falls back to the prefix length when it is no integer; rows are
    distinct within a file; an empty or header-only file has no rows; a file that
    cannot be read, or has data before its header, gives a single row with the error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return parse_contents(reader.load(paths).select("path", "content"))


def parse_contents(files: DataFrame) -> DataFrame:
    """``parse_dumps`` of rows (path, content)."""
    raw = files.mapInArrow(_split_files, "path string, f1 string, f2 string, f3 string, error string")
    rows = with_prefix_key(raw.withColumn("prefix", F.col("f2")))
    max_len = F.coalesce(F.trim("f3").try_cast("int"), F.col("plen").cast("int"))
    asn = strip_as(F.col("f1"))
    bad = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("prefix").isNull(), "bad prefix")
        .when(asn.isNull(), "bad asn")
        .when((max_len < 0) | (max_len > 255), "bad max_len")
    )
    return rows.select(
        F.regexp_extract("path", _TAL, 1).alias("tal"),
        "prefix",
        "fam",
        "plen",
        "lo",
        "hi",
        max_len.alias("max_len"),
        asn.alias("asn"),
        file_date(F.col("path")).alias("date"),
        "path",
        bad.alias("error"),
    ).dropDuplicates(["path", "prefix", "max_len", "asn", "error"])


def good_rows(parsed: DataFrame, keep_path: bool = False) -> DataFrame:
    """Rows of files without any problem: a file with one bad row is left out whole, as a failed file."""
    failed = parsed.where("error is not null").select("path").distinct()
    good = parsed.join(failed, "path", "left_anti").drop("error")
    return good if keep_path else good.drop("path")
