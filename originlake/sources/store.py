"""The stored history: versioned Parquet snapshots behind a pointer, opened after a version check.

A writer makes ``<path>/v=<n>`` whole, then replaces ``<path>/CURRENT`` by
rename; readers that opened an older snapshot keep it. All file operations go
through Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.model import FORMAT_VERSION
from originlake.operators.history import counts, latest_date
from originlake.operators.index import with_roots

log = logging.getLogger(__name__)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def read_text(spark: SparkSession, path: str) -> str:
    fs, path_of = _fs(spark, path)
    stream = fs.open(path_of(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it: never across file systems."""
    fs, path_of = _fs(spark, path)
    tmp = path_of(f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    ctx = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    opts = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    opts[0] = rename
    ctx.rename(tmp, path_of(path), opts)


def delete(spark: SparkSession, path: str) -> None:
    fs, path_of = _fs(spark, path)
    fs.delete(path_of(path), True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a file or folder in another's place; at every moment one of them is there, at ``path`` or beside it as ``.old``."""
    fs, path_of = _fs(spark, path)
    old = f"{path}.old"
    if fs.exists(path_of(path)):
        fs.delete(path_of(old), True)
        if not fs.rename(path_of(path), path_of(old)):
            raise OSError(f"cannot rename {path}")
    if not fs.rename(path_of(new), path_of(path)):
        fs.rename(path_of(old), path_of(path))
        raise OSError(f"cannot rename {new}")
    fs.delete(path_of(old), True)


def _clean(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the latest snapshots."""
    fs, path_of = _fs(spark, path)
    names = sorted((s.getPath().getName() for s in fs.listStatus(path_of(path)) if s.getPath().getName().startswith("v=")), key=lambda n: int(n[2:]))
    for n in names[:-keep]:
        fs.delete(path_of(f"{path}/{n}"), True)


def publish(history: DataFrame, path: str, keep: int = 3) -> str:
    """Write a snapshot (rows with roots, sorted by key for row-group pruning, and metadata), then flip to it.

    The ``keep`` latest snapshots stay, for readers that opened an older one.
    """
    spark = history.sparkSession
    snap = f"{path}/v={time.time_ns()}"
    indexed = with_roots(history)
    indexed.repartitionByRange("fam", "lo", "plen").sortWithinPartitions(
        "fam", "lo", "plen", "origin", "max_len"
    ).write.parquet(f"{snap}/history")
    stored = spark.read.parquet(f"{snap}/history")
    n = counts(stored).groupBy().agg(
        *[
            F.coalesce(F.sum(F.when(F.col("fam") == f, F.col(c))), F.lit(0)).alias(f"v{f}_{c}")
            for f in (4, 6)
            for c in ("prefixes", "records")
        ]
    )
    n.join(latest_date(stored)).withColumn("format_version", F.lit(FORMAT_VERSION)).coalesce(1).write.parquet(f"{snap}/meta")
    swap_text(spark, f"{path}/CURRENT", snap.rsplit("/", 1)[1])
    _clean(spark, path, keep)
    return snap


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the current snapshot; another format version is an error."""
    if not exists(spark, f"{path}/CURRENT"):
        raise FileNotFoundError(f"no history at {path}")
    snap = f"{path}/{read_text(spark, f'{path}/CURRENT')}"
    version = spark.read.parquet(f"{snap}/meta").first()["format_version"]
    if version != FORMAT_VERSION:
        raise ValueError(f"format version {version} is not supported; expected {FORMAT_VERSION}")
    return spark.read.parquet(f"{snap}/history")


def store_meta(spark: SparkSession, path: str) -> dict:
    """Counts of both conventions, latest date and format version of the current snapshot."""
    return spark.read.parquet(f"{path}/{read_text(spark, f'{path}/CURRENT')}/meta").first().asDict()


def bootstrap(spark: SparkSession, path: str, sources: list[str]) -> bool:
    """Make a missing store from the first transport that can be read, local ones before remote; no-op where a store is."""
    from originlake.sources.jsonl import read_jsonl

    if exists(spark, f"{path}/CURRENT"):
        return False
    for src in sorted(sources, key=lambda s: "://" in s and not s.startswith("file:")):
        try:
            if exists(spark, src):
                publish(read_jsonl(spark, src), path)
                return True
        except Exception:
            log.exception("cannot make the store from %s", src)
    raise FileNotFoundError(f"no history at {path} and none of {sources}")
