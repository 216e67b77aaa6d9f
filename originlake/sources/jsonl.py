"""JSON-lines transport: one record a line, ``{"p","m","o","r"}`` with ranges in epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.functions.dates import date_to_epoch, epoch_to_date
from originlake.functions.prefix import with_prefix_key
from originlake.model import ASN_MAX, JSONL_SCHEMA, MAX_LEN_MAX
from originlake.operators.history import merge_history
from originlake.operators.query import ORDER

_EMPTY = "array<struct<start:date,end:date>>"


def _problem() -> F.Column:
    r = F.col("r")
    return (
        F.when(F.col("_corrupt").isNotNull() | F.col("p").isNull() | F.col("m").isNull() | F.col("o").isNull(), "bad record")
        .when(r.isNull() | F.exists(r, lambda x: x.isNull() | (F.size(x) != 2) | x[0].isNull() | x[1].isNull()), "bad record")
        .when((F.col("m") < 0) | (F.col("m") > MAX_LEN_MAX), "bad max_len")
        .when((F.col("o") < 0) | (F.col("o") > ASN_MAX), "bad origin")
        .when(F.exists(r, lambda x: x[0] > x[1]), "invalid date range")
    )


def _where(spark: SparkSession, path: str, what: str, prefix_only: bool) -> str:
    """Line of the first bad record, counting blank lines; a second pass, on the error path only."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[0].strip(), x[1] + 1))
    df = spark.createDataFrame(lines, "line string, n bigint").where("line <> ''")
    parsed = df.select("n", F.from_json("line", JSONL_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    parsed = parsed.select("n", "j.*")
    bad = (
        with_prefix_key(parsed.withColumnRenamed("p", "prefix")).where("prefix is null")
        if prefix_only
        else parsed.where(_problem().isNotNull())
    )
    return f"{path}: {what} at line {bad.agg(F.min('n')).first()[0]}"


def read_jsonl(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Transport file(s) to history rows, repeated keys merged.

    Blank lines are skipped. With ``check`` any malformed record, value out of
    range, bad prefix or inverted range is a ValueError naming its line; without
    it such records are left out.
    """
    raw = spark.read.schema(JSONL_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = with_prefix_key(raw.withColumn("_why", _problem()).withColumnRenamed("p", "prefix"))
    if check:
        bad = rows.where(F.col("_why").isNotNull() | F.col("prefix").isNull()).select("_why").first()
        if bad is not None:
            raise ValueError(_where(spark, path, bad[0] or "bad prefix", bad[0] is None))
    rows = rows.where(F.col("_why").isNull() & F.col("prefix").isNotNull())
    ranges = F.transform(
        "r", lambda x: F.struct(epoch_to_date(x[0]).alias("start"), epoch_to_date(x[1]).alias("end"))
    )
    return merge_history(
        rows.select(
            "prefix",
            "fam",
            "plen",
            "lo",
            "hi",
            F.col("m").cast("smallint").alias("max_len"),
            F.col("o").alias("origin"),
            F.coalesce(ranges, F.array().cast(_EMPTY)).alias("ranges"),
        )
    )


def jsonl_lines(history: DataFrame) -> DataFrame:
    """History rows as transport text, field order p, m, o, r, in result order."""
    r = F.transform("ranges", lambda x: F.array(date_to_epoch(x["start"]), date_to_epoch(x["end"])))
    return history.orderBy(*ORDER).select(
        F.to_json(
            F.struct(F.col("prefix").alias("p"), F.col("max_len").alias("m"), F.col("origin").alias("o"), r.alias("r"))
        ).alias("value")
    )


def export_jsonl(history: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the transport, gzip-compressed; range-sorted part files unless a single one is asked for."""
    lines = jsonl_lines(history)
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").option("compression", "gzip").text(path)
