"""History construction: observations to inclusive date ranges, gap filling, appends, merges.

Every step is keyed by (fam, plen, lo, max_len, origin) and keeps one hash
partitioning on that key from the first shuffle on, so dedup, windows and the
closing aggregation share a single exchange. The days of one key are bounded by
the calendar (some thousands), so no key is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originlake.model import KEY, known_gaps

DAY_RANGE = [*KEY, "start", "end"]


def observations_dedup(obs: DataFrame) -> DataFrame:
    """Distinct observation rows over all five fields, as within one source file."""
    return obs.dropDuplicates()


def observed_days(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Set of days for each key; the trust anchor no longer counts."""
    days = obs.withColumnRenamed("asn", "origin") if "asn" in obs.columns else obs
    return days.select(*key, F.col("date").alias("day")).repartition(*key).dropDuplicates([*key, "day"])


def _islands(days: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("day")
    return (
        days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
        .groupBy(*key, "island")
        .agg(F.min("day").alias("start"), F.max("day").alias("end"))
        .drop("island")
    )


def date_islands(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Observations to maximal runs of consecutive days, one row a run."""
    return _islands(observed_days(obs, key), key)


def union_ranges(ranges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Overlapping, adjacent and repeated ranges of a key become maximal disjoint ones.

    Runs on range bounds, without expanding days: a range opens a new run when it
    starts more than a day after every end before it.
    """
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("_reach", F.max("end").over(before))
        .withColumn(
            "_run",
            F.sum(
                F.when(F.col("_reach").isNull() | (F.col("start") > F.date_add("_reach", 1)), 1).otherwise(0)
            ).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .groupBy(*key, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_run")
    )


def split_ranges(ranges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Compatibility form of compression: days are sorted but not deduplicated, so overlaps split ranges.

    [1,3] and [2,4] give (1,2), (2,3), (3,4). Membership equals that of ``union_ranges``.
    """
    w = Window.partitionBy(*key).orderBy("day", "_n")
    days = ranges.withColumn("day", F.explode(F.sequence("start", "end"))).withColumn(
        "_n", F.monotonically_increasing_id()
    )
    return (
        days.withColumn("_prev", F.lag("day").over(w))
        .withColumn(
            "_run",
            F.sum(F.when(F.col("day") == F.date_add("_prev", 1), 0).otherwise(1)).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .groupBy(*key, "_run")
        .agg(F.min("day").alias("start"), F.max("day").alias("end"))
        .drop("_run")
    )


def fill_known_gaps(ranges: DataFrame, key: list[str] = KEY, gaps: DataFrame | None = None) -> DataFrame:
    """Bridge adjacent ranges whose hole is exactly one listed gap.

    Both boundaries must match, and abutting listed gaps never chain. Filling
    removes a boundary pair and makes no new one, so a single pass is complete.
    The 76-row gap relation is broadcast; ranges must be disjoint (compress first).
    """
    gaps = known_gaps(ranges.sparkSession) if gaps is None else gaps
    w = Window.partitionBy(*key).orderBy("start")
    gap = F.broadcast(
        gaps.select(
            F.date_sub("gap_start", 1).alias("_prev"), F.date_add("gap_end", 1).alias("start"), F.lit(0).alias("_new")
        )
    )
    return (
        ranges.withColumn("_prev", F.lag("end").over(w))
        .join(gap, ["_prev", "start"], "left")
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_run")
    )


def append_days(ranges: DataFrame, obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Incremental update: only days after a key's last end count; earlier ones drop, even into holes.

    A day right after the last end extends that range. Equals applying the new
    days one by one in date order. The stored side is only aggregated, never expanded.
    """
    new = observed_days(obs, key)
    last = ranges.groupBy(*key).agg(F.max("end").alias("_last"))
    late = new.join(last, key, "left").where(F.col("_last").isNull() | (F.col("day") > F.col("_last"))).drop("_last")
    return union_ranges(ranges.select(*key, "start", "end").unionByName(_islands(late, key)), key)


def rebuild_merge(ranges: DataFrame, obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Order-free repair: all observed days count, including those inside historical holes."""
    return union_ranges(ranges.select(*key, "start", "end").unionByName(date_islands(obs, key)), key)


def nest(ranges: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row a key with ``ranges`` ordered by start; ``carry`` columns depend on the key."""
    return ranges.groupBy(*KEY).agg(
        *[F.first(c, True).alias(c) for c in carry],
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"),
    )


def unnest(history: DataFrame) -> DataFrame:
    """One row a range; a key without ranges has none."""
    rest = [c for c in history.columns if c != "ranges"]
    return history.select(*rest, F.explode("ranges").alias("_r")).select(*rest, "_r.start", "_r.end")


def merge_history(history: DataFrame) -> DataFrame:
    """Merge rows of one key (from imports or several stores) into one with united ranges.

    Keys without any range stay, with an empty array.
    """
    flat = unnest(history).select(*DAY_RANGE)
    keys = history.groupBy(*KEY).agg(F.first("prefix", True).alias("prefix"), F.first("hi", True).alias("hi"))
    return (
        keys.join(nest(union_ranges(flat)), KEY, "left")
        .withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start:date,end:date>>")))
        .select("prefix", "fam", "plen", "lo", "hi", "max_len", "origin", "ranges")
    )


def build_history(obs: DataFrame, fill: bool = False) -> DataFrame:
    """Bulk load: observations with prefix keys to nested history rows. Gap filling is an explicit step."""
    obs = obs.withColumnRenamed("asn", "origin") if "asn" in obs.columns else obs
    ranges = date_islands(obs)
    if fill:
        ranges = fill_known_gaps(ranges)
    names = obs.groupBy("fam", "plen", "lo").agg(F.first("prefix", True).alias("prefix"), F.first("hi").alias("hi"))
    return (
        nest(ranges)
        .join(names, ["fam", "plen", "lo"])
        .select("prefix", "fam", "plen", "lo", "hi", "max_len", "origin", "ranges")
    )


def fix_history(history: DataFrame) -> DataFrame:
    """Transport repair: compress, then fill the known gaps."""
    flat = fill_known_gaps(union_ranges(unnest(history).select(*DAY_RANGE)))
    names = history.groupBy(*KEY).agg(F.first("prefix", True).alias("prefix"), F.first("hi", True).alias("hi"))
    return (
        names.join(nest(flat), KEY, "left")
        .withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start:date,end:date>>")))
        .select("prefix", "fam", "plen", "lo", "hi", "max_len", "origin", "ranges")
    )


def latest_date(history: DataFrame) -> DataFrame:
    """One row, ``latest_date``: the last day of any range; 1970-01-01 for an empty store."""
    return history.agg(
        F.coalesce(F.max(F.array_max(F.transform("ranges", lambda r: r["end"]))), F.lit("1970-01-01").cast("date")).alias(
            "latest_date"
        )
    )


def counts(history: DataFrame) -> DataFrame:
    """One row a family: distinct prefixes (the store's own count) and records (the older convention)."""
    return history.groupBy("fam").agg(
        F.countDistinct("plen", "lo").alias("prefixes"), F.count(F.lit(1)).alias("records")
    )


def prefix_count(history: DataFrame) -> int:
    """The store's size: its distinct prefixes."""
    return history.select("fam", "plen", "lo").distinct().count()


def is_empty(history: DataFrame) -> bool:
    return history.isEmpty()


def insert_records(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with further rows; ranges of a key that both have are united."""
    cols = ["prefix", "fam", "plen", "lo", "hi", "max_len", "origin", "ranges"]
    return merge_history(history.select(cols).unionByName(rows.select(cols)))


def replace_records(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History in which rows take the place of those with the same key."""
    cols = ["prefix", "fam", "plen", "lo", "hi", "max_len", "origin", "ranges"]
    return history.join(rows.select(*KEY), KEY, "left_anti").select(cols).unionByName(rows.select(cols))


def active_on(day: Column | str) -> Column:
    """Whether any range of the row covers the day, both ends included."""
    d = F.lit(day).cast("date") if not isinstance(day, Column) else day
    return F.exists("ranges", lambda r: (r["start"] <= d) & (r["end"] >= d))
