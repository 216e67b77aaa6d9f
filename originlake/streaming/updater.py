"""Incremental updates as a Structured Streaming job over a tree of daily dumps.

The file source's checkpoint remembers files, not a date, so a late trust anchor
is not lost; files that failed are kept in a list beside the store and tried
again with each batch, and at each interval. Within a batch files are applied in
date order by construction: an append counts all of a key's new days at once. A
file that comes right later is merged without regard to order.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from originlake.functions.prefix import with_prefix_key
from originlake.operators.history import DAY_RANGE, append_days, fill_known_gaps, nest, rebuild_merge, unnest
from originlake.sources.dumps import good_rows, parse_dumps
from originlake.sources.jsonl import export_jsonl
from originlake.sources.store import delete, exists, open_store, publish, read_text, swap_text

log = logging.getLogger(__name__)

_ONE_AT_A_TIME = threading.Lock()

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def update_history(history: DataFrame | None, obs: DataFrame, fill: bool = True, late: DataFrame | None = None) -> DataFrame:
    """History after new observations (with prefix keys): append, then bridge known gaps.

    ``late`` observations, of files that failed before, count for all their days, also those before a key's last one.
    """
    obs = obs.withColumnRenamed("asn", "origin")
    names = obs.select("fam", "plen", "lo", "prefix", "hi")
    if history is None:
        old = obs.select(*[c for c in DAY_RANGE if c not in ("start", "end")]).limit(0)
        old = old.withColumn("start", F.lit(None).cast("date")).withColumn("end", F.lit(None).cast("date"))
    else:
        old = unnest(history).select(*DAY_RANGE)
        names = names.unionByName(history.select("fam", "plen", "lo", "prefix", "hi"))
    ranges = append_days(old, obs)
    if late is not None:
        ranges = rebuild_merge(ranges, late)
        names = names.unionByName(late.select("fam", "plen", "lo", "prefix", "hi"))
    if fill:
        ranges = fill_known_gaps(ranges)
    named = names.groupBy("fam", "plen", "lo").agg(F.first("prefix", True).alias("prefix"), F.first("hi", True).alias("hi"))
    return nest(ranges).join(named, ["fam", "plen", "lo"])


def failed_files(spark: SparkSession, store: str) -> list[str]:
    """Files that could not be applied yet."""
    return json.loads(read_text(spark, f"{store}/FAILED")) if exists(spark, f"{store}/FAILED") else []


def apply_files(
    spark: SparkSession,
    fresh: list[str],
    store: str,
    backup_to: str | None = None,
    heartbeat: Callable[[], None] | None = None,
    glob: str = "roas.csv*",
) -> bool:
    """Load, append, fill, publish; then back up and report. Files that failed before are tried again with new ones.

    Each file is parsed once, into a table beside the store. All files count as failed until the new snapshot stands, so
    none is lost whatever ends the work; an error is logged. A failed backup keeps the published snapshot.
    """
    with _ONE_AT_A_TIME:
        known = set(fresh)
        late = [p for p in failed_files(spark, store) if p not in known and exists(spark, p)]
        if not fresh and not late:
            return True
        swap_text(spark, f"{store}/FAILED", json.dumps(sorted([*fresh, *late])))
        staged = f"{store}/_staging/{uuid.uuid4().hex}"
        try:
            parse_dumps(spark, [*fresh, *late], glob).write.parquet(staged)
            parsed = spark.read.parquet(staged)
            bad = parsed.where("error is not null").groupBy("path").agg(F.min("error").alias("error")).collect()
            for r in bad:
                log.warning("skipped %s: %s", r["path"], r["error"])
            if len(bad) == len(late) and not fresh:
                return True  # nothing new came right
            good = good_rows(parsed, keep_path=True)
            was = F.col("path").isin(late) if late else F.lit(False)
            history = open_store(spark, store) if exists(spark, f"{store}/CURRENT") else None
            publish(update_history(history, good.where(~was).drop("path"), late=good.where(was).drop("path") if late else None), store)
            swap_text(spark, f"{store}/FAILED", json.dumps(sorted(r["path"] for r in bad)))
        except Exception:
            log.exception("an update of %d files failed; they will be tried again", len(fresh) + len(late))
            return False
        finally:
            delete(spark, staged)
    if backup_to is not None:
        try:
            export_jsonl(open_store(spark, store), backup_to)
        except Exception:
            log.exception("backup to %s failed", backup_to)
            return True
        if heartbeat is not None:
            try:
                heartbeat()
            except Exception:
                log.exception("heartbeat failed")
    return True


def start(
    spark: SparkSession,
    base: str,
    store: str,
    checkpoint: str,
    interval: str | None = None,
    backup_to: str | None = None,
    heartbeat: Callable[[], None] | None = None,
    glob: str = "roas.csv*",
) -> StreamingQuery:
    """Watch ``base`` for new dump files; ``interval`` such as '28800 seconds', or once over what is there."""
    apply_files(spark, [], store, backup_to, heartbeat, glob)
    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(base)
        .select("path")
    )

    def on_batch(batch: DataFrame, _: int) -> None:
        paths = [r[0] for r in batch.collect()]  # names of one batch's new files
        apply_files(batch.sparkSession, paths, store, backup_to, heartbeat, glob)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def watch(stop: threading.Event, seconds: float, spark: SparkSession, base: str, store: str, checkpoint: str, **options) -> None:
    """Keep the stream running until ``stop``: one that ended is logged and started anew, failed files are tried again."""
    query = None
    while True:
        try:
            if query is None or not query.isActive:
                if query is not None:
                    log.error("updates ended and start again: %s", query.exception())
                query = start(spark, base, store, checkpoint, f"{seconds} seconds", **options)
            else:
                apply_files(spark, [], store, **options)
        except Exception:
            log.exception("updates could not start; next try in %s seconds", seconds)
        if stop.wait(seconds):
            break
    if query is not None and query.isActive:
        query.stop()


def observations_from_rows(rows: DataFrame) -> DataFrame:
    """Plain observation rows (tal, prefix, max_len, asn, date) with prefix keys, bad prefixes left out."""
    return with_prefix_key(rows).where(F.col("prefix").isNotNull())
