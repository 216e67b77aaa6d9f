"""Observations and queries derived from the driver tables by integer arithmetic.

The SQL text and the DataFrames below give identical rows in both engines.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.functions.prefix import address_number, v4_key, v4_text, v6_key, v6_text
from originlake.operators.history import build_history, latest_date, unnest
from originlake.operators.index import with_roots
from originlake.sources.store import exists, open_store, publish, store_meta

TALS = ["afrinic", "apnic", "arin", "lacnic", "ripencc"]
SHIFT_DAYS = 883
VALIDATE_DATE = "2021-08-15"
#: Upper half of 2001:db0::, below which the IPv6 rows lie.
V6_BASE = 0x20010DB000000000


def observations(spark: SparkSession, sf_dir: str, fam: int = 4) -> DataFrame:
    """roa_obs from ``events``: tal, prefix, fam, plen, lo, hi, max_len, asn, date."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type")
    u = F.col("user_id")
    spread = (u * 40503) % 65536
    if fam == 4:
        plen, bits = 8 + u % 17, 32
        key = v4_key((u % 6 + 1) * 16777216 + spread * 256, plen)
    else:
        plen, bits = 24 + u % 33, 128
        key = v6_key(V6_BASE + (u % 6) * (1 << 36) + spread * (1 << 20), plen)
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
    keyed = ev.select(
        F.element_at(F.array(*map(F.lit, TALS)), (u % 5 + 1).cast("int")).alias("tal"),
        *key,
        F.least(F.lit(bits), plen + u % 3).cast("int").alias("max_len"),
        (64512 + kind.when(F.col("event_type") == "error", 2).otherwise(3)).cast("bigint").alias("asn"),
        F.date_sub(F.col("ts").cast("date"), SHIFT_DAYS).alias("date"),
    )
    return keyed.withColumn("prefix", (v4_text if fam == 4 else v6_text)(F.col("lo"), F.col("plen")))


def _folder(spark: SparkSession) -> str | None:
    """A folder for stores that all executors see: spark.checkpoint.dir, or in one process a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="originlake-")
    return folder


def scratch(spark: SparkSession) -> str:
    """A path for what a query writes and reads back."""
    folder = _folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/scratch/{uuid.uuid4().hex}"


#: Stores made in this process, by application, tables and family.
_STORES: dict[tuple[str, str, int], str] = {}


def history(spark: SparkSession, sf_dir: str, fam: int = 4) -> DataFrame:
    """Nested, gap-filled history rows with roots: of a store that the first query publishes and later ones open."""
    key = (spark.sparkContext.applicationId, sf_dir, fam)
    if key not in _STORES or not exists(spark, f"{_STORES[key]}/CURRENT"):
        built = build_history(observations(spark, sf_dir, fam), fill=True)
        folder = _folder(spark)
        if folder is None:
            return with_roots(built)
        path = f"{folder.rstrip('/')}/stores/{uuid.uuid4().hex}"
        publish(built, path)
        _STORES[key] = path
    return open_store(spark, _STORES[key])


def latest(spark: SparkSession, sf_dir: str) -> dt.date:
    """Latest date of the published history, from its metadata."""
    rows = history(spark, sf_dir)
    path = _STORES.get((spark.sparkContext.applicationId, sf_dir, 4))
    return store_meta(spark, path)["latest_date"] if path else latest_date(rows).first()[0]


def announcements(spark: SparkSession, sf_dir: str, fam: int = 4) -> DataFrame:
    """Queries from ``customer``: qid, fam, plen, lo, hi, asn, date."""
    c = F.col("c_custkey")
    spread = (c * 30011) % 65536
    if fam == 4:
        key = v4_key((c % 8 + 1) * 16777216 + spread * 256, 6 + c % 20)
    else:
        key = v6_key(V6_BASE + (c % 8) * (1 << 36) + spread * (1 << 20), 22 + c % 40)
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return cu.select(c.alias("qid"), *key, (64512 + c % 5).alias("asn"), F.lit(VALIDATE_DATE).cast("date").alias("date"))


def flat(rows: DataFrame, *more: Column | str) -> DataFrame:
    """One row a range with plain columns, as the SQL twins return them."""
    return unnest(rows).select(*more, *plain(), F.col("start").alias("range_start"), F.col("end").alias("range_end"))


def plain() -> list[Column]:
    return [
        address_number(F.col("lo")).alias("lo"),
        F.col("plen").cast("int").alias("plen"),
        F.col("max_len").cast("int").alias("max_len"),
        F.col("origin").cast("bigint").alias("origin"),
    ]


def _sql_key(bits: int, plen: str, addr: str) -> str:
    block = f"(CAST(1 AS BIGINT) << CAST({bits} - {plen} AS BIGINT))"
    lo = f"({addr} - {addr} % {block})"
    return f"CAST({lo} AS BIGINT) AS {{0}}lo, CAST({lo} + {block} - 1 AS BIGINT) AS {{0}}hi"


def sql_obs(fam: int = 4) -> str:
    """The same observations for DuckDB, to be followed by a SELECT; addresses of IPv6 are their upper halves."""
    if fam == 4:
        bits, most, plen, addr = 32, 32, "8 + user_id % 17", "(user_id % 6 + 1) * 16777216 + ((user_id * 40503) % 65536) * 256"
    else:
        bits, most, plen = 64, 128, "24 + user_id % 33"
        addr = f"{V6_BASE} + (user_id % 6) * {1 << 36} + ((user_id * 40503) % 65536) * {1 << 20}"
    return f"""
WITH e AS (
  SELECT CAST(ts AS DATE) - CAST({SHIFT_DAYS} AS INTEGER) AS date, user_id AS u, {plen} AS plen,
    CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS k,
    CAST({addr} AS BIGINT) AS addr
  FROM events),
obs AS (
  SELECT DISTINCT CASE u % 5 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TALS))} END AS tal,
    {_sql_key(bits, "plen", "addr").format("")},
    CAST(plen AS INTEGER) AS plen, CAST(least({most}, plen + u % 3) AS INTEGER) AS max_len,
    CAST(64512 + k AS BIGINT) AS origin, date
  FROM e),
days AS (SELECT DISTINCT lo, hi, plen, max_len, origin, date AS day FROM obs),
isl AS (
  SELECT lo, hi, plen, max_len, origin, min(day) AS s, max(day) AS e
  FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day) AS INTEGER) AS g FROM days)
  GROUP BY lo, hi, plen, max_len, origin, g)
"""


SQL_OBS = sql_obs()


def sql_gaps(gaps, fam: int = 4) -> str:
    rows = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in gaps)
    if fam == 4:
        ask = "CAST(6 + c_custkey % 20 AS INTEGER) AS qplen, (c_custkey % 8 + 1) * 16777216 + ((c_custkey * 30011) % 65536) * 256 AS addr,"
    else:
        ask = f"CAST(22 + c_custkey % 40 AS INTEGER) AS qplen, {V6_BASE} + (c_custkey % 8) * {1 << 36} + ((c_custkey * 30011) % 65536) * {1 << 20} AS addr,"
    key = _sql_key(32 if fam == 4 else 64, "qplen", "addr").format("q")
    return f""",
gaps(gs, ge) AS (VALUES {rows}),
lagged AS (SELECT *, lag(e) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY s) AS prev FROM isl),
runs AS (
  SELECT l.*, sum(CASE WHEN g.gs IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY s) AS run
  FROM lagged l LEFT JOIN gaps g ON g.gs = l.prev + 1 AND g.ge = l.s - 1),
hist AS (
  SELECT lo, hi, plen, max_len, origin, min(s) AS s, max(e) AS e FROM runs GROUP BY lo, hi, plen, max_len, origin, run),
top AS (SELECT max(e) AS latest FROM hist),
pfx AS (SELECT DISTINCT lo, hi, plen FROM hist),
roots AS (
  SELECT p.lo, p.plen, min(a.plen) AS r_plen, max(a.hi) FILTER (WHERE true) AS any_hi
  FROM pfx p JOIN pfx a ON a.lo <= p.lo AND a.hi >= p.hi GROUP BY p.lo, p.plen),
rooted AS (
  SELECT r.lo, r.plen, a.lo AS r_lo, r.r_plen FROM roots r JOIN pfx p ON p.lo = r.lo AND p.plen = r.plen
  JOIN pfx a ON a.plen = r.r_plen AND a.lo <= p.lo AND a.hi >= p.hi),
ask0 AS (
  SELECT c_custkey AS qid, {ask} CAST(64512 + c_custkey % 5 AS BIGINT) AS qasn FROM customer),
ask AS (
  SELECT qid, qplen, qasn, {key} FROM ask0),
cover AS (
  SELECT DISTINCT a.qid, w.r_lo, w.r_plen FROM ask a JOIN pfx p ON p.lo <= a.qlo AND p.hi >= a.qhi
  JOIN rooted w ON w.lo = p.lo AND w.plen = p.plen)
"""


