"""Named queries over the driver tables and, for each that SQL can express, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake import model
from originlake.functions.dates import date_to_epoch, epoch_to_date, in_bounds
from originlake.functions.prefix import address_number, strip_as, v4_text, with_prefix_key
from originlake.operators import history as H
from originlake.operators import index as I
from originlake.operators import query as Q
from originlake.plans.recipe import SQL_OBS, announcements, flat, history, latest, observations, plain, scratch, sql_gaps, sql_obs
from originlake.sources import dumps, jsonl, store
from originlake.sources.jsonl import jsonl_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HIST = SQL_OBS + sql_gaps(model.KNOWN_GAPS)
SQL6_OBS = sql_obs(6)
HIST6 = SQL6_OBS + sql_gaps(model.KNOWN_GAPS, 6)
COLS = "lo, plen, max_len, origin"
FLAT = f"{COLS}, s AS range_start, e AS range_end"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(*plain(), F.col("start").alias("range_start"), F.col("end").alias("range_end"))


def _obs(spark, d):
    return observations(spark, d).withColumnRenamed("asn", "origin")


@query("tal_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in model.TAL_URLS.items()) + ") t(tal, url)")
def _(spark, d):
    return model.tal_catalog(spark)


@query("known_gaps", "SELECT gs AS gap_start, ge AS gap_end FROM (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in model.KNOWN_GAPS) + ") t(gs, ge)")
def _(spark, d):
    return model.known_gaps(spark)


@query("obs_dedup", SQL_OBS + f"SELECT tal, {COLS}, date FROM obs")
def _(spark, d):
    return H.observations_dedup(_obs(spark, d)).select("tal", *plain(), "date")


@query(
    "obs_date_bounds",
    SQL_OBS + f"SELECT tal, {COLS}, date FROM obs WHERE date BETWEEN DATE '2021-08-05' AND DATE '2021-08-20'",
)
def _(spark, d):
    import datetime as dt

    rows = _obs(spark, d).where(in_bounds(F.col("date"), dt.date(2021, 8, 5), dt.date(2021, 8, 20)))
    return H.observations_dedup(rows).select("tal", *plain(), "date")


@query(
    "csv_fields",
    SQL_OBS + "SELECT DISTINCT lo, plen, CASE WHEN origin % 2 = 0 THEN max_len ELSE plen END AS max_len, origin FROM obs",
)
def _(spark, d):
    """Positional text fields as in a dump: AS marks stripped, maximum length falling back to the prefix length."""
    o = _obs(spark, d)
    text = o.select(
        F.concat_ws(
            ",",
            F.lit("rsync://x"),
            F.concat(F.lit("AS"), "origin"),
            "prefix",
            F.when(F.col("origin") % 2 == 0, F.col("max_len").cast("string")).otherwise("none"),
        ).alias("line")
    ).distinct()
    f = F.split("line", ",")
    rows = with_prefix_key(text.select(strip_as(f[1]).alias("origin"), f[2].alias("prefix"), f[3].alias("m")))
    return rows.withColumn("max_len", F.coalesce(F.col("m").try_cast("int"), F.col("plen").cast("int"))).select(*plain()).distinct()


@query("date_islands", SQL_OBS + f"SELECT {FLAT} FROM isl")
def _(spark, d):
    return _bounds(H.date_islands(observations(spark, d)))


@query("fill_known_gaps", HIST + f"SELECT {FLAT} FROM hist")
def _(spark, d):
    return _bounds(H.fill_known_gaps(H.date_islands(observations(spark, d))))


@query(
    "incremental_append",
    SQL_OBS.replace("isl AS (", "isl0 AS (")
    + """, base AS (SELECT * FROM days WHERE day % 2 = 0)""".replace("day % 2 = 0", "day <= DATE '2021-08-20' AND origin <> 64513")
    + """, ends AS (SELECT lo, plen, max_len, origin, max(day) AS last FROM base GROUP BY ALL),
    fresh AS (SELECT d.* FROM days d LEFT JOIN ends n USING (lo, plen, max_len, origin) WHERE n.last IS NULL OR d.day > n.last),
    used AS (SELECT * FROM base UNION SELECT * FROM fresh)
    SELECT lo, plen, max_len, origin, min(day) AS range_start, max(day) AS range_end
    FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day) AS INTEGER) AS g FROM used)
    GROUP BY lo, plen, max_len, origin, g""",
)
def _(spark, d):
    o = observations(spark, d)
    base = H.date_islands(o.where((F.col("date") <= F.lit("2021-08-20").cast("date")) & (F.col("asn") != 64513)))
    return _bounds(H.append_days(base, o))


@query(
    "rebuild_merge",
    SQL_OBS
    + """, odd AS (SELECT * FROM days WHERE day(day) % 2 = 1), rest AS (SELECT * FROM days WHERE day(day) % 2 = 0),
    every AS (SELECT * FROM odd UNION SELECT * FROM rest),
    step AS (SELECT *, CASE WHEN lag(day) OVER k = day - 1 THEN 0 ELSE 1 END AS n FROM every WINDOW k AS (PARTITION BY lo, plen, max_len, origin ORDER BY day)),
    run AS (SELECT *, sum(n) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day) AS r FROM step)
    SELECT lo, plen, max_len, origin, min(day) AS range_start, max(day) AS range_end FROM run GROUP BY lo, plen, max_len, origin, r""",
)
def _(spark, d):
    o = observations(spark, d)
    odd = F.dayofmonth("date") % 2 == 1
    return _bounds(H.rebuild_merge(H.date_islands(o.where(odd)), o.where(~odd)))


@query(
    "merge_duplicates",
    SQL_OBS
    + """, parts AS (SELECT lo, plen, max_len, origin, s, e FROM isl UNION ALL SELECT lo, plen, max_len, origin, s, e FROM isl
      UNION ALL SELECT lo, plen, max_len, origin, s, greatest(s, e - 1) FROM isl),
    reach AS (SELECT *, max(e) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM parts),
    run AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r FROM reach)
    SELECT lo, plen, max_len, origin, min(s) AS range_start, max(e) AS range_end FROM run GROUP BY lo, plen, max_len, origin, r""",
)
def _(spark, d):
    """Overlapping and repeated ranges of one key, as duplicate transport records hold them, united."""
    isl = H.date_islands(observations(spark, d))
    parts = isl.unionByName(isl).unionByName(isl.withColumn("end", F.greatest("start", F.date_sub("end", 1))))
    return _bounds(H.union_ranges(parts))


@query(
    "split_overlaps",
    SQL_OBS
    + """, twice AS (SELECT lo, plen, max_len, origin, day, 0 AS n FROM days UNION ALL SELECT lo, plen, max_len, origin, day, 1 FROM days WHERE origin = 64512),
    lagd AS (SELECT *, lag(day) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day, n) AS p FROM twice),
    r AS (SELECT *, sum(CASE WHEN day = p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day, n ROWS UNBOUNDED PRECEDING) AS run FROM lagd)
    SELECT lo, plen, max_len, origin, min(day) AS range_start, max(day) AS range_end FROM r GROUP BY lo, plen, max_len, origin, run""",
)
def _(spark, d):
    isl = H.date_islands(observations(spark, d))
    return _bounds(H.split_ranges(isl.unionByName(isl.where("origin = 64512"))))


#: Gap filling told by days: those of a listed gap join a key's days where the days before and after it are there.
FILLED = (
    SQL_OBS
    + ", gaps(gs, ge) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in model.KNOWN_GAPS) + "),"
    + """next AS (SELECT *, lead(day) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day) AS then FROM days),
    more AS (SELECT n.lo, n.plen, n.max_len, n.origin, CAST(unnest(generate_series(g.gs, g.ge, INTERVAL 1 DAY)) AS DATE) AS day
      FROM next n JOIN gaps g ON g.gs = n.day + 1 AND g.ge = n.then - 1),
    every AS (SELECT lo, plen, max_len, origin, day FROM days UNION SELECT * FROM more),
    step AS (SELECT *, CASE WHEN lag(day) OVER k = day - 1 THEN 0 ELSE 1 END AS n FROM every WINDOW k AS (PARTITION BY lo, plen, max_len, origin ORDER BY day)),
    run AS (SELECT *, sum(n) OVER (PARTITION BY lo, plen, max_len, origin ORDER BY day) AS r FROM step),
    filled AS (SELECT lo, plen, max_len, origin, min(day) AS s, max(day) AS e FROM run GROUP BY lo, plen, max_len, origin, r)
    """
)


@query("latest_date", SQL_OBS + "SELECT max(day) AS latest_date FROM days")
def _(spark, d):
    return H.latest_date(history(spark, d))


@query("counts_prefixes", SQL_OBS + "SELECT CAST(4 AS INTEGER) AS fam, count(*) AS prefixes FROM (SELECT DISTINCT lo, plen FROM days)")
def _(spark, d):
    return H.counts(history(spark, d)).select(F.col("fam").cast("int").alias("fam"), "prefixes")


@query("counts_records", SQL_OBS + "SELECT CAST(4 AS INTEGER) AS fam, count(*) AS records FROM (SELECT DISTINCT lo, plen, max_len, origin FROM days)")
def _(spark, d):
    return H.counts(history(spark, d)).select(F.col("fam").cast("int").alias("fam"), "records")


def _search(name: str, where: str, **filters) -> None:
    keys = f"SELECT lo, plen, max_len, origin FROM hist, top GROUP BY lo, plen, max_len, origin HAVING {where}"
    sql = HIST + f"SELECT {FLAT} FROM hist WHERE (lo, plen, max_len, origin) IN ({keys})"
    day = (lambda spark, d: {"latest": latest(spark, d)}) if "current" in filters else lambda spark, d: {}
    query(name, sql)(lambda spark, d: flat(Q.search(history(spark, d), **filters, **day(spark, d))))


_search("search_all", "true")
_search("search_asn", "origin = 64513", asn=64513)
_search("search_max_len", "max_len = 20", max_len=20)
_search("search_on_date", "bool_or(s <= DATE '2021-08-07' AND e >= DATE '2021-08-07')", date="2021-08-07")
_search("search_current", "max(e) >= max(latest)", current=True)
_search("search_expired", "max(e) < max(latest)", current=False)
_search("search_current_ignores_date", "max(e) >= max(latest)", current=True, date="1999-01-01")
_search(
    "search_combined",
    "origin = 64512 AND max_len = 16 AND bool_or(s <= DATE '2021-08-15' AND e >= DATE '2021-08-15')",
    asn=64512,
    max_len=16,
    date="2021-08-15",
)
_search("search_prefix_exact", "lo = 16777216 + 0 AND plen = 8", prefix="1.0.0.0/8")
_search("search_prefix_subtree", "lo BETWEEN 16777216 AND 33554431", prefix="1.16.0.0/16", exact=False)
_search("lookup_prefix", "lo BETWEEN 33554432 AND 50331647", prefix="2.0.0.0/8", exact=False)
_search("no_cover_empty", "false", prefix="0.0.0.0/1", exact=False)
_search(
    "search_related",
    "(lo <= 18284544 AND hi_max >= 18350079) OR (lo >= 18284544 AND hi_max <= 18350079)".replace("hi_max", "max(hi)"),
    prefix="1.23.0.0/16",
    exact=False,
    mode="related",
)


@query("search_page", HIST + f"SELECT {COLS} FROM (SELECT DISTINCT {COLS} FROM hist) ORDER BY lo, plen, origin, max_len LIMIT 50 OFFSET 100")
def _(spark, d):
    return Q.page(Q.search(history(spark, d)), 2, 50).select(*plain())


@query("search_total", HIST + "SELECT count(*) AS total FROM (SELECT DISTINCT lo, plen, max_len, origin FROM hist WHERE origin = 64514)")
def _(spark, d):
    return Q.search(history(spark, d), asn=64514).agg(F.count(F.lit(1)).alias("total"))


_TEXT = "concat_ws('.', CAST(lo // 16777216 AS VARCHAR), CAST(lo // 65536 % 256 AS VARCHAR), CAST(lo // 256 % 256 AS VARCHAR), CAST(lo % 256 AS VARCHAR)) || '/' || CAST(plen AS VARCHAR)"


@query(
    "api_rows",
    HIST
    + f"SELECT {_TEXT} AS prefix, max_len, origin AS asn, string_agg(CAST(s AS VARCHAR) || '..' || CAST(e AS VARCHAR), ' ' ORDER BY s) AS date_ranges, max(e) >= max(latest) AS current FROM hist, top GROUP BY {COLS}",
)
def _(spark, d):
    h = history(spark, d)
    rows = Q.api_rows(Q.search(h).withColumn("_l", H.latest_date(h).scalar()), F.col("_l"))
    return rows.withColumn("date_ranges", F.concat_ws(" ", F.transform("date_ranges", lambda r: F.concat_ws("..", r))))


@query(
    "display_rows",
    HIST
    + f"SELECT origin, {_TEXT} AS prefix, max_len, string_agg('(' || CAST(s AS VARCHAR) || ',' || CAST(e AS VARCHAR) || ')', ', ' ORDER BY s) AS dates_ranges FROM hist GROUP BY {COLS}",
)
def _(spark, d):
    return Q.display_rows(history(spark, d))


@query(
    "jsonl_lines",
    HIST
    + f"""SELECT '{{"p":"' || {_TEXT} || '","m":' || CAST(max_len AS VARCHAR) || ',"o":' || CAST(origin AS VARCHAR) || ',"r":[' ||
    string_agg('[' || CAST((s - DATE '1970-01-01') * 86400 AS VARCHAR) || ',' || CAST((e - DATE '1970-01-01') * 86400 AS VARCHAR) || ']', ',' ORDER BY s) || ']}}' AS value FROM hist GROUP BY {COLS}""",
)
def _(spark, d):
    return jsonl_lines(history(spark, d))


@query("fix_transport", FILLED + f"SELECT {FLAT} FROM filled")
def _(spark, d):
    return flat(H.fix_history(H.build_history(observations(spark, d))))


@query("prefix_roots", HIST + "SELECT lo, plen, r_lo AS root_lo, CAST(r_plen AS INTEGER) AS root_plen FROM rooted")
def _(spark, d):
    r = I.prefix_roots(history(spark, d))
    return r.select(
        address_number(F.col("lo")).alias("lo"),
        F.col("plen").cast("int").alias("plen"),
        address_number(F.col("root_lo")).alias("root_lo"),
        F.col("root_plen").cast("int").alias("root_plen"),
    )


def _prefixes(spark, d, fam=4):
    """Stored prefixes, with their numbers: made once for each, not for each pair."""
    rows = history(spark, d, fam).select("fam", "plen", "lo", "root").distinct()
    return rows.withColumn("_a", address_number(F.col("lo"))).withColumn("_p", F.col("plen").cast("int"))


def _numbered(pairs):
    return pairs.select("qid", F.col("_a").alias("lo"), F.col("_p").alias("plen"))


@query(
    "subtree_match",
    HIST + "SELECT c.qid, w.lo, w.plen FROM cover c JOIN rooted w ON w.r_lo = c.r_lo AND w.r_plen = c.r_plen",
)
def _(spark, d):
    return _numbered(I.subtree_match(announcements(spark, d), _prefixes(spark, d), cols=["_a", "_p"]))


@query(
    "related_match",
    HIST + "SELECT a.qid, p.lo, p.plen FROM ask a JOIN pfx p ON (p.lo <= a.qlo AND p.hi >= a.qhi) OR (p.lo >= a.qlo AND p.hi <= a.qhi)",
)
def _(spark, d):
    return _numbered(I.related_match(announcements(spark, d), _prefixes(spark, d), cols=["_a", "_p"]))


_VALIDATE = """SELECT a.qid, a.qasn AS asn, CASE WHEN v.qid IS NOT NULL THEN 'valid' WHEN c.qid IS NOT NULL THEN 'invalid' ELSE 'unknown' END AS result
FROM ask a LEFT JOIN cover c ON c.qid = a.qid LEFT JOIN (
  SELECT DISTINCT a.qid FROM ask a JOIN cover c ON c.qid = a.qid JOIN rooted w ON w.r_lo = c.r_lo AND w.r_plen = c.r_plen
  JOIN hist h ON h.lo = w.lo AND h.plen = w.plen
  WHERE h.origin = a.qasn AND h.max_len >= a.qplen AND h.s <= DATE '{day}' AND h.e >= DATE '{day}') v ON v.qid = a.qid"""


@query("validate_bulk", HIST + _VALIDATE.format(day="2021-08-15"))
def _(spark, d):
    return Q.validate_bulk(announcements(spark, d), history(spark, d)).select("qid", "asn", "result")


@query("validate_at_date", HIST + _VALIDATE.format(day="1999-01-01"))
def _(spark, d):
    asked = announcements(spark, d).withColumn("date", F.lit("1999-01-01").cast("date"))
    return Q.validate_bulk(asked, history(spark, d)).select("qid", "asn", "result")


@query(
    "validate_rfc6811",
    HIST
    + """SELECT a.qid, a.qasn AS asn, CASE WHEN max(CASE WHEN h.origin = a.qasn AND h.max_len >= a.qplen THEN 1 ELSE 0 END) = 1 THEN 'valid'
    WHEN count(h.lo) > 0 THEN 'invalid' ELSE 'unknown' END AS result FROM ask a
    LEFT JOIN hist h ON h.lo <= a.qlo AND h.hi >= a.qhi AND h.s <= DATE '2021-08-15' AND h.e >= DATE '2021-08-15' GROUP BY a.qid, a.qasn""",
)
def _(spark, d):
    return Q.validate_bulk(announcements(spark, d), history(spark, d), "rfc6811").select("qid", "asn", "result")


@query(
    "prefix_parse",
    SQL_OBS + f"SELECT DISTINCT {_TEXT} AS prefix, CAST(4 AS INTEGER) AS fam, plen, lo, hi FROM days",
)
def _(spark, d):
    """Text with host bits set, parsed to its canonical form."""
    t = observations(spark, d).select(v4_text(F.col("hi"), F.col("plen")).alias("prefix")).distinct()
    return with_prefix_key(t).select(
        "prefix",
        F.col("fam").cast("int").alias("fam"),
        F.col("plen").cast("int").alias("plen"),
        address_number(F.col("lo")).alias("lo"),
        address_number(F.col("hi")).alias("hi"),
    )


@query("epoch_dates", SQL_OBS + "SELECT DISTINCT CAST((day - DATE '1970-01-01') * 86400 AS BIGINT) AS epoch, day FROM days")
def _(spark, d):
    e = observations(spark, d).select(date_to_epoch(F.col("date")).alias("epoch")).distinct()
    return e.withColumn("day", epoch_to_date(F.col("epoch")))


# Both families, and IPv6 by itself; its addresses are given by their upper halves.


@query("obs6_islands", SQL6_OBS + f"SELECT {FLAT} FROM isl")
def _(spark, d):
    return _bounds(H.date_islands(observations(spark, d, 6)))


def _search6(name: str, where: str, **filters) -> None:
    keys = f"SELECT lo, plen, max_len, origin FROM hist, top GROUP BY lo, plen, max_len, origin HAVING {where}"
    sql = HIST6 + f"SELECT {FLAT} FROM hist WHERE (lo, plen, max_len, origin) IN ({keys})"
    query(name, sql)(lambda spark, d: flat(Q.search(history(spark, d, 6), **filters)))


_FIRST6 = int("20010db000000000", 16)
_search6("search6_all", "true")
_search6("search6_exact", f"lo = {int("20010d0000000000", 16)} AND plen = 24", prefix="2001:d00::/24")
_search6("search6_on_date", "bool_or(s <= DATE '2021-08-07' AND e >= DATE '2021-08-07')", date="2021-08-07")
_search6(
    "search6_subtree",
    f"(lo, plen) IN (SELECT w.lo, w.plen FROM rooted w JOIN rooted v USING (r_lo, r_plen) WHERE v.lo <= {_FIRST6 + (1 << 36)} AND v.lo + (CAST(1 AS BIGINT) << (64 - v.plen)) > {_FIRST6 + (1 << 36)} AND v.plen <= 48)",
    prefix="2001:db0:10::/48",
    exact=False,
)


@query("prefix_roots6", HIST6 + "SELECT lo, plen, r_lo AS root_lo, CAST(r_plen AS INTEGER) AS root_plen FROM rooted")
def _(spark, d):
    r = I.prefix_roots(history(spark, d, 6))
    return r.select(
        address_number(F.col("lo")).alias("lo"),
        F.col("plen").cast("int").alias("plen"),
        address_number(F.col("root_lo")).alias("root_lo"),
        F.col("root_plen").cast("int").alias("root_plen"),
    )


@query("subtree_match6", HIST6 + "SELECT c.qid, w.lo, w.plen FROM cover c JOIN rooted w ON w.r_lo = c.r_lo AND w.r_plen = c.r_plen")
def _(spark, d):
    return _numbered(I.subtree_match(announcements(spark, d, 6), _prefixes(spark, d, 6), cols=["_a", "_p"]))


@query("validate6_bulk", HIST6 + _VALIDATE.format(day="2021-08-15"))
def _(spark, d):
    return Q.validate_bulk(announcements(spark, d, 6), history(spark, d, 6)).select("qid", "asn", "result")


_BOTH = "SELECT {x} FROM (" + SQL_OBS + "SELECT {y} FROM days) UNION ALL SELECT {z} FROM (" + SQL6_OBS + "SELECT {y} FROM days)"


@query(
    "counts_both_families",
    _BOTH.format(
        x="CAST(4 AS INTEGER) AS fam, prefixes, records",
        y="count(DISTINCT (lo, plen)) AS prefixes, count(DISTINCT (lo, plen, max_len, origin)) AS records",
        z="CAST(6 AS INTEGER), prefixes, records",
    ),
)
def _(spark, d):
    both = history(spark, d).unionByName(history(spark, d, 6))
    return H.counts(both).select(F.col("fam").cast("int").alias("fam"), "prefixes", "records")


@query(
    "validate_mixed",
    f"SELECT qid, asn, result FROM ({HIST + _VALIDATE.format(day='2021-08-15')}) UNION ALL SELECT -qid, asn, result FROM ({HIST6 + _VALIDATE.format(day='2021-08-15')})",
)
def _(spark, d):
    """Announcements of both families against one store of both."""
    asked = announcements(spark, d).unionByName(announcements(spark, d, 6).withColumn("qid", -F.col("qid")))
    return Q.validate_bulk(asked, history(spark, d).unionByName(history(spark, d, 6))).select("qid", "asn", "result")


# Import, dumps and the store: what is written is read back.


@query("jsonl_roundtrip", FILLED + f"SELECT {FLAT} FROM filled")
def _(spark, d):
    """History written as compressed transport and read again."""
    path = scratch(spark)
    jsonl.export_jsonl(history(spark, d), path)
    return flat(jsonl.read_jsonl(spark, path))


@query(
    "jsonl_import",
    FILLED + """, r AS (SELECT lo, plen, max_len, origin, s, e FROM filled)
    SELECT lo, plen, max_len, origin, s AS range_start, e AS range_end FROM r
    UNION ALL SELECT DISTINCT lo, plen, max_len, CAST(0 AS BIGINT), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM r WHERE origin = 64513""",
)
def _(spark, d):
    """Transport with blank lines, repeated and overlapping records, and records without ranges."""
    path = scratch(spark)
    lines = jsonl.jsonl_lines(history(spark, d))
    none = jsonl.jsonl_lines(history(spark, d).where("origin = 64513").withColumn("origin", F.lit(0).cast("bigint")).withColumn("ranges", F.expr("filter(ranges, r -> false)")))
    lines.unionByName(lines.where("value like '%\"o\":64512%'")).unionByName(none).select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(path)
    rows = jsonl.read_jsonl(spark, path)
    bare = rows.where(F.size("ranges") == 0).select(*plain(), F.lit(None).cast("date").alias("range_start"), F.lit(None).cast("date").alias("range_end"))
    return flat(rows).unionByName(bare)


def _files(spark, d):
    """A dump file for each trust anchor and day, those of the 13th with a bad line."""
    o = observations(spark, d)
    lines = o.select("tal", "date", F.concat_ws(",", F.lit("rsync://x"), F.concat(F.lit("AS"), "asn"), "prefix", "max_len", F.lit("y")).alias("line"))
    bad = lines.where("day(date) = 13").select("tal", "date", F.lit("rsync://x,ASx,1.0.0.0/8,8,y").alias("line"))
    files = lines.unionByName(bad).groupBy("tal", "date").agg(F.concat_ws("\n", F.lit("URI,ASN,IP Prefix,Max Length,Not Before"), F.collect_list("line")).alias("text"))
    path = F.concat(F.lit("s/"), "tal", F.lit(".tal/"), F.date_format("date", "yyyy/MM/dd"), F.lit("/roas.csv"))
    return files.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("dump_parse", SQL_OBS + f"SELECT tal, {COLS}, date FROM obs WHERE day(date) <> 13")
def _(spark, d):
    rows = dumps.good_rows(dumps.parse_contents(_files(spark, d)))
    return rows.withColumnRenamed("asn", "origin").select("tal", *plain(), "date")


@query("dump_errors", SQL_OBS + "SELECT DISTINCT tal, date, 'bad asn' AS error FROM obs WHERE day(date) = 13")
def _(spark, d):
    return dumps.parse_contents(_files(spark, d)).where("error is not null").select("tal", "date", "error").distinct()


@query("store_meta", "SELECT CAST(2 AS INTEGER) AS format_version, (SELECT max(latest) FROM (" + HIST + "SELECT latest FROM top)) AS latest_date, v4_prefixes, v4_records FROM ("
       + SQL_OBS + "SELECT count(DISTINCT (lo, plen)) AS v4_prefixes, count(DISTINCT (lo, plen, max_len, origin)) AS v4_records FROM days)")
def _(spark, d):
    """A second snapshot of the store, opened by its pointer."""
    path = scratch(spark)
    store.publish(history(spark, d).where("origin = 64512"), path)
    store.publish(history(spark, d), path)
    meta = store.store_meta(spark, path)
    return spark.createDataFrame([tuple(meta[k] for k in ("format_version", "latest_date", "v4_prefixes", "v4_records"))], "format_version int, latest_date date, v4_prefixes bigint, v4_records bigint")


@query("insert_records", HIST + f"SELECT {FLAT} FROM hist UNION ALL SELECT lo, plen, max_len, CAST(1 AS BIGINT), s, e FROM hist WHERE origin = 64514")
def _(spark, d):
    h = history(spark, d)
    return flat(H.insert_records(h, h.where("origin >= 64514").withColumn("origin", F.when(F.col("origin") == 64514, F.lit(1).cast("bigint")).otherwise(F.col("origin")))))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Current records of one origin, first page: dedup, compression, gap filling, filters, order, paging."""
    return Q.page(Q.search(history(spark, d), asn=64512, current=True)).select("prefix", *plain())
