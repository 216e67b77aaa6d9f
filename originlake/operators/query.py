"""Search, lookup, validation, paging and display over stored history."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlake.functions.dates import strict_date
from originlake.functions.prefix import parse_cidr
from originlake.model import ASN_MAX, EPOCH, FORMAT_VERSION, MAX_LEN_MAX, PAGE_SIZE_CAP, PAGE_SIZE_DEFAULT
from originlake.operators.history import active_on, counts, latest_date
from originlake.operators.index import cover_root

log = logging.getLogger(__name__)

#: Total order of results: IPv4 first, then address, length, origin and maximum length.
ORDER = ["fam", "lo", "plen", "origin", "max_len"]

#: Days whose validity is one BIGINT: a root and origin have as many such rows at most as maximum lengths.
SPAN_DAYS = 32


def parse_prefix(text: str):
    """(prefix, fam, plen, lo, hi) of query text; ValueError('invalid prefix') otherwise."""
    parsed = parse_cidr(text)
    if parsed is None:
        raise ValueError("invalid prefix")
    return parsed


def search(
    history: DataFrame,
    prefix: str | None = None,
    asn: int | None = None,
    max_len: int | None = None,
    date: str | dt.date | None = None,
    current: bool | None = None,
    exact: bool = True,
    mode: str = "subtree",
    latest: dt.date | None = None,
) -> DataFrame:
    """History rows that pass all given filters.

    exact: the stored prefix itself; otherwise its covering subtree (``mode``
    'related' gives true covering and covered prefixes). Without a prefix
    ``exact`` has no meaning. ``current`` overrides ``date``: True asks for rows
    active on the store's latest date, False for rows none of whose ranges
    reaches it, rows without ranges included. ``latest`` saves computing that date.
    """
    if asn is not None and not 0 <= asn <= ASN_MAX or max_len is not None and not 0 <= max_len <= MAX_LEN_MAX:
        raise ValueError("number out of range")
    rows = history
    if prefix is not None and exact:
        _, fam, plen, lo, _ = parse_prefix(prefix)
        rows = rows.where((F.col("fam") == fam) & (F.col("plen") == plen) & (F.col("lo") == F.lit(bytearray(lo))))
    elif prefix is not None:
        _, fam, plen, lo, hi = parse_prefix(prefix)
        first, last = F.lit(bytearray(lo)), F.lit(bytearray(hi))
        covering = (F.col("fam") == fam) & (F.col("lo") <= first) & (F.col("hi") >= last)
        if mode == "related":
            rows = rows.where(covering | ((F.col("fam") == fam) & (F.col("lo") >= first) & (F.col("hi") <= last)))
        else:  # all that cover it have the same root
            rows = rows.where(F.col("root") == history.where(covering).agg(F.max("root")).scalar())
    if asn is not None:
        rows = rows.where(F.col("origin") == asn)
    if max_len is not None:
        rows = rows.where(F.col("max_len") == max_len)
    if current is not None:
        day: Column = latest_date(history).scalar() if latest is None else F.lit(latest)
        rows = rows.withColumn("_latest", day)
        if current:
            rows = rows.where(active_on(F.col("_latest")))
        else:
            rows = rows.where(~F.exists("ranges", lambda r: r["end"] >= F.col("_latest")))
        rows = rows.drop("_latest")
    elif date is not None:
        rows = rows.where(active_on(F.lit(strict_date(date))))
    return rows


def lookup_prefix(history: DataFrame, prefix: str) -> DataFrame:
    """Every record in the subtree of the shortest stored prefix that covers this one."""
    return search(history, prefix=prefix, exact=False)


def page(rows: DataFrame, number: int = 0, size: int = PAGE_SIZE_DEFAULT) -> DataFrame:
    """One page in result order; sizes over 1000 are cut to that with a warning, 0 gives an empty page."""
    if size > PAGE_SIZE_CAP:
        log.warning("page size %d is over the maximum; using %d", size, PAGE_SIZE_CAP)
        size = PAGE_SIZE_CAP
    return rows.orderBy(*ORDER).offset(number * size).limit(size)


def api_rows(rows: DataFrame, latest: Column) -> DataFrame:
    """Rows as the search interface shows them: ISO dates and whether the record is current."""
    return rows.select(
        "prefix",
        "max_len",
        F.col("origin").alias("asn"),
        F.transform("ranges", lambda r: F.array(r["start"].cast("string"), r["end"].cast("string"))).alias("date_ranges"),
        F.exists("ranges", lambda r: r["end"] >= latest).alias("current"),
    )


def display_rows(rows: DataFrame) -> DataFrame:
    """Rows for a text table, ranges as ``(start,end), (start,end)``."""
    shown = F.transform("ranges", lambda r: F.format_string("(%s,%s)", r["start"].cast("string"), r["end"].cast("string")))
    return rows.select("origin", "prefix", "max_len", F.concat_ws(", ", shown).alias("dates_ranges"))


def validate_bulk(queries: DataFrame, history: DataFrame, mode: str = "subtree") -> DataFrame:
    """Queries (qid, fam, plen, lo, asn, date) with ``result`` valid, invalid or unknown.

    Valid: some record in the covering subtree has that origin, a maximum length
    of at least the query's length and a range on the date. Otherwise invalid if
    anything is stored there, at whatever date, else unknown. The subtree is never
    expanded, nor do queries meet records: records become, for each (root, origin,
    maximum length), the days of SPAN_DAYS on which one of them is active, and each
    asked day gets the greatest such length. ``mode`` 'rfc6811' counts covering
    records that are active on the date only.
    """
    if mode == "rfc6811":
        return _validate_rfc6811(queries, history)
    places = cover_root(queries.select("fam", "plen", "lo").distinct(), history)
    asked = queries.join(places, ["fam", "plen", "lo"], "left")
    days = asked.where(F.col("root").isNotNull() & F.col("date").isNotNull()).select("root", "asn", "date").distinct()
    keys = days.groupBy("root", "asn").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    span = lambda c: F.floor(F.unix_date(c) / SPAN_DAYS)
    day = lambda c, k: F.when(span(c) == F.col("_span"), F.pmod(F.unix_date(c), F.lit(SPAN_DAYS))).otherwise(k)
    stored = (
        history.select("root", F.col("origin").alias("asn"), F.col("max_len").alias("_ml"), "ranges")
        .join(keys, ["root", "asn"])
        .select("root", "asn", "_ml", "_from", "_to", F.explode("ranges").alias("_r"))
        .where((F.col("_r.start") <= F.col("_to")) & (F.col("_r.end") >= F.col("_from")) & (F.col("_r.start") <= F.col("_r.end")))
        .withColumn("_s", F.greatest("_r.start", "_from"))
        .withColumn("_e", F.least("_r.end", "_to"))
        .withColumn("_span", F.explode(F.sequence(span(F.col("_s")), span(F.col("_e")))))
        .withColumn("_a", day(F.col("_s"), 0))
        .withColumn("_b", day(F.col("_e"), SPAN_DAYS - 1))
        .groupBy("root", "asn", "_span", "_ml")
        .agg(F.bit_or(F.expr("shiftleft(1L, _b + 1) - shiftleft(1L, _a)")).alias("_days"))
    )
    best = (
        days.withColumn("_span", span(F.col("date")))
        .join(stored, ["root", "asn", "_span"])
        .where(F.expr(f"shiftright(_days, pmod(unix_date(date), {SPAN_DAYS})) & 1 = 1"))
        .groupBy("root", "asn", "date")
        .agg(F.max("_ml").alias("_best"))
    )
    return asked.join(best, ["root", "asn", "date"], "left").select(
        *queries.columns,
        F.when(F.col("_best") >= F.col("plen"), "valid").when(F.col("root").isNotNull(), "invalid").otherwise("unknown").alias("result"),
    )


def _validate_rfc6811(queries: DataFrame, history: DataFrame) -> DataFrame:
    from originlake.functions.prefix import with_ancestors

    stored = history.select(
        "fam",
        F.col("plen").cast("int").alias("s_plen"),
        F.col("lo").alias("s_lo"),
        "origin",
        F.col("max_len").alias("_ml"),
        "ranges",
    )
    hits = (
        with_ancestors(queries.select("qid", "fam", "plen", "lo", "asn", "date"), "s")
        .join(stored, ["fam", "s_plen", "s_lo"])
        .where(active_on(F.col("date")))
        .groupBy("qid")
        .agg(F.max((F.col("origin") == F.col("asn")) & (F.col("_ml") >= F.col("plen"))).alias("_ok"))
    )
    return (
        queries.join(hits, "qid", "left")
        .withColumn("result", F.when(F.col("_ok"), "valid").when(~F.col("_ok"), "invalid").otherwise("unknown"))
        .drop("_ok")
    )


def latest_of(history: DataFrame) -> dt.date:
    return latest_date(history).first()[0] or EPOCH


def search_page(history: DataFrame, number: int = 0, size: int = PAGE_SIZE_DEFAULT, **filters) -> dict:
    """The search interface as a dict: total before paging, the page, and store metadata."""
    if number < 0 or size < 0:
        raise ValueError("invalid page")
    latest = filters.pop("latest", None) or latest_of(history)
    rows = search(history, latest=latest, **filters)
    size = min(size, PAGE_SIZE_CAP)
    data = [r.asDict(True) for r in api_rows(page(rows, number, size), F.lit(latest)).collect()]
    return {
        "total": rows.count(),
        "error": None,
        "data": data,
        "meta": {"latest_date": str(latest), "format_version": FORMAT_VERSION},
        "page": number,
        "page_size": size,
    }


def validate_one(history: DataFrame, prefix: str, asn: int, date: str | dt.date | None = None) -> dict:
    """The validation interface for one announcement; the date defaults to the store's latest."""
    name, fam, plen, lo, _ = parse_prefix(prefix)
    if not 0 <= asn <= ASN_MAX:
        raise ValueError("number out of range")
    day = strict_date(date) or latest_of(history)
    q = history.sparkSession.createDataFrame(
        [(0, fam, plen, bytearray(lo), asn, day)], "qid int, fam tinyint, plen smallint, lo binary, asn bigint, date date"
    )
    return {"prefix": name, "asn": asn, "date": str(day), "result": validate_bulk(q, history).first()["result"]}


def health(history: DataFrame) -> dict:
    """Store statistics; the counts are distinct prefixes of each family."""
    n = {r["fam"]: r["prefixes"] for r in counts(history).collect()}
    return {
        "ipv4_roas_count": n.get(4, 0),
        "ipv6_roas_count": n.get(6, 0),
        "latest_date": str(latest_of(history)),
        "format_version": FORMAT_VERSION,
    }
