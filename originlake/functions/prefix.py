"""Prefix functions: parse, canonical keys, ancestors and display.

A prefix is carried as ``fam`` (4 or 6), ``plen``, ``lo`` and ``hi`` (first and
last address, big-endian BINARY of 4 or 16 bytes, so that comparing bytes
compares addresses) beside its text. Parsing arbitrary text needs Python; all
that queries do afterwards stays in built-in expressions.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("fam", T.ByteType()),
        T.StructField("plen", T.ShortType()),
        T.StructField("lo", T.BinaryType()),
        T.StructField("hi", T.BinaryType()),
    ]
)


def parse_cidr(text: str | None):
    """One prefix as (prefix, fam, plen, lo, hi), host bits cleared; None for bad text or no length."""
    if text is None or "/" not in text:
        return None
    addr, _, length = text.strip().partition("/")
    if not length.isascii() or not length.isdigit():
        return None
    try:
        net = ipaddress.ip_network(f"{addr}/{length}", strict=False)
    except ValueError:
        return None
    return str(net), net.version, net.prefixlen, net.network_address.packed, net.broadcast_address.packed


@F.pandas_udf(PARSED)
def _parse(texts: pd.Series) -> pd.DataFrame:
    memo = {t: parse_cidr(t) for t in texts.unique()}
    rows = [memo[t] or (None,) * 5 for t in texts]
    return pd.DataFrame(rows, columns=["prefix", "fam", "plen", "lo", "hi"])


def with_prefix_key(df: DataFrame, col: str = "prefix") -> DataFrame:
    """Replace the text column by its canonical form and add fam, plen, lo, hi (all null for bad text)."""
    rest = [c for c in df.columns if c not in (col, "fam", "plen", "lo", "hi")]
    return df.withColumn("_p", _parse(F.col(col))).select(*rest, "_p.*")


def v4_key(addr: Column, plen: Column) -> list[Column]:
    """fam, plen, lo, hi of an IPv4 address held as a BIGINT: arithmetic only, no Python."""
    block = F.pow(F.lit(2), 32 - plen).cast("bigint")
    lo = addr - addr % block
    as_bytes = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    return [
        F.lit(4).cast("tinyint").alias("fam"),
        plen.cast("smallint").alias("plen"),
        as_bytes(lo).alias("lo"),
        as_bytes(lo + block - 1).alias("hi"),
    ]


def v6_key(top: Column, plen: Column) -> list[Column]:
    """fam, plen, lo, hi of an IPv6 prefix of 11 to 64 bits whose address's upper half is a positive BIGINT."""
    block = F.pow(F.lit(2), 64 - plen).cast("bigint")
    lo = top - top % block
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    return [
        F.lit(6).cast("tinyint").alias("fam"),
        plen.cast("smallint").alias("plen"),
        F.unhex(F.concat(half(lo), F.lit("0" * 16))).alias("lo"),
        F.unhex(F.concat(half(lo + block - 1), F.lit("F" * 16))).alias("hi"),
    ]


def v6_text(lo: Column, plen: Column) -> Column:
    """All eight groups of a 16-byte BINARY address and a length; not the canonical short form."""
    h = F.lower(F.hex(lo))
    return F.concat(F.concat_ws(":", *[F.substring(h, i, 4) for i in range(1, 32, 4)]), F.lit("/"), plen.cast("string"))


def v4_text(lo: Column, plen: Column) -> Column:
    """Dotted form of a 4-byte BINARY address and a length."""
    h = F.hex(lo)
    parts = [F.conv(F.substring(h, i, 2), 16, 10) for i in (1, 3, 5, 7)]
    return F.concat(F.concat_ws(".", *parts), F.lit("/"), plen.cast("string"))


def v4_number(lo: Column) -> Column:
    """A 4-byte BINARY address as BIGINT."""
    return F.conv(F.hex(lo), 16, 10).cast("bigint")


def address_number(lo: Column) -> Column:
    """An IPv4 address, or the upper half of an IPv6 address, as BIGINT."""
    return F.conv(F.substring(F.hex(lo), 1, 16), 16, 10).cast("bigint")


def masked(lo: Column, length: Column) -> Column:
    """``lo`` with all bits after the first ``length`` cleared, nibble by nibble on the hex form."""
    h = F.hex(lo)
    whole, rest = (length / 4).cast("int"), length % 4
    nib = F.substring(h, whole + 1, F.lit(1))
    kept = (
        F.when(rest == 1, F.translate(nib, "0123456789ABCDEF", "0000000088888888"))
        .when(rest == 2, F.translate(nib, "0123456789ABCDEF", "000044448888CCCC"))
        .when(rest == 3, F.translate(nib, "0123456789ABCDEF", "0022446688AACCEE"))
        .otherwise(F.lit(""))
    )
    return F.unhex(F.rpad(F.concat(F.substring(h, F.lit(1), whole), kept), F.length(h), F.lit("0")))


def with_ancestors(df: DataFrame, name: str = "a") -> DataFrame:
    """One row for each covering prefix of (fam, plen, lo), itself included: ``<name>_plen``, ``<name>_lo``.

    At most 33 rows for IPv4 and 129 for IPv6; callers join these on equality.
    """
    p, lo = f"{name}_plen", f"{name}_lo"
    return df.withColumn(p, F.explode(F.sequence(F.lit(0), F.col("plen").cast("int")))).withColumn(
        lo, masked(F.col("lo"), F.col(p))
    )


def strip_as(col: Column) -> Column:
    """ASN text such as AS64512 (the mark may repeat) as BIGINT; null if it is no number in range."""
    n = F.regexp_replace(col, "^(AS)+", "").try_cast("bigint")
    return F.when((n >= 0) & (n <= 4294967295), n)
