"""Prefix containment without a range join.

Prefixes are nested or disjoint, so each stored prefix has one outermost stored
ancestor, its root. ``with_roots`` stores the root's key beside each row; a
query finds the root that covers it by equality on its (at most 129) masked
forms and then reads the root's rows by equality on ``root``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originlake.functions.prefix import masked

#: Prefixes shorter than this are few by nature: at most 2 * (2**16 - 1) exist, so they may be broadcast.
SHORT = 16
#: Rows of one key that are joined as one, on the right and on the left: Spark holds all pairs of two packs at once.
PACK, LEFT_PACK = 1024, 8


def _root_name() -> F.Column:
    return F.concat_ws("/", "fam", F.hex("root_lo"), "root_plen")


def prefix_roots(prefixes: DataFrame) -> DataFrame:
    """(fam, plen, lo, hi) distinct -> the same with ``root`` (text), ``root_plen`` and ``root_lo``.

    Prefixes of at least 16 bits never reach beyond their first two bytes, so the
    running maximum that finds roots is dealt by these bytes, not by family. The
    shorter ones are bounded in number and handled by equality against their
    masked forms.
    """
    p = prefixes.select("fam", "plen", "lo", "hi").dropDuplicates(["fam", "plen", "lo"])
    short = p.where(F.col("plen") < SHORT).select("fam", "plen", "lo")
    covers = F.broadcast(short.select("fam", F.col("plen").alias("a_plen"), F.col("lo").alias("a_lo")))
    up = (
        p.withColumn("a_plen", F.explode(F.sequence(F.lit(0), F.least(F.col("plen").cast("int"), F.lit(SHORT - 1)))))
        .withColumn("a_lo", masked(F.col("lo"), F.col("a_plen")))
        .withColumn("a_plen", F.col("a_plen").cast("smallint"))
        .join(covers, ["fam", "a_plen", "a_lo"])
        .groupBy("fam", "plen", "lo")
        .agg(F.min(F.struct("a_plen", "a_lo")).alias("top"))
    )
    w = Window.partitionBy("fam", "_b").orderBy("lo", "plen")
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        p.where(F.col("plen") >= SHORT)
        .withColumn("_b", F.substring("lo", 1, 2))
        .withColumn("_reach", F.max("hi").over(running))
        .withColumn("_new", F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")))
        .withColumn(
            "own",
            F.last(F.when(F.col("_new"), F.struct(F.col("plen").alias("a_plen"), F.col("lo").alias("a_lo"))), True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select("fam", "plen", "lo", "own")
    )
    return (
        p.join(rest, ["fam", "plen", "lo"], "left")
        .join(up, ["fam", "plen", "lo"], "left")
        .withColumn("_root", F.coalesce("top", "own"))
        .select(
            "fam",
            "plen",
            "lo",
            "hi",
            F.col("_root.a_plen").cast("smallint").alias("root_plen"),
            F.col("_root.a_lo").alias("root_lo"),
        )
        .withColumn("root", _root_name())
    )


def with_roots(history: DataFrame) -> DataFrame:
    """History rows with ``root``, recomputed for the whole store: a wider new prefix may merge roots."""
    roots = prefix_roots(history).select("fam", "plen", "lo", "root")
    return history.drop("root").join(roots, ["fam", "plen", "lo"])


def root_table(indexed: DataFrame) -> DataFrame:
    """Distinct roots as (fam, r_plen, r_lo, root), from rows that are their own root."""
    own = F.concat_ws("/", "fam", F.hex("lo"), "plen")
    return (
        indexed.where(F.col("root") == own)
        .select("fam", F.col("plen").cast("int").alias("r_plen"), F.col("lo").alias("r_lo"), "root")
        .dropDuplicates(["root"])
    )


def cover_root(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """Queries (any columns with fam, plen, lo) that a stored prefix covers, with that ``root``.

    Roots are disjoint, so there is at most one; the query's own prefix counts as
    covering. Queries are masked to the lengths that roots have, at most 33 and 129.
    Left to the planner, which broadcasts the roots only when small.
    """
    roots = root_table(indexed)
    lengths = F.broadcast(roots.select("fam", "r_plen").distinct())
    asked = queries.join(lengths, "fam").where(F.col("r_plen") <= F.col("plen"))
    asked = asked.withColumn("r_lo", masked(F.col("lo"), F.col("r_plen")))
    return asked.join(roots, ["fam", "r_plen", "r_lo"]).select(*queries.columns, "root")


def packed_pairs(left: DataFrame, right: DataFrame, key: list[str], pack: int = PACK, left_pack: int = LEFT_PACK) -> DataFrame:
    """The key and arrays ``_left`` and ``_right`` of which every pair is one of a left and a right row with equal, non-null keys.

    A key may hold a large share of both sides. Its rows go in packs of about ``pack`` (those of the
    left side ``left_pack``), and each pack of the right side is a key of its own, to which the left
    packs are copied, so a key's pairs are dealt over many tasks and are made by unpacking, not by comparing.
    What two packs unpack to is buffered as rows before it goes on, so the product of both sizes stays small.
    """
    spark = left.sparkSession
    n = max(200, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs = lambda df, name, most: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    size = packs(left, "_m", left_pack).join(packs(right, "_n", pack), key)

    def packed(df: DataFrame, by: str, place: str, rows: str, *more: str) -> DataFrame:
        cols = [c for c in df.columns if c not in key]
        number = F.pmod(F.xxhash64(*cols), F.col(by)).alias(place)
        return df.join(size, key).select(*key, number, *more, F.struct(*cols).alias("_row")).groupBy(*key, place, *more).agg(F.collect_list("_row").alias(rows))

    ours = packed(left, "_m", "_i", "_left", "_n").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    theirs = packed(right, "_n", "_j", "_right")
    met = ours.repartition(n, *key, "_j").join(theirs.repartition(n, *key, "_j").hint("merge"), [*key, "_j"])
    return met.select(*key, "_left", "_right")


def pairs(left: DataFrame, right: DataFrame, key: list[str], pack: int = PACK, left_pack: int = LEFT_PACK) -> DataFrame:
    """Every pair of a left and a right row with equal, non-null keys: the key and both sides' other columns."""
    one = packed_pairs(left, right, key, pack, left_pack).select(*key, F.explode("_left").alias("_l"), "_right")
    return one.select(*key, "_l", F.explode("_right").alias("_r")).select(*key, "_l.*", "_r.*")


def subtree_match(queries: DataFrame, indexed: DataFrame, qid: str = "qid", cols: list[str] | None = None) -> DataFrame:
    """Each query with every stored row in the subtree of its shortest covering prefix, siblings included.

    Columns: ``qid`` and the history columns, or ``cols`` of them. A query that nothing covers has no
    rows even where stored prefixes lie inside it.
    """
    cols = cols or indexed.columns
    places = cover_root(queries.select("fam", "plen", "lo").distinct(), indexed).withColumnRenamed("root", "_root")
    found = queries.select(qid, "fam", "plen", "lo").join(places, ["fam", "plen", "lo"]).select("_root", qid)
    return pairs(found, indexed.select(F.col("root").alias("_root"), *cols), ["_root"]).select(qid, *cols)


def related_match(queries: DataFrame, indexed: DataFrame, qid: str = "qid", cols: list[str] | None = None) -> DataFrame:
    """Extra mode: true covering and covered prefixes only, by two equality joins.

    Covering: masked forms of the query against stored keys. Covered: masked
    forms of the stored keys against the queries. Both are cut to the lengths that the other side has.
    """
    cols = cols or indexed.columns
    key = ["_fam", "_plen", "_lo"]
    named = [F.col("fam").alias("_fam"), F.col("plen").alias("_plen"), F.col("lo").alias("_lo")]
    rows = indexed.select(*named, *cols)
    asked = queries.select(*named, qid)

    def above(df: DataFrame, other: DataFrame, low: int) -> DataFrame:
        """Rows under the keys of their covering prefixes, those ``low`` bits shorter at least."""
        lengths = F.broadcast(other.select("_fam", F.col("_plen").alias("_k")).distinct())
        up = df.join(lengths, "_fam").where(F.col("_k") <= F.col("_plen") - low).withColumn("_lo", masked(F.col("_lo"), F.col("_k").cast("int")))
        return up.withColumn("_plen", F.col("_k")).select(*df.columns)

    covering = pairs(above(asked, rows, 0), rows, key)
    covered = pairs(asked, above(rows, asked, 1), key)
    return covering.select(qid, *cols).unionByName(covered.select(qid, *cols))
