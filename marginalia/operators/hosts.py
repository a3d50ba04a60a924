"""Which hosts are public: addresses looked up in a table of blocks, the longest prefix decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .order import stable

DOTTED = r"\d{1,3}(?:\.\d{1,3}){3}"
#: The blocks of addresses that are not public (registries of special addresses), and those inside them that are.
CLOSED_4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"
OPEN_4 = "192.0.0.9/32 192.0.0.10/32"
CLOSED_6 = "::/3 2001::/23 2001:db8::/32 2002::/16 3fff::/20 4000::/2 8000::/1"
OPEN_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28"


def _hex4(host: Column) -> Column:
    """The eight hex digits of a dotted address; null if a number is over 255."""
    parts = F.transform(F.split(host, r"\."), lambda x: x.cast("int"))
    return F.when(F.forall(parts, lambda x: x < 256), F.lower(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x), 2, "0")), "")))


def _hex6(host: Column) -> Column:
    """The 32 hex digits of an IPv6 address, a dotted tail and one ``::`` allowed; null if it is none."""
    dotted = _hex4(F.nullif(F.regexp_extract(host, rf"({DOTTED})$", 1), F.lit("")))
    host = F.when(host.rlike(rf":{DOTTED}$"), F.concat(F.regexp_replace(host, rf"{DOTTED}$", ""), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))).otherwise(host)
    sides = F.split(host, "::", -1)
    digits = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = digits(sides[0]), F.when(F.size(sides) == 2, digits(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    sound = F.when(F.size(sides) == 1, gap == 0).otherwise((F.size(sides) == 2) & (gap > 0)) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~host.rlike("^:[^:]|[^:]:$|:::")
    return F.when(sound, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def special_blocks(spark: SparkSession) -> DataFrame:
    """``cidr, closed``: the special blocks of the registries; what no block names is public."""
    rows = [(c, closed) for blocks, closed in ((CLOSED_4, True), (OPEN_4, False), (CLOSED_6, True), (OPEN_6, False), ("::ffff:0:0/96", False)) for c in blocks.split()]
    return spark.createDataFrame(rows, "cidr string, closed boolean")


def address(host: Column) -> Column:
    """A literal as the 32 hex digits of an IPv6 address, IPv4 mapped into it; ``bad`` if it looks like one but is none; null for names."""
    four = lambda h: F.coalesce(F.concat(F.lit("0" * 20 + "ffff"), _hex4(h)), F.lit("bad"))
    six = lambda h: F.coalesce(_hex6(h), F.lit("bad"))
    return F.when(host.rlike(f"^{DOTTED}$"), four(host)).when(host.contains(":"), six(host))


def bare_host(host: Column) -> Column:
    """In lower case, without the brackets and the zone of an IPv6 literal."""
    return F.regexp_replace(F.lower(host), r"^\[|%[^\]]*|\]$", "")


def _bits(hex32: Column) -> Column:
    return F.concat(*[F.lpad(F.conv(F.substring(hex32, at, 16), 16, 2), 64, "0") for at in (1, 17)])


def _digits(bits: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, at, 64), 2, 16)), 16, "0") for at in (1, 65)])


def _longest_prefix(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``bits, closed`` for each of some points: what the longest prefix among the blocks says, null if none fits.

    A point is looked up once for each length that occurs among the blocks, by equality.
    """
    lengths = blocks.select("length").distinct()
    asked = points.join(F.broadcast(lengths)).select("bits", "length", F.substring("bits", F.lit(1), F.col("length")).alias("prefix"))  # 129 lengths at most
    return asked.join(blocks, ["length", "prefix"], "left").groupBy("bits").agg(F.max_by("closed", F.when(F.col("closed").isNotNull(), F.col("length"))).alias("closed"))


def block_ranges(blocks: DataFrame) -> DataFrame:
    """``key, closed``: the addresses, as 32 hex digits, from which on another block decides than before; null where none does.

    Blocks nest or lie apart. What decides changes only where one begins and just behind where one ends; there the
    longest prefix is looked up. Bits of a cidr beyond its length are ignored; equal blocks that disagree are closed;
    what is no block is left out.
    """
    parts = F.split(F.lower(F.trim("cidr")), "/", -1)
    rows = blocks.select(F.when(F.size(parts) == 2, address(parts[0])).alias("at"), F.get(parts, F.lit(1)).try_cast("int").alias("n"), parts[0].contains(":").alias("six"), F.col("closed"))
    rows = rows.where("at is not null and at <> 'bad' and n between 0 and if(six, 128, 32) and closed is not null").withColumn("length", F.when(F.col("six"), F.col("n")).otherwise(F.col("n") + 96))
    prefixes = stable(rows.select("length", F.substring(_bits(F.col("at")), F.lit(1), F.col("length")).alias("prefix"), "closed").groupBy("length", "prefix").agg(F.max("closed").alias("closed")))
    begins = prefixes.select(F.rpad("prefix", 128, "0").alias("bits"))
    behind = prefixes.where(F.col("prefix").contains("0")).select(F.rpad(F.regexp_replace("prefix", "0(1*)$", "1"), 128, "0").alias("bits"))  # the prefix plus one
    return _longest_prefix(begins.union(behind).distinct(), prefixes).select(_digits(F.col("bits")).alias("key"), "closed")


def last_mark(points: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """``key`` of ``points`` with the ``value`` of the last of ``marks`` (key, value; keys differ) at or before it.

    Both are sorted together by ranges of the key; a range that begins without a mark takes the last of those before it, one
    small row each. So neither side is broadcast, and nothing is compared with more than its neighbour.
    """
    parts = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mark = F.struct(F.col(value)).alias("mark")
    rows = points.select("key", F.lit(None).alias("mark")).unionByName(marks.select("key", mark))
    rows = stable(rows.repartitionByRange(parts, "key").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy("key", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("mark", ignorenulls=True).over(before)).where("mark is null")
    lasts = rows.groupBy("_part").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("key"))).alias("last"))
    lasts = lasts.select("_part", F.last("last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    return near.join(F.broadcast(lasts), "_part").select("key", F.coalesce("near", "far")[value].alias(value))


def judge_hosts(hosts: DataFrame, blocks: DataFrame, host: str = "host") -> DataFrame:
    """``hosts`` plus ``public``: whether a host's address lies in no closed block of ``blocks`` (cidr, closed).

    The longest prefix decides, of IPv4 and IPv6 blocks of any number; an address mapped from IPv4 counts as that. What
    looks like an address but is none is not public, nor is a name of this machine; other names are public as far as a
    table can tell: they are not resolved. Null stays null. Different addresses are looked up once each.
    """
    bare = bare_host(F.col(host))
    rows = hosts.withColumn("_address", F.get(F.transform(F.array(bare), address), F.lit(0)))
    literal = rows.where("_address is not null and _address <> 'bad'").select(F.col("_address").alias("key")).distinct()
    found = last_mark(literal, block_ranges(blocks), "closed").select(F.col("key").alias("_address"), F.coalesce("closed", F.lit(False)).alias("_closed"))
    local = bare.rlike(r"(^|\.)localhost\.?$")
    public = F.when(F.col("_address") == "bad", False).when(F.col("_address").isNull(), ~local).otherwise(~F.col("_closed"))
    return rows.join(found, "_address", "left").select(*hosts.columns, public.alias("public"))
