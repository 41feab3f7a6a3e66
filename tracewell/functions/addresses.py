"""IP addresses as columns of bits, and the longest block that holds each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import ipv4_number

_GROUP = "[0-9a-f]{1,4}"
_GROUPS = rf"^{_GROUP}(:{_GROUP})*$"


def _bits(hex_: Column, digits: int) -> Column:
    """Hexadecimal digits (16 at most) as bits."""
    return F.lpad(F.conv(hex_, 16, 2), 4 * digits, "0")


def ipv4_bits(text: Column) -> Column:
    """The 32 bits of a dotted quad; null for anything else."""
    return F.lpad(F.bin(ipv4_number(text)), 32, "0")


def _let(value: Column, make) -> Column:
    """make(value), with value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def ipv6_bits(text: Column) -> Column:
    """The 128 bits of an IPv6 address, in full, shortened by one ::, or with a dotted quad at its end; null for anything else."""

    def without_quad(t: Column) -> Column:
        quad = ipv4_number(F.regexp_extract(t, r"([0-9.]+)$", 1))
        pair = _let(quad, lambda q: F.concat(F.hex(F.shiftright(q, 16)), F.lit(":"), F.hex(q % 65536)))
        return F.when(F.contains(t, F.lit(".")), F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+$", 1), F.lower(pair))).otherwise(t)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).when(part.rlike(_GROUPS), F.split(part, ":"))

    def padded(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")

    def joined(ends: Column) -> Column:
        tail = F.when(F.size(ends) == 2, groups(F.get(ends, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return _let(F.struct(F.size(ends).alias("ends"), groups(ends[0]).alias("head"), tail.alias("tail")), digits)

    def digits(x: Column) -> Column:
        n = F.size(x["head"]) + F.size(x["tail"])
        whole = F.when(x["ends"] == 1, n == 8).otherwise((x["ends"] == 2) & (n <= 7))
        there = whole & x["head"].isNotNull() & x["tail"].isNotNull()
        return F.when(there, F.concat(padded(x["head"]), F.repeat(F.lit("0000"), 8 - n), padded(x["tail"])))

    made = _let(_let(F.lower(text), without_quad), lambda t: joined(F.split(t, "::")))
    return _let(made, lambda d: F.concat(_bits(F.substring(d, 1, 16), 16), _bits(F.substring(d, 17, 16), 16)))


def address_bits(text: Column) -> Column:
    """The bits of an address of either kind; their number tells the kind."""
    return F.coalesce(ipv4_bits(text), ipv6_bits(text))


def longest_block(addresses: DataFrame, blocks: DataFrame, bits: str) -> DataFrame:
    """addresses with block: the narrowest of blocks (block, first, length: an address and its leading bits that count) that holds
    their bits, or null. A distinct address is looked up once for each length in use (162 at most), by equal leading bits: the rows
    of blocks may be many, and no range is compared. Of equal blocks the first by name counts."""
    b = blocks.select("block", F.col("length").cast("int").alias("length"), address_bits(F.col("first")).alias("_b")).where("_b IS NOT NULL")
    b = b.withColumn("_size", F.length("_b")).where("length BETWEEN 0 AND _size").withColumn("_prefix", F.expr("substring(_b, 1, length)"))
    b = b.groupBy("_size", "length", "_prefix").agg(F.min("block").alias("block"))
    lengths = b.select("_size", "length").distinct().groupBy("_size").agg(F.collect_set("length").alias("lengths"))  # a row a kind
    a = addresses.select(F.col(bits).alias("_a")).where(F.col(bits).isNotNull()).distinct().withColumn("_size", F.length("_a"))
    a = a.join(F.broadcast(lengths), "_size").withColumn("length", F.explode("lengths")).withColumn("_prefix", F.expr("substring(_a, 1, length)"))
    best = a.join(b, ["_size", "length", "_prefix"]).groupBy("_a").agg(F.max_by("block", "length").alias("block"))
    return addresses.join(best, addresses[bits] == best["_a"], "left").drop("_a")
