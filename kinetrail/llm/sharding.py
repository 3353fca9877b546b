"""Balanced sharding by histogram sort (operator 7), DataFrame operations only.

Rows are ordered by (hash of the text, doc_id). Splitters are found by exact byte counts
alone: every round counts the bytes of equal sub-ranges of the key ranges that still hold a
splitter (partial sums on the map side; at most 2**probe_bits counts per open range reach
the driver), descends into the sub-range where the wanted byte falls and stops once one of
its edges is within the tolerance. The hash puts equal texts side by side: an edge of the
hash never cuts a group. Only where no edge lies within `slack` of the fair share (a group
larger than that) the search goes on in doc_id and cuts the group, so even a group that
holds a third of all rows gives near equal shards. Rows are then dealt out once.

Defined results: null text has no bytes (size 8); repeated rows count each and stay in one
shard; a null doc_id orders first; an empty input gives an empty result; only the id and
the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions_of, text_or_empty, written

#: Bits of each of the two key words.
BITS = 63
MOST_LANES = 4096


class Range(NamedTuple):
    """A range of keys: the first `used` bits of hi are `prefix`, or hi is `hi` and so of lo."""

    hi: int | None
    used: int
    prefix: int

    def word(self) -> str:
        return "lo" if self.hi is not None else "hi"

    def holds(self) -> Column:
        inside = F.shiftright(self.word(), BITS - self.used) == self.prefix if self.used else F.lit(True)
        return inside if self.hi is None else inside & (F.col("hi") == self.hi)

    def child(self, step: int, probe: int) -> Range:
        prefix = (self.prefix << step) + probe
        if self.hi is None and self.used + step == BITS:
            return Range(prefix, 0, 0)
        return Range(self.hi, self.used + step, prefix)

    def low(self) -> tuple[int, int]:
        if self.hi is None:
            return self.prefix << (BITS - self.used), 0
        return self.hi, self.prefix << (BITS - self.used)


def _key_word(column: Column) -> Column:
    """A long as a non-negative 63-bit key, order kept."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(-(2**63))), 64 - BITS)


def splitters(keys: DataFrame, shards: int, probe_bits: int = 9, tolerance: float = 0.002, slack: float = 0.02) -> list[tuple[int, int]]:
    """The lowest (hi, lo) key of each of shards 1 .. shards-1; `keys` has hi, lo and size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    fair = total / shards
    found: dict[int, tuple[int, int]] = {}
    wanted = {s: (Range(None, 0, 0), 0) for s in range(1, shards)}  # range and bytes below it
    while wanted:
        ranges = sorted({r for r, _ in wanted.values()}, key=str)
        steps = {r: min(probe_bits, BITS - r.used) for r in ranges}
        probe = lambda r: F.shiftright(r.word(), BITS - r.used - steps[r]).bitwiseAND(F.lit(2 ** steps[r] - 1))
        at = F.coalesce(*[F.when(r.holds(), F.struct(F.lit(i).alias("i"), probe(r).cast("int").alias("b"))) for i, r in enumerate(ranges)])
        counts: dict[Range, list[tuple[int, int]]] = {r: [] for r in ranges}
        for i, b, n in keys.select(at.alias("at"), "size").where("at IS NOT NULL").groupBy("at.i", "at.b").agg(F.sum("size")).collect():
            counts[ranges[i]].append((b, n))
        for s, (r, below) in list(wanted.items()):
            aim, child, n = fair * s, None, 0
            for b, n in sorted(counts[r]):
                child = r.child(steps[r], b)
                if below + n > aim:
                    break
                below += n
            else:  # nothing of the range lies beyond the wanted byte: its upper edge
                child, n = r.child(steps[r], 2 ** steps[r]) if r.hi is not None or r.used + steps[r] < BITS else Range(None, BITS, (r.prefix << steps[r]) + 2 ** steps[r]), 0
            one_group = child.hi is not None
            if min(aim - below, below + n - aim) <= fair * (slack if one_group else tolerance) or n == 0 or one_group and child.used == BITS:
                upper = n > 0 and below + n - aim < aim - below
                hi, lo = child.low()
                if upper:
                    hi, lo = (hi + (1 << (BITS - child.used)), 0) if child.hi is None else (hi + 1, 0) if child.used == 0 else (hi, lo + (1 << (BITS - child.used)))
                found[s] = (hi + 1, 0) if lo >> BITS else (hi, lo)
                del wanted[s]
            else:
                wanted[s] = child, below
    return [max(found[i] for i in range(1, s + 1)) for s in range(1, shards)]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", probe_bits: int = 9, tolerance: float = 0.002, slack: float = 0.02) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 within its shard)."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    keys = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _key_word(F.xxhash64(text)).alias("hi"),
            _key_word(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).alias("lo"),
        ),
        "shard-keys",
    )
    bounds = splitters(keys, shards, probe_bits, tolerance, slack)
    above = [F.lit(False) if h >> BITS else (F.col("hi") > h) | (F.col("hi") == h) & (F.col("lo") >= low) for h, low in bounds]
    number = sum((c.cast("int") for c in above), F.lit(0))
    #: A slot is the rows of lower lanes of the shard plus the place within the lane; lanes bound a task's rows.
    lanes = min(max(64, partitions_of(spark)), MOST_LANES)
    dealt = keys.select("id", "size", "text_crc32", number.alias("shard"), F.pmod(F.xxhash64("id", "hi", F.lit(7)), F.lit(lanes)).cast("int").alias("lane"))
    counts = dealt.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("id", "size", "text_crc32"))
    #: shards x MOST_LANES rows at most, whatever the input's size.
    return dealt.withColumn("place", place.cast("long")).join(F.broadcast(before), ["shard", "lane"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
