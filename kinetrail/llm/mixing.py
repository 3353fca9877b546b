"""Mixing sources to target weights by systematic sampling (operator 8), DataFrame operations only.

Each source gets a target number of words; every document of a source is expected
target / source_size times. Documents of a source are put in a fixed order, their expected
copies are summed up in that order, a random offset of the source is added, and a document
is emitted once for each integer boundary its stretch crosses. The order is by size, up
through one half of the documents (chosen by hash) and down through the other: as sizes rise
and fall alike, what rounding adds on the way up it takes off on the way down, and the words
taken come near the target. The order is kept by (source, half, size, hash part), which
splits hot sources and hot sizes over many tasks: prefix sums run over group counts, and only
ranks within a part need its rows together.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating; a target stops
at `most` times its source's size and the excess is shared anew by weight until none is
above (water filling, in closed form over the sources' cap-to-weight ratios).

Defined results: null text has no words; documents without words are taken 0 words; a
source without words has target 0; repeated rows count each; an empty input gives an empty
result; only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, documents, maybe_listed, text_or_empty, written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size). One row per source from here on."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * most)
    #: Sources fill up in order of cap / weight: the first whose level lies under its cap sets the level of the rest.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    filled = each.withColumn("capped", F.sum("cap").over(order) - F.col("cap")).withColumn("open", F.sum("weight").over(every) - (F.sum("weight").over(order) - F.col("weight")))
    level = (F.sum("source_size").over(every) * share - F.col("capped")) / F.col("open")
    filled = filled.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(every)["level"])
    return filled.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """A random number in [0, 1) of the source."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / float(2**48)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies."""
    part = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 2)
    half = (F.conv("part", 16, 10).cast("int") % 2).alias("half")
    turn = F.when(F.col("half") == 0, F.col("size")).otherwise(-F.col("size"))
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(ASCII_WORD)).cast("long").alias("size"), part.alias("part")).select("*", half), "mix-sizes")
    groups = written(rows.groupBy("source", "half", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    targets = source_targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    by_size = groups.groupBy("source", "half", "size").agg(F.sum("n").alias("n"))
    below_size = by_size.select("source", "half", "size", (F.sum("n").over(Window.partitionBy("source").orderBy("half", turn)) - F.col("n")).alias("before"))
    below_part = groups.select("source", "half", "size", "part", (F.sum("n").over(Window.partitionBy("source", "half", "size").orderBy("part")) - F.col("n")).alias("earlier"))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    starts = below_part.alias("a").join(below_size.alias("b"), same(_at("a"), _at("b"), ("source", "half", "size"))).select("a.source", "a.half", "a.size", "a.part", (F.col("before") + F.col("earlier")).alias("start"))
    starts = starts.alias("a").join(targets.alias("b"), same(_at("a"), _at("b"), ("source",))).select("a.*", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "half", "size", "part").orderBy("id"))
    ranked = rows.withColumn("place", place)
    joined = ranked.alias("a").join(starts.alias("b"), same(_at("a"), _at("b"), ("source", "half", "size", "part"))).select("a.*", "start", "source_size", "target")
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    rank = F.col("start") + F.col("place")
    edge = lambda k: F.floor(_offset(F.col("source"), seed) + rate * k)
    copies = (edge(rank) - edge(rank - 1)).cast("long")
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"))


class _at:
    """Columns of an aliased side: _at("a")["x"] is column a.x."""

    def __init__(self, side: str):
        self.side = side

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.side}.{name}")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Rows of one id beyond which they are spread over SALTS tasks where they meet its copies.
HOT_ROWS, SALTS = 1000, 16


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs`, each as many times as the mix takes it. Rows that share a doc_id (null, say)
    share its copies, equal rows first taken together: what cannot be dealt evenly goes to the first
    rows in an order by hash."""
    counts = written(mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")), "mix-copies")
    copies = counts.where("_copies > 0").select(F.col("doc_id").alias("_id"), "_copies", "_rows")
    hot = counts.where(F.col("_rows") > HOT_ROWS).select("doc_id")
    salt, rows = F.lit(0), docs
    if not hot.isEmpty():
        # Both sides tell by the same bit table whether an id may be hot.
        rows, salt = maybe_listed(docs, "doc_id", hot), F.when(F.col("_maybe"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
        copies = maybe_listed(copies, "_id", hot).withColumn("_salt", F.explode(F.when(F.col("_maybe"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_maybe")
    else:
        copies = copies.withColumn("_salt", F.lit(0))
    rows = rows.select(*docs.columns, salt.alias("_at"))
    # The counts grow with the documents: they meet them by a shuffle at every size, never by a broadcast.
    joined = rows.join(copies.hint("merge"), rows["doc_id"].eqNullSafe(copies["_id"]) & (F.col("_at") == F.col("_salt"))).drop("_id", "_at", "_salt")
    repeat = lambda df, n: df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))).select(docs.columns)
    alone = repeat(joined.where("_rows = 1"), F.col("_copies"))
    if counts.where("_rows > 1").isEmpty():
        return alone
    return alone.unionByName(repeat(_dealt(joined.where("_rows > 1"), docs.columns), F.col("_mine")))


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows as one, with `_mine`, their copies together: the whole share of each, and one more for those
    that come first. Places are counted in 256 slices of the hash, each ranked by itself."""
    same = rows.groupBy(*columns, "_copies", "_rows").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(*columns))
    same = written(same.withColumn("_slice", F.shiftright("_h", 56).cast("int")), "mix-shared")
    totals = same.groupBy("doc_id", "_slice").agg(F.sum("_n").alias("_total"))
    before = totals.select(F.col("doc_id").alias("_id"), F.col("_slice").alias("_of"), (F.sum("_total").over(Window.partitionBy("doc_id").orderBy("_slice")) - F.col("_total")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("doc_id", "_slice").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = same.withColumn("_inside", inside).join(before, same["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_slice") == F.col("_of")))
    extra = F.least(F.col("_n"), F.greatest(F.lit(0), F.pmod("_copies", "_rows") - F.col("_before") - F.col("_inside")))
    return placed.withColumn("_mine", F.floor(F.col("_copies") / F.col("_rows")) * F.col("_n") + extra).where("_mine > 0")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(doc_id::VARCHAR), 1, 2) AS part, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 2 AS half FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, sum(cap) OVER o - cap AS capped, sum(weight) OVER () - (sum(weight) OVER o - weight) AS open,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY cap / weight, place)
), l AS (
  SELECT *, first_value(CASE WHEN (total - capped) / open * weight <= cap THEN (total - capped) / open END IGNORE NULLS)
            OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, least(coalesce(level * weight, cap), cap) AS target,
         least(CASE WHEN source_size > 0 THEN least(coalesce(level * weight, cap), cap) / source_size ELSE 0 END, 2.0::DOUBLE) AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY half, CASE WHEN half = 0 THEN size ELSE -size END, part, doc_id) AS k FROM d
)
SELECT r.doc_id, r.size::BIGINT AS size, t.source_size, t.target,
       ((floor(t.u + t.rate * r.k) - floor(t.u + t.rate * (r.k - 1))) * r.size)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
