"""Document fingerprints: threshold-scaled sketches (operator 3).

The 5-word shingles of a text are hashed to 48 bits; the fingerprint holds every hash below
a fixed fraction of the range, sorted. Sketches of one fraction merge by union, and as the
same hashes are kept in every document, likeness and containment can be estimated between
very unequal documents. A text with words but without a hash below the fraction is marked by
its least hash alone, so only texts without words have an empty fingerprint. Merging keeps
that rule: the merged fingerprint of two texts is that of all their shingles together.

The query compares each document with its edited text and with the next document. Rows are
dealt once, by ranges of doc_id whose first rows are known; the first row of each range is
also sent to the range before it, so each task finds every row's successor by reading its
sorted rows once, one row ahead. An id that holds more than a range's share of the rows (null, say)
is cut into ranges by the hash of the text, and its equal rows travel as one with their number.

Defined results: null text is empty; fewer than five words make one shingle of all; a text
without words has fingerprint "" (likeness 1 to another such text, 0 to any other); rows
with equal doc_id follow each other in an order by text, null ids come first; a table of one row
is its own next; an empty input gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, map_texts, partitions_of, slices, text_or_empty

WIDTH = 5
FRACTION = 1 / 4
BITS = 48
_COEFFICIENTS = [np.uint64(x | 1) for x in np.random.default_rng(20260101).integers(2**62, 2**63, 64, dtype=np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """Fingerprints of texts; keeps a bounded memo of word hashes."""

    def __init__(self, width: int = WIDTH, fraction: float = FRACTION, memo: int = 300_000):
        self.width, self.limit, self.most = width, _limit(fraction), memo
        self.words: dict[bytes, int] = {}

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) - 2**63
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """The hashes of all shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = self._word_hashes(words)
        n, width = max(1, len(words) - self.width + 1), min(self.width, len(words))
        total = np.full(n, np.uint64(width))
        for j in range(width):
            total += hashes[j : j + n] * _COEFFICIENTS[j]
        return _mixed(total) >> np.uint64(64 - BITS)

    def kept(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct retained hashes."""
        below = np.unique(hashes[hashes < self.limit])
        return below if len(below) or not len(hashes) else hashes.min(keepdims=True)

    def sketch(self, text: str | None) -> np.ndarray:
        return self.kept(self.hashes(text))


def to_string(sketch: np.ndarray) -> str:
    """12 hex digits a hash, ascending."""
    return np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").reshape(-1).astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _limit(fraction: float) -> np.uint64:
    return np.uint64(int(fraction * 2**BITS))


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float | None:
    """Estimated share of a's shingles that b has; None where a has no hash below the fraction and
    so tells nothing, unless the fingerprints are equal."""
    if np.array_equal(a, b) or not len(a):
        return 1.0
    below = a[a < _limit(fraction)]
    return len(np.intersect1d(below, b, assume_unique=True)) / len(below) if len(below) else None


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The fingerprint of both texts' shingles together: a least hash that only marks a short text
    goes where the other text has hashes below the fraction, and the lesser of two such marks stays."""
    both = np.union1d(a, b)
    below = both[both < _limit(fraction)]
    return below if len(below) else both[:1]


def fingerprints(docs: DataFrame, width: int = WIDTH, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint."""

    def make():
        sketcher = Sketcher(width, fraction)
        return lambda texts, columns: {"id": columns["id"], "fingerprint": [to_string(sketcher.sketch(t)) for t in texts]}

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return map_texts(rows, make, "id long, fingerprint string").withColumnRenamed("id", id_col)


class Ranges:
    """Ranges of (order, hash): each begins at a row that exists, given by `edges`."""

    def __init__(self, edges: list[tuple[int, int]]):
        edges = sorted(edges)
        self.orders = np.array([o for o, _ in edges], np.int64)
        self.hashes = np.array([h for _, h in edges], np.int64)

    def find(self, order: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether the row is where it begins."""
        low, at = np.searchsorted(self.orders, order, side="left"), np.searchsorted(self.orders, order, side="right") - 1
        for value in np.unique(order[at > low]):  # ids with several ranges
            mine, first = np.nonzero(order == value)[0], low[np.argmax(order == value)]
            at[mine] = first - 1 + np.searchsorted(self.hashes[first : at[mine[0]] + 1], hashes[mine], side="right")
        return at, (self.orders[at] == order) & (self.hashes[at] == hashes)


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Rows (text, sentinel, id, copies) in partitions of consecutive ids, sorted; the sentinel of a
    partition is the row that follows its last. None if there are no rows."""
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    n = partitions_of(spark)
    cuts = [i / n for i in range(1, n)] or [0.5]
    first, marks = docs.select(order.alias("o")).agg(F.min("o"), F.percentile_approx("o", cuts, 20 * n)).first()
    if first is None:
        return None
    shares = Counter([first, *marks])
    hot = [o for o, share in shares.items() if share > 2]
    edges = [(o, 0) for o in shares if o not in hot]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), order.alias("o"), text_or_empty(text_col).alias("text"))
    rows = rows.select("*", F.when(F.col("o").isin(hot), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("h"), F.lit(1).cast("long").alias("copies"))
    if hot:
        # As many slices of the hashes as the id has marks; a slice begins at the least hash that it holds.
        shares_of = F.create_map(*[F.lit(x).cast("long") for o in hot for x in (o, shares[o])])
        width = (F.lit(2.0**64) / F.element_at(shares_of, F.col("o"))).cast("double")
        slice_of = F.floor((F.col("h").cast("double") + 2.0**63) / width)
        edges += [tuple(r) for r in rows.where(F.col("o").isin(hot)).groupBy("o", slice_of.alias("slice")).agg(F.min("h").alias("h")).select("o", "h").collect()]
        together = rows.where(F.col("o").isin(hot)).groupBy("id", "o", "text", "h").agg(F.sum("copies").alias("copies"))
        rows = rows.where(~F.col("o").isin(hot)).unionByName(together)
    ranges = Ranges(edges)

    @F.pandas_udf("range int, begins boolean")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at, begins = ranges.find(ids.to_numpy(), hashes.to_numpy())
        return pd.DataFrame({"range": at.astype("int32"), "begins": begins})

    rows = rows.withColumn("r", range_of("o", "h"))
    own = F.struct(F.col("r.range").alias("range"), F.lit(False).alias("sentinel"))
    before = F.struct(F.pmod(F.col("r.range") - 1, F.lit(len(edges))).alias("range"), F.lit(True).alias("sentinel"))
    rows = rows.select("id", "o", "h", "copies", "text", F.explode(F.when(F.col("r.begins"), F.array(own, before)).otherwise(F.array(own))).alias("to")).select("to.range", "to.sentinel", "id", "o", "h", "copies", "text")
    return rows.repartitionById(len(edges), F.col("range")).sortWithinPartitions("sentinel", "o", "h", "text").select("text", "sentinel", "id", "copies")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """The query of the contract: each document against its edited text and against the next."""
    rows, names = with_successor(docs), [x.split()[0] for x in RESULT.split(", ")]
    if rows is None:
        return docs.sparkSession.createDataFrame([], RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, held, out, size = Sketcher(width, fraction), None, [], 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, "copies"])

        def compared(key: int | None, text: str, own: np.ndarray, later: str, sketch: np.ndarray, copies: int) -> None:
            nonlocal size
            cut = len(text) // 4
            edited = text[: len(text) - cut] + later[:cut]
            e = sketcher.sketch(edited)
            row = (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(own), to_string(e), likeness(own, e), likeness(own, sketch), copies)
            out.append(row)
            size += len(row[3]) + len(row[4])

        ended = False
        for part in slices(batches):
            for text, sentinel, key, copies in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if ended:
                    continue
                own = sketcher.sketch(text)
                if held is not None:
                    compared(*held, text, own, 1)
                ended, held = sentinel, (key, text, own)
                if copies > 1 and not sentinel:  # each but the last is followed by its like
                    compared(*held, text, own, copies - 1)
                if size > 4_000_000:
                    yield flushed()
                    out.clear()
                    size = 0
        if out:
            yield flushed()

    found = map_arrow(rows, run, f"{RESULT}, copies long")
    return found.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(names)


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
