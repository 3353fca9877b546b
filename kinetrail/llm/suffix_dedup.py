"""Removal of repeated byte strings with two-stage suffix sorting (operator 5).

A byte goes if a string of `span` (400) bytes over it also starts anywhere else. No machine
can sort all suffixes of a corpus, and none has to: strings that repeat are brought together
first, and suffix arrays decide on bytes.

1. Anchors. Every 400-byte window chooses the k-grams (k = 200) of least hash in it. The
   choice depends on the window's bytes alone, so equal windows, wherever they start, have
   an anchor of the same hash at the same place. An anchor row carries the hash of its
   k-gram and of its context: all windows that may have chosen it (200 bytes before to 400
   after its start, within the document).
2. Counting. Anchors whose hash occurs once cannot lie in a repeated window and end here.
   Contexts that occur at two or more places (row and start; anchors of a short text may
   share the whole text as context, which is one place) are repeated as a whole. Both are
   aggregations that combine on the map side.
3. Suffix arrays. Where one anchor has several different contexts, one copy of each comes
   together and the sorted window starts tell which windows repeat: suffixes smaller than
   their successor are sorted directly, all others are induced from them by one scan over
   the buckets of first bytes, and common prefixes of neighbours in that order are computed
   (`repeated_windows`). An anchor with more than GROUP different contexts is cut: its windows
   fall into classes by distance from the anchor, and a class into groups by the bytes all its
   windows share (376 of 400), whose shorter contexts are counted and sorted in the same way.
   Only a group that is still larger meets by digests of single windows. Rows of anchors with
   very many places are salted where they meet the list of repeated contexts. So no task gets
   an unbounded group.
4. Removal. The found intervals of a document are united and cut out of its bytes. Only
   documents that a bit table of bounded size says may have intervals are moved for that.

The texts are written once with a row number, which tells rows apart whatever their ids are.
Equal 64-bit k-gram hash and equal 64-bit context hash together are taken as equal contexts;
every other comparison is on bytes. Long texts are hashed in overlapping blocks.

Defined results: null text is empty; texts below 400 bytes stay whole; rows equal in id and
text count as two places; overlapping repeats inside one document count; null doc_ids are
rows like others and stay null; an empty input gives an empty result; only id and text are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, partitions_of, rows_per_batch, slices, text_or_empty, written

SPAN = 400
GRAM = 200
#: Different contexts of one anchor that one suffix array may get.
GROUP = 16384
#: Bytes of contexts a suffix array is built for at once (a group is never divided).
BATCH = 1_000_000
BLOCK = 1 << 19
#: Parts of a window start with very many places.
SALTS = 64
#: Texts of one Arrow batch.
TEXTS = 1000
#: Rows of one anchor that meet its contexts in one part; anchors with more are salted.
PART = 16384
#: Least and most bits (2 and 16 MB) of the table that tells which documents may take part.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
_TOP = np.uint64(2**64 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sliding(values: np.ndarray, width: int, op: np.ufunc, fill) -> np.ndarray:
    """op over every `width` neighbours: block-wise running results from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchor positions of byte strings."""

    def __init__(self, span: int = SPAN, gram: int = GRAM, block: int = BLOCK):
        self.span, self.gram, self.block = span, gram, block
        self.width = span - gram + 1
        size = block + span + 8
        inverse = pow(int(_BASE), -1, 2**64)
        self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _BASE))))
        self.inverses = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, np.uint64(inverse)))))

    def _chosen(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, k-gram hashes); ends: for each byte the end of its string."""
        n, k = len(data), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        hashes = (sums[k:] - sums[:-k]) * self.inverses[: n - k + 1]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        hashes |= np.uint64(1)
        place = np.arange(len(hashes))
        whole = place + k <= ends[: len(hashes)]
        hashes[~whole] = _TOP
        least = sliding(hashes, self.width, np.minimum, _TOP)
        least[place[: len(least)] + self.span > ends[: len(least)]] = 0  # windows over a string's end choose nothing
        edge = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate((edge, least, edge)), self.width, np.maximum, np.uint64(0))[: len(hashes)]
        at = np.nonzero((most == hashes) & whole)[0]
        return at, hashes[at]

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index, positions, hashes) of each text that has windows."""
        pending, size = [], 0
        for i, t in enumerate(texts):
            if len(t) < self.span:
                continue
            if len(t) > self.block:
                found = [self._block(t[at : at + self.block + self.span - 1], at) for at in range(0, len(t) - self.span + 1, self.block)]
                at, first = np.unique(np.concatenate([a for a, _ in found]), return_index=True)
                yield i, at, np.concatenate([h for _, h in found])[first]
                continue
            if size + len(t) > self.block:
                yield from self._together(texts, pending)
                pending, size = [], 0
            pending.append(i)
            size += len(t)
        yield from self._together(texts, pending)

    def _block(self, part: bytes, offset: int) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = self._chosen(np.frombuffer(part, np.uint8), np.full(len(part), len(part)))
        return at + offset, hashes

    def _together(self, texts: list[bytes], which: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not which:
            return
        sizes = np.array([len(texts[i]) for i in which])
        ends = np.cumsum(sizes)
        at, hashes = self._chosen(np.frombuffer(b"".join(texts[i] for i in which), np.uint8), np.repeat(ends, sizes))
        cuts = np.searchsorted(at, ends)
        low = 0
        for i, high, start in zip(which, cuts.tolist(), (ends - sizes).tolist(), strict=True):
            yield i, at[low:high] - start, hashes[low:high]
            low = high


def first_words(padded: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as big-endian numbers."""
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words <<= np.uint64(8)
        words |= padded[i : i + n]
    return words


def window_order(text: bytes, starts: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The window starts in order of their suffixes' first `depth` bytes, by two-stage sorting.

    A suffix smaller than its successor is of the direct kind. Direct suffixes are sorted by
    their bytes: eight as a number, the rest only where those are equal. Buckets of first
    bytes are then scanned in ascending order; a suffix met there puts the one before it, if
    that is of the other kind, at the next free place of its bucket. Within a bucket the
    induced come before the direct. Besides the starts, each start's successors up to the
    first direct one take part.
    """
    n = len(text)
    padded = np.full(n + depth + 16, 255, np.uint8)
    data = padded[:n]
    data[:] = np.frombuffer(text, np.uint8)
    follow = padded[1 : n + 1].astype(np.int16) - data
    follow[n - 1] = 1  # the end counts as greater than any byte
    place = np.arange(n, dtype=np.int32)
    differs = np.where(follow != 0, place, np.int32(n))
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    direct = follow[nearest] > 0
    next_direct = np.minimum.accumulate(np.where(direct, place, np.int32(n))[::-1])[::-1]
    takes = np.bincount(starts, minlength=n + 1) - np.bincount(next_direct[starts] + 1, minlength=n + 1)
    takes = np.cumsum(takes[:n]) > 0

    head = first_words(padded, n)
    sources = np.nonzero(takes & direct)[0]
    sources = sources[np.argsort(head[sources], kind="stable")]
    keys = head[sources]
    bounds = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))[0]
    sizes = np.diff(bounds)
    view = padded.tobytes()
    for b, size in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        group = sources[b : b + size].tolist()
        group.sort(key=lambda i: view[i + 8 : i + depth])
        sources[b : b + size] = group

    induced = takes & ~direct
    lead_direct = np.searchsorted(data[sources], np.arange(257))
    ready: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def spread(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Put what the scanned suffixes induce into its buckets; return the part for this bucket."""
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        first = data[before]
        for other in np.unique(first):
            if other != byte:
                ready[other].append(before[first == other])
        return before[first == byte]

    for byte in range(256):
        level = np.concatenate(ready[byte]) if ready[byte] else np.zeros(0, np.int64)
        while len(level):  # each round is one byte further into runs of this byte
            order.append(level)
            level = spread(level, byte)
        own = sources[lead_direct[byte] : lead_direct[byte + 1]]
        if len(own):
            order.append(own)
            spread(own, byte)
    order = np.concatenate(order)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(text: bytes, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Common prefix, `depth` at most, of each suffix of the order with the one before it.

    Neighbouring suffixes mostly have neighbouring predecessors. Such a chain is compared
    byte by byte once, from its first suffix to `depth` after its last, and each suffix's
    prefix ends at the next difference. Suffixes in short chains are compared alone, eight
    bytes at a time.
    """
    n = len(text)
    padded = np.full(n + depth + 16, 255, np.uint8)
    padded[:n] = np.frombuffer(text, np.uint8)
    same = np.zeros(len(order), np.int64)
    by_place = np.argsort(order[1:], kind="stable") + 1
    at, before = order[by_place], order[by_place - 1]
    first = np.nonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(before) != 1))))[0]
    sizes = np.diff(np.append(first, len(at)))
    chained = sizes >= 8
    alone = by_place[np.repeat(~chained, sizes)]
    first, sizes = first[chained], sizes[chained]
    spans = sizes + depth
    cut_at = np.searchsorted(np.cumsum(spans), np.arange(1, int(spans.sum()) // 500_000 + 1) * 500_000)
    for f, size, span in zip(*(np.split(x, cut_at) for x in (first, sizes, spans)), strict=True):
        if not len(f):
            continue
        ends = np.cumsum(span)
        offset = np.arange(ends[-1]) - np.repeat(ends - span, span)
        differs = padded[np.repeat(at[f], span) + offset] != padded[np.repeat(before[f], span) + offset]
        differs[ends - 1] = True
        place = np.arange(len(differs))
        nearest = np.minimum.accumulate(np.where(differs, place, len(differs))[::-1])[::-1]
        inside = offset < np.repeat(size, span)
        which = np.repeat(f, size) + offset[inside]
        same[by_place[which]] = (nearest - place)[inside]
    words = first_words(padded, n + depth)
    live = alone
    for step in range(0, depth, 8):
        differ = words[order[live - 1] + step] ^ words[order[live] + step]
        equal = differ == 0
        ended = live[~equal]
        same[ended] = step + (differ[~equal].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        live = live[equal]
        if not len(live):
            break
    same[live] = depth
    return np.minimum(same, depth)


def repeated_windows(contexts: list[bytes], span: int = SPAN, places: np.ndarray | None = None, often: np.ndarray | None = None) -> list[np.ndarray]:
    """For each context the window starts whose `span` bytes also start at another place.

    `places` numbers the place of each context's first byte (contexts may overlap; equal
    numbers are one place), `often` tells contexts that stand for several places.
    """
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - span + 1, 0)
    starts = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    if len(starts) < 2:
        return [np.zeros(0, np.int64)] * len(contexts)
    text = b"".join(contexts)
    order = window_order(text, starts, span)
    runs = np.nonzero(common_prefixes(text, order, span) < span)[0]  # where a run of equal windows begins
    context = np.searchsorted(base, order, side="right") - 1
    place = order if places is None else order - base[context] + places[context]
    apart = np.minimum.reduceat(place, runs) != np.maximum.reduceat(place, runs)
    if often is not None:
        apart |= np.logical_or.reduceat(often[context], runs)
    hit = order[np.repeat(apart, np.diff(np.append(runs, len(order))))]
    hit.sort()
    cuts = np.searchsorted(hit, np.append(base, len(text)))
    return [hit[a:b] - s for a, b, s in zip(cuts[:-1].tolist(), cuts[1:].tolist(), base.tolist(), strict=True)]


def covered(starts: np.ndarray, span: int = SPAN) -> list[tuple[int, int]]:
    """The windows at sorted `starts`, united into intervals."""
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > span)[0]
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + span).tolist(), strict=True))


def cut(data: bytes, intervals: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the intervals, and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    last = -1
    for start, end in sorted(intervals):
        if start > last:
            kept.append(data[at:start])
            runs += 1
        at = last = max(last, end)
    kept.append(data[max(at, 0) :])
    return b"".join(kept), runs


# What follows is the distributed part. A place is a long: position, bytes before it in its context (8 bits), bytes from it on (9 bits).


def _packed(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return at << 17 | left << 9 | right


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, id and a row number, written once so that the number stays the same."""
    return written(docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row")), "texts")


def anchors(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(anchor, context, row, place) of every anchor of every text."""
    names = ["anchor", "context", "row", "place"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, digest = Anchors(span, gram), xxhash.xxh3_64_intdigest
        for part in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]
            owner, at, hashes, left, right, contexts = [], [], [], [], [], []
            for i, places, found in find.of(texts):
                text = texts[i]
                before, after = np.minimum(places, span - gram), np.minimum(len(text) - places, span)
                owner.append(np.full(len(places), i))
                at.append(places)
                hashes.append(found)
                left.append(before)
                right.append(after)
                contexts += [digest(text[a:b]) - 2**63 for a, b in zip((places - before).tolist(), (places + after).tolist(), strict=True)]
            if owner:
                who = pa.array(np.concatenate(owner))
                places = _packed(*(np.concatenate(x).astype(np.int64) for x in (at, left, right)))
                columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(contexts, pa.int64()), part.column(1).take(who), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(rows.select("text", "row"), run, "anchor long, context long, row long, place long")


def _start() -> Column:
    return F.shiftright("place", 17) - F.shiftright("place", 9).bitwiseAND(255)


def _interval() -> list[Column]:
    return [F.col("row"), _start().alias("start"), (F.shiftright("place", 17) + F.col("place").bitwiseAND(511)).alias("end")]


def _places() -> tuple[Column, Column]:
    """The least and the greatest place (row, start) of a group: the same where the group has one place only."""
    where = F.struct("row", _start().alias("start"))
    return F.min(where).alias("low"), F.max(where).alias("high")


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bit table over hashed row numbers: 16 bits a row, between LEAST_BITS and MOST_BITS."""
    bits = min(max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()), MOST_BITS)
    slot = F.pmod(F.xxhash64("row"), F.lit(bits))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table


def _maybe(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """`rows` with a column `maybe`: whether the table has the row's bit."""
    shared, bits = rows.sparkSession.sparkContext.broadcast(table), 64 * len(table)

    @F.pandas_udf("boolean")
    def has(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((shared.value[s >> 6] >> (s & 63)) & 1 == 1)

    return rows.withColumn("maybe", has(F.pmod(F.xxhash64("row"), F.lit(bits))))


def _context_bytes(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes of one copy of each context: (anchor, n, row, place, bytes, hot)."""
    wanted = contexts.groupBy("row").agg(F.collect_list(F.struct("anchor", "n", "place", "hot")).alias("list"))
    texts = _maybe(rows.select("text", "row"), _bloom(contexts.select("row").distinct())).where("maybe").drop("maybe")
    joined = texts.join(wanted, "row").select("text", "row", F.explode("list").alias("x")).select("text", "row", "x.*")
    size = F.shiftright("place", 9).bitwiseAND(255) + F.col("place").bitwiseAND(511)
    return joined.select("anchor", "n", "row", "place", F.substring(F.col("text").cast("binary"), (_start() + 1).cast("int"), size.cast("int")).alias("bytes"), "hot")


def _by_suffixes(contexts: DataFrame, span: int, batch_bytes: int) -> DataFrame:
    """Intervals (row, start, end) of repeated windows among contexts of the same anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def decide() -> pa.RecordBatch:
            out: list[tuple] = []
            document: dict[int, int] = {}
            firsts = [(x[3] >> 17) - (x[3] >> 9 & 255) for x in held]
            places = [(document.setdefault(x[2], len(document)) << 40) + first for x, first in zip(held, firsts, strict=True)]
            found = repeated_windows([x[4] for x in held], span, np.array(places, np.int64), np.array([x[1] > 1 for x in held]))
            for (_, n, row, _, _), first, starts in zip(held, firsts, found, strict=True):
                if n == 1:  # others are repeated as a whole already
                    out += [(row, first + a, first + b) for a, b in covered(starts, span)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= batch_bytes and row[0] != last:
                    yield decide()
                    held.clear()
                    size = 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield decide()

    return map_arrow(contexts.repartition(partitions_of(contexts.sparkSession), "anchor").sortWithinPartitions("anchor"), run, "row long, start long, end long")


def _by_cores(contexts: DataFrame, span: int, gram: int, group: int, batch_bytes: int) -> DataFrame:
    """The same for anchors with very many contexts: groups of windows at like distance that share their core."""
    width = max(1, (span - gram + 1) // 8)
    left, size = F.shiftright("place", 9).bitwiseAND(255).cast("int"), F.octet_length("bytes")
    classes = F.sequence(F.lit(0), F.lit((span - gram) // width))
    rows = contexts.select("*", left.alias("left"), F.explode(classes).alias("class"))
    low = F.col("class") * width - (span - gram)  # of the class's window starts, from the anchor
    first = F.greatest(F.lit(0), low + F.col("left"))
    last = F.least(size - span, low + width - 1 + F.col("left"), F.col("left"))
    rows = rows.select("*", first.alias("first"), last.alias("last"), F.substring("bytes", low + width + F.col("left"), F.lit(span - width + 1)).alias("core")).where("first <= last")
    part = F.substring("bytes", F.col("first") + 1, F.col("last") - F.col("first") + span)
    start = F.shiftright("place", 17) - F.col("left") + F.col("first")
    place = F.shiftleft(start, 17).bitwiseOR(F.octet_length(part).cast("long"))
    subs = rows.select(F.xxhash64("anchor", "class", "core").alias("anchor"), "n", "row", place.alias("place"), part.alias("bytes"))
    subs = written(subs.withColumn("context", F.xxhash64("bytes")), "core-contexts")
    low, high = _places()
    same = subs.groupBy("anchor", "context").agg(F.max("n").alias("n"), low, high, F.min(F.struct("row", "place")).alias("one"), F.min("bytes").alias("bytes"))
    same = written(same.select("anchor", "context", F.when((F.col("n") > 1) | (F.col("low") != F.col("high")), 2).otherwise(1).alias("n"), "one.*", "bytes"), "core-groups")
    whole = subs.where("n = 1").join(same.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(_interval())
    sizes = written(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("least = 1"), "core-sizes")
    undecided = same.join(sizes.select("anchor", (F.col("size") > group).alias("hot")), "anchor").select("anchor", "n", "row", "place", "bytes", "hot")
    found = whole.unionByName(_by_suffixes(undecided.where("NOT hot").drop("hot"), span, batch_bytes))
    return found if sizes.where(F.col("size") > group).isEmpty() else found.unionByName(_by_starts(undecided.where("hot"), span))


def _by_starts(contexts: DataFrame, span: int) -> DataFrame:
    """The same for groups that stay too large: window starts meet by the digest of their window."""
    starts = contexts.select("n", "row", _start().alias("first"), "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - span)).alias("at"))
    starts = starts.select("n", "row", (F.col("first") + F.col("at")).alias("start"), F.sha2(F.substring(F.col("bytes"), F.col("at") + 1, F.lit(span)), 256).alias("window"))
    starts = written(starts, "window-starts")
    place = F.struct("row", "start")
    twice = starts.groupBy("window").agg(F.max("n").alias("most"), F.min(place).alias("low"), F.max(place).alias("high")).where("most > 1 OR low != high").select("window")
    # A window may start in very many places: both sides meet in SALTS parts of it.
    once = starts.where("n = 1").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return once.join(salted, ["window", "salt"], "left_semi").select("row", "start", (F.col("start") + span).alias("end"))


def repeated_intervals(rows: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP, batch_bytes: int = BATCH, part: int = PART) -> DataFrame:
    """Intervals (row, start, end) that cover exactly the bytes in repeated windows."""
    with rows_per_batch(rows.sparkSession, TEXTS):
        found = written(anchors(rows, span, gram), "anchors")
    low, high = _places()
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.min("context").alias("first"), F.max("context").alias("last"), low, high).where("all > 1")
    parts = F.ceil(F.col("all") / part).cast("int")
    shared = written(shared.select("anchor", parts.alias("parts"), (F.col("first") == F.col("last")).alias("uniform"), (F.col("low") != F.col("high")).alias("apart")), "shared-anchors")  # a plain table on this side lets a hot anchor's other side be split
    met = found.join(shared, "anchor").withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.col("parts")).cast("int"))
    met = written(met, "met-anchors")
    mixed = met.where("NOT uniform OR NOT apart")
    fine = written(mixed.groupBy("anchor", "context", "salt", "parts").agg(low, high, F.min(F.struct("row", "place")).alias("one")), "salted-contexts")
    contexts = fine.groupBy("anchor", "context").agg(F.max("parts").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("one").alias("one"))
    contexts = written(contexts.select("anchor", "context", "parts", F.when(F.col("low") != F.col("high"), 2).otherwise(1).alias("n"), "one.*"), "contexts")
    twice = contexts.where("n > 1")
    salted = twice.where("parts = 1").select("anchor", "context", F.lit(0).alias("salt")).unionByName(fine.where("parts > 1").join(twice.where("parts > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("anchor", "context", "salt"))
    whole = met.where("uniform AND apart").unionByName(mixed.join(salted, ["anchor", "context", "salt"], "left_semi").select(met.columns)).select(_interval())
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("least = 1")
    groups = written(groups, "mixed-anchors")
    undecided = written(contexts.join(groups.select("anchor", (F.col("size") > group).alias("hot")), "anchor"), "undecided")
    data = written(_context_bytes(rows, undecided), "context-bytes")
    found = whole.unionByName(_by_suffixes(data.where("NOT hot").drop("hot"), span, batch_bytes))
    return found if undecided.where("hot").isEmpty() else found.unionByName(_by_cores(data.where("hot").drop("hot"), span, gram, group, batch_bytes))


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP, batch_bytes: int = BATCH, part: int = PART, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if asked for)."""
    rows = _rows(docs, id_col, text_col)
    spans = written(repeated_intervals(rows, span, gram, group, batch_bytes, part), "repeats")
    flagged = _maybe(rows, _bloom(spans.select("row").distinct()))
    lists = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = RESULT + (", kept binary" if keep_bytes else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, key, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, runs = cut(data, [(s["start"], s["end"]) for s in spans or ()])
                out.append((key, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns[: 5 + keep_bytes], names=[f.split()[0] for f in schema.split(", ")])

    moved = flagged.where("maybe").select("text", "id", "row")
    joined = moved.join(lists, "row", "left").select("text", "id", "spans")
    kept = [F.col("text").cast("binary").alias("kept")] if keep_bytes else []
    zero = F.lit(0).cast("long")
    rest = flagged.where("NOT maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *kept)
    out = map_arrow(joined, run, schema).unionByName(rest).withColumnRenamed("id", id_col)
    with rows_per_batch(docs.sparkSession, TEXTS):
        return written(out, "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
