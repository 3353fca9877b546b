"""Byte-level BPE encoding and decoding (operator 2) on length-bucketed padded matrices.

A text is split by the tokenizer's pattern. Pieces not met before are encoded together:
they are sorted into buckets of like byte length, each bucket becomes a padded matrix of
token ids, and in every round each row merges its leftmost pair of least rank. Ranks of all
adjacent pairs are looked up at once in an open-addressing hash table, and rows close up
over the merged places. Rows without a mergeable pair leave the matrix. A row too long for
a bucket takes its pairs from a queue by (rank, place) instead, so that a piece of a megabyte,
as text without spaces is, costs n log n.

Memory is bounded: a fixed number of pieces and bytes a matrix, a memo of pieces in two
generations of which the older goes when their bytes are too many, texts of one slice (bounded in bytes)
at a time, each distinct text of a slice once. The rank file is read on the driver; what
tasks get is its tables, a few MB for any input.

Defined results: null text is empty text (no tokens); ids and bytes of equal texts are equal;
repeated rows are all returned; an empty input gives an empty result; only id and text are
read. Decoding joins the ids' bytes and gives back the text's UTF-8 exactly.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Merged rank by pair of ids, open addressing in numpy arrays."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for r, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, ranks = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of several keys for a free slot one stays
            placed = self.keys[slot] == left
            self.values[slot[placed]] = ranks[placed]
            left, ranks, slot = left[~placed], ranks[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; where a or b is -1 or the pair does not merge, a number above all ranks."""
        keys = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        real = np.nonzero((a.ravel() >= 0) & (b.ravel() >= 0))[0]
        out = np.full(len(keys), _NONE, np.int32)
        keys = keys[real]
        slot = self._slot(keys)
        while len(real):
            held = self.keys[slot]
            hit = held == keys
            out[real[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            real, keys, slot = real[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(a.shape)


class ByteBpe:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, memo: int = 64_000_000, bucket: int = 256, cells: int = 1 << 18):
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.pairs = PairTable(tokens)
        self.of_byte = np.zeros(256, np.int32)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.of_byte[t[0]] = i
        self.whole = {t: i for i, t in enumerate(tokens)}
        #: Pieces met since the memo was last full, and those met before that, which come back when met again.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most, self.held, self.bucket, self.cells = memo // 2, 0, bucket, cells

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = {t: self.find(t) for t in dict.fromkeys(texts)}
        new = {p for pieces in split.values() for p in pieces if p not in self.memo}
        if self.held + self._cost(new) > self.most:
            self.old, self.memo, self.held = self.memo, {}, 0
            new = {p for pieces in split.values() for p in pieces}
        self.held += self._cost(new)
        known = new & self.old.keys()
        self.memo.update((p, self.old[p]) for p in known)
        self._learn(sorted(new - known))
        get = self.memo.__getitem__
        found = {t: b"".join(map(get, pieces)) for t, pieces in split.items()}
        return [found[t] for t in texts]

    @staticmethod
    def _cost(pieces: set[str]) -> int:
        """About the bytes that the memo needs for the pieces: ids take up to four for one of text."""
        return sum(map(len, pieces)) * 5 + 200 * len(pieces)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        todo: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            known = self.whole.get(b)
            if known is not None:
                self.memo[pieces[i]] = known.to_bytes(4, "little")
            elif len(b) <= self.bucket:
                todo.setdefault((len(b) + 3) // 4 * 4, []).append(i)
            else:
                self.memo[pieces[i]] = self._long(b).astype("<u4").tobytes()
        for width, which in sorted(todo.items()):
            step = max(1, self.cells // width)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                for i, ids in zip(part, self._matrix([raw[i] for i in part], width), strict=True):
                    self.memo[pieces[i]] = ids

    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        cells = np.full((len(rows), width), -1, np.int32)
        cells[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.pairs.ranks(cells[:, :-1], cells[:, 1:])
        done: list[bytes] = [b""] * len(rows)
        live = np.arange(len(rows))
        while True:
            place = ranks.argmin(axis=1)  # the first of equal minima
            best = ranks[np.arange(len(live)), place]
            over = best == _NONE
            if over.any():
                for i, ids in zip(live[over].tolist(), cells[over], strict=True):
                    done[i] = ids[ids >= 0].astype("<u4").tobytes()
                on = ~over
                live, cells, ranks, place, best = live[on], cells[on], ranks[on], place[on], best[on]
            if not len(live):
                return done
            row = np.arange(len(live))
            keep = np.ones(cells.shape, bool)
            cells[row, place] = best
            keep[row, place + 1] = False
            cells = cells[keep].reshape(len(live), -1)
            gap = np.ones(ranks.shape, bool)
            gap[row, place] = False  # the merged pair's rank goes; its neighbours' are looked up anew
            ranks = ranks[gap].reshape(len(live), -1)
            if not ranks.shape[1]:
                ranks = np.full((len(live), 1), _NONE, np.int32)
                continue
            for shift in (-1, 0):
                pair = place + shift
                ok = (pair >= 0) & (pair < ranks.shape[1])
                ranks[row[ok], pair[ok]] = self.pairs.ranks(cells[row[ok], pair[ok]], cells[row[ok], pair[ok] + 1])
            longest = int((cells >= 0).sum(axis=1).max())
            if longest < cells.shape[1] // 2:  # compaction of the padding
                cells, ranks = np.ascontiguousarray(cells[:, : longest + 1]), np.ascontiguousarray(ranks[:, :longest])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: pairs in order of (rank, place), from the sorted pairs of
        its bytes and a heap of those that merges open; places form a linked list."""
        n = len(piece)
        start = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.ranks(start[:-1], start[1:])
        place = np.nonzero(ranks != _NONE)[0]
        first = np.sort(ranks[place].astype(np.int64) * n + place)
        ids, after, before = array("i", start.astype(np.int32).tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        #: The rank of the pair that begins at a place, -1 if none does.
        here = array("i", np.append(np.where(ranks == _NONE, -1, ranks), -1).astype(np.int32).tobytes())
        opened: list[int] = []
        tokens, rank_of = self.tokens, self.whole.get

        def open_pair(left: int, right: int) -> None:
            rank = rank_of(tokens[ids[left]] + tokens[ids[right]])
            here[left] = -1 if rank is None else rank
            if rank is not None:
                heappush(opened, rank * n + left)

        def pairs() -> Iterator[int]:
            for k in range(0, len(first), 65536):
                for key in first[k : k + 65536].tolist():
                    while opened and opened[0] < key:
                        yield heappop(opened)
                    yield key
            while opened:
                yield heappop(opened)

        for key in pairs():
            rank, at = divmod(key, n)
            if here[at] != rank:
                continue  # one of the two is part of another token by now
            gone = after[at]
            ids[at], here[gone] = rank, -1
            right, left = after[gone], before[at]
            after[at] = right
            if right < n:
                before[right] = at
                open_pair(at, right)
            else:
                here[at] = -1
            if left >= 0:
                open_pair(left, at)
        return np.frombuffer(ids, np.int32)[self._heads(after)]

    @staticmethod
    def _heads(after: array) -> list[int]:
        found, at = [], 0
        while at < len(after):
            found.append(at)
            at = after[at]
        return found


@lru_cache(maxsize=2)
def _coder(tokens: tuple[bytes, ...], pattern: str) -> ByteBpe:
    return ByteBpe(list(tokens), pattern)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (binary, little-endian unsigned 32-bit), decoded (binary)."""
    return _mapped(docs, path, pattern, id_col, text_col, "id long, ids binary, decoded binary", lambda ids, back: {"ids": ids, "decoded": back}).withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay in the task."""
    sha = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]
    digest = lambda ids, back: {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": sha(ids), "decoded_sha256": sha(back)}
    return _mapped(docs, path, pattern, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest).withColumnRenamed("id", id_col)


def _mapped(docs, path, pattern, id_col, text_col, schema, finish) -> DataFrame:
    tokens, pattern = tuple(read_ranks(path or default_path())), pattern or default_pattern()
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def make():
        coder = _coder(shared.value, pattern)

        def apply(texts: list, columns: dict) -> dict:
            ids = coder.encode(texts)
            return {"id": columns["id"]} | finish(ids, [coder.decode(x) for x in ids])

        return apply

    return map_texts(docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id")), make, schema, rows=512)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, lang, source, n_tokens, ids (array of int) and decoded_sha256 of every row of `docs`.

    Null and empty texts have no ids; repeated rows, as the mix makes them, are all returned. Copies
    of a text that lie next to each other, as the mix writes them, are split and encoded once.
    """
    tokens, pattern = tuple(read_ranks(default_path())), default_pattern()
    shared = spark.sparkContext.broadcast(tokens)

    def make():
        coder = _coder(shared.value, pattern)

        def apply(texts: list, columns: dict) -> dict:
            ids = coder.encode(texts)
            digest = {x: hashlib.sha256(coder.decode(x)).hexdigest() for x in set(ids)}
            ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return {n: columns[n] for n in ("doc_id", "lang", "source")} | {"n_tokens": np.diff(ends), "ids": lists, "decoded_sha256": [digest[x] for x in ids]}

        return apply

    rows = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return map_texts(rows, make, "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded_sha256 string", rows=512)
