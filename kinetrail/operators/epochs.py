"""Shuffled epochs without sorting: a keyed permutation of sample numbers.

`shuffled` maps a position in an epoch to the number of the sample that stands there, `place_of` a
sample to its position. Each is an expression over one number, so a batch's members follow from
(seed, epoch, batch) alone, and dealing a table to batches needs no exchange on an order key.

The permutation swaps or not: in each round a number x has the partner (key - x) mod n, and the
pair, of which the larger stands for both, is swapped if a bit drawn from it is set. Any round is its own
inverse and a bijection for every n, so nothing has to walk until it falls below n.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Mersenne prime: products of two numbers below it fit a long.
PRIME = 2**31 - 1
ROUNDS = 48

Key = tuple[int, int, int]


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[Key]:
    """(key, factor, addend) of each round."""

    def drawn(i: int) -> Key:
        digest = hashlib.sha256(f"{seed}:{epoch}:{i}".encode()).digest()
        part = lambda at: int.from_bytes(digest[at : at + 8], "big")
        return part(0) >> 2, 1 + part(8) % (PRIME - 1), part(16) % PRIME

    return [drawn(i) for i in range(rounds)]


def _through(number: Column, n: Column, keys: list[Key]) -> Column:
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("kab", key, strict=True)]) for key in keys])

    def turn(x: Column, key: Column) -> Column:
        partner = F.pmod(key["k"] - x, n)
        drawn = (F.greatest(x, partner) % PRIME * key["a"] + key["b"]) % PRIME
        return F.when(drawn < PRIME // 2, partner).otherwise(x)

    return F.aggregate(rounds, number.cast("long"), turn)


def _count(n: Column | int) -> Column:
    return n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")


def shuffled(position: Column, n: Column | int, keys: list[Key]) -> Column:
    """The number of the sample at a position, both in [0, n)."""
    return _through(position, _count(n), keys)


def place_of(number: Column, n: Column | int, keys: list[Key]) -> Column:
    """The position of a sample: the inverse of `shuffled`."""
    return _through(number, _count(n), keys[::-1])


def members(n: int, batch_size: int, batch: int, seed: int, epoch: int) -> list[int]:
    """The sample numbers of one batch, in order; the last batch may be smaller."""
    keys, found = round_keys(seed, epoch), []
    for x in range(batch * batch_size, min(n, (batch + 1) * batch_size)):
        for k, a, b in keys:
            partner = (k - x) % n
            x = partner if (max(x, partner) % PRIME * a + b) % PRIME < PRIME // 2 else x
        found.append(x)
    return found


def epoch_batches(samples: DataFrame, n: Column | int, batch_size: int, seed: int, epoch: int, number: str = "number") -> DataFrame:
    """`samples` (with their number in [0, n)) with batch_id and batch_pos of a shuffled epoch; narrow."""
    place = place_of(F.col(number), n, round_keys(seed, epoch))
    return samples.withColumn("_place", place).withColumns({"batch_id": F.floor(F.col("_place") / batch_size).cast("long"), "batch_pos": (F.col("_place") % batch_size).cast("int")}).drop("_place")
