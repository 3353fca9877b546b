"""Language identification with hyperdimensional profiles (operator 1).

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. A
trigram of letters (lower case, runs of other characters are one space) is bound: the
vectors of its letters, permuted by their place, multiplied element by element. A text is
the bundle (sum) of its trigrams' vectors, a language the bundle of its training texts.
A text gets the language whose prototype has the largest cosine with it, where the mean of
the languages' unit prototypes is taken off each prototype, so that what all languages share
does not count.

Sums are whole numbers held exactly, so neither batch sizes nor task order change a result.
Tasks return one vector per language; what reaches the driver is languages x dimensions.

Defined results: null texts and texts without a letter are `und` with score 0, as is all
where no language was learned; ties go to the language first in code point order; repeated
rows are all returned; null lang never trains; an empty input gives an empty result; only
id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, map_texts, slices, text_or_empty

DIMENSIONS = 1024
GRAM = 3
SEED = 11
UNKNOWN = "und"
#: A list of languages beyond this is taken for a mistaken column; prototypes go to every task.
MOST_LANGUAGES = 4096


class Encoder:
    """Bundles of trigram vectors for slices of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.row_of = np.full(0x110000, -1, np.int32)
        self.letters = np.zeros((0, dimensions), np.int8)
        self.alpha = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)
        self._letter_rows(np.array([32]))

    def _letter_rows(self, points: np.ndarray) -> np.ndarray:
        new = points[self.row_of[points] < 0]
        if len(new):
            new = np.unique(new)
            vectors = [np.random.default_rng([self.seed, int(p)]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for p in new]
            self.row_of[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, np.array(vectors, np.int8)])
            self.rolled = [np.roll(self.letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        return self.row_of[points]

    def _points(self, text: str) -> np.ndarray:
        """Letter rows of the text: lower case, other runs as one space (row 0), a space at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        some = points[~self.seen[points]]
        if len(some):
            for p in np.unique(some).tolist():
                self.seen[p], self.alpha[p] = True, chr(p).isalpha()
        points = np.where(self.alpha[points], points, 32)
        points = np.concatenate(([32], points, [32]))
        keep = (points != 32) | np.concatenate(([True], points[:-1] != 32))
        return self._letter_rows(points[keep])

    def bundle(self, texts: list[str | None], into: np.ndarray | None = None, groups: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bundles, trigram counts) per text, or per group if `into` gives each text's group."""
        into = np.arange(len(texts)) if into is None else into
        groups = len(texts) if groups is None else groups
        rows = [self._points(t) if t else np.zeros(1, np.int32) for t in texts]
        letters = [r if (r != 0).any() else r[:0] for r in rows]
        sizes = np.array([max(0, len(r) - GRAM + 1) for r in letters])
        sums, total = np.zeros((groups, self.dimensions)), np.bincount(into, weights=sizes, minlength=groups)
        if not sizes.sum():
            return sums, total
        base = np.int64(len(self.letters))
        grams = np.concatenate([(r[:-2] * base + r[1:-1]) * base + r[2:] for r in (x.astype(np.int64) for x in letters if len(x) >= GRAM)])
        owner = np.repeat(into, sizes)
        if base**3 <= 1 << 22:  # few letters: a table instead of a sort
            unique = np.nonzero(np.bincount(grams, minlength=int(base**3)))[0]
            table = np.empty(int(base**3), np.int32)
            table[unique] = np.arange(len(unique))
            which = table[grams]
        else:
            unique, which = np.unique(grams, return_inverse=True)
        for at in range(0, len(unique), 4096):
            block = unique[at : at + 4096]
            inside = slice(None) if len(unique) <= 4096 else (which >= at) & (which < at + 4096)
            counts = np.bincount(owner[inside] * len(block) + which[inside] - at, minlength=groups * len(block)).reshape(groups, len(block))
            vectors = self.rolled[0][block // (base * base)] * self.rolled[1][block // base % base] * self.rolled[2][block % base]
            kind = np.float32 if counts.sum() < 1 << 24 else np.float64  # whole numbers stay exact
            sums += counts.astype(kind) @ vectors.astype(kind)
        return sums, total


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes, from all rows with a language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in slices(batches, 64):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            group = {x: i for i, x in enumerate(names)}
            vectors, _ = encoder.bundle(batch.column(0).to_pylist(), np.array([group[x] for x in langs]), len(names))
            for name, v in zip(names, vectors, strict=True):
                sums[name] = sums.get(name, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    parts = docs.where(F.col(lang_col).isNotNull()).select(text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = map_arrow(parts, run, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value")))["value"].alias("vector")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), dimensions)
    norms = np.linalg.norm(vectors, axis=1)
    langs, vectors = [x for x, n in zip(langs, norms, strict=True) if n], vectors[norms > 0] / norms[norms > 0][:, None]
    return langs, vectors


def scorer(langs: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> Callable[[list[str | None]], tuple[list[str], np.ndarray, np.ndarray]]:
    """Languages, scores (largest cosine, 0 to 1) and numbers of trigrams (0 without a letter)."""
    encoder = Encoder(dimensions, seed)
    centred = prototypes
    if len(langs) > 1:
        centred = prototypes - prototypes.mean(axis=0)
        centred = centred / np.maximum(np.linalg.norm(centred, axis=1), 1e-12)[:, None]

    def score(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        sums, grams = encoder.bundle(texts)
        known = grams > 0
        if not langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), grams
        norms = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
        best = (sums @ centred.T / norms[:, None]).argmax(axis=1)
        cosine = np.einsum("ij,ij->i", sums, prototypes[best]) / norms
        return [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(cosine, 0, 1), 0.0), grams

    return score


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, lang_pred, score. Learns from `train` (default: all of `docs`)."""
    langs, prototypes = learn(docs if train is None else train, text_col, lang_col, dimensions, seed)

    def make():
        score = scorer(langs, prototypes, dimensions, seed)

        def apply(texts: list, columns: dict) -> dict:
            names, values, _ = score(texts)
            return {"id": columns["id"], "lang_pred": names, "score": values}

        return apply

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return map_texts(rows, make, "id long, lang_pred string, score double", rows=64).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A text with so many trigrams is judged by its profile in the pipeline, a shorter one is not.
ENOUGH_GRAMS = 32
#: Deviations of the cosine of a random vector (1 / sqrt(dimensions)) that a judged text has to reach.
DEVIATIONS = 2.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that stay, with a null lang replaced by the predicted one.

    Languages are learned as in op1. A row goes if its text has no letter, or if its lang is null
    and its text, of at least ENOUGH_GRAMS trigrams, is no nearer to any learned language than
    DEVIATIONS deviations of a random vector's cosine: it is in none of them. Shorter texts give too
    little evidence and stay. Where no language was learned, only texts without a letter (null and
    empty ones too) go and a null lang stays null. Rows that repeat are judged alike; a lang that is
    there is taken as known, stays as it is and keeps its row.
    """
    langs, prototypes = learn(docs.where(~held_out()))
    columns = [c for c in docs.columns if c not in ("text", "lang")]
    arranged = docs.select("text", F.col("lang").cast("string").alias("lang"), *columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(langs, prototypes)
        for batch in slices(batches, 64):
            names, values, grams = score(batch.column(0).to_pylist())
            stays = grams > 0
            if langs:
                given = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
                stays &= given | (grams < ENOUGH_GRAMS) | (values >= DEVIATIONS / DIMENSIONS**0.5)
            known = pa.array([None if n == UNKNOWN else n for n in names], pa.string())
            filled = pc.coalesce(batch.column(1).cast(pa.string()), known)
            yield batch.set_column(1, batch.schema.field(1), filled.cast(batch.schema.field(1).type)).filter(pa.array(stays))

    return map_arrow(arranged, run, arranged.schema).select(docs.columns)
