"""Spelling variant grouping by letter-parity bitmask bands (operator 11), DataFrame operations only.

1. Words: the maximal letter runs of every text, counted with partial aggregation on the map side.
2. Masks: bit by bit whether a letter stands an odd number of times. One inserted or deleted
   letter flips one bit, a replaced one at most two, so of three bands of the mask one is equal.
3. Join on equal bands with the length filter: a word meets words of its own length and of one
   more. Since one edit also leaves the first or the second half of the shorter word in place,
   that half is part of the join key, which keeps the groups small however large the vocabulary
   gets. A pair is kept only in the first band and half that it shares, so no pairs need to be
   made distinct; masks are compared before the words are.
4. A word's form is its most frequent near word, if that is at least ten times as frequent;
   counts grow tenfold along a chain of forms, so chains are short, and pointer doubling ends them.

The planted noise of the contract (a code point deleted from one run in 31, chosen by crc32) is
`noise`; `variants` works on any counted words.

Defined results: null and empty texts have no words; a null doc_id is the empty text in the
hashed key; repeated rows count again; ties between forms go to the smallest word in code-point
order; very long runs are words like any other; an empty input gives an empty result; only id
and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points of a word, least occurrences, how many times as frequent a form is, one noisy run in so many.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, NOISE = 7, 2, 10, 31
BANDS = 3
#: Letters by falling frequency, so that dealing them to the bands in turn gives these like entropy.
#: All other code points share the four bits above.
BIT_ORDER = "etaoinsrhldcumfpgwybvkxjqz"
_OTHERS = 4


def lower_ascii(column: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def noise(run: Column, doc_id: Column, one_in: int = NOISE) -> Column:
    """The run, without one code point where `one_in` divides the hash of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, count: int = LEAST_COUNT, one_in: int = NOISE) -> DataFrame:
    """word, n: the letter runs after the noise, of at least so many code points and occurrences."""
    # Shorter runs cannot become words; a match of so many or more is a maximal run.
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{length},}}"), F.lit(0))).alias("run"))
    made = runs.select(F.col("id"), lower_ascii(F.col("run")).alias("run")).select(noise(F.col("run"), F.col("id"), one_in).alias("word"))
    return made.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def parity(word: Column) -> Column:
    """The mask: bits of the letters that stand an odd number of times."""
    bit = lambda c: F.when(c.between("a", "z"), F.instr(F.lit(BIT_ORDER), c) - 1).otherwise(len(BIT_ORDER) + F.ascii(c) % _OTHERS)
    return F.aggregate(F.split(word, ""), F.lit(0), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), bit(c).cast("int")))))


def band(b: int) -> int:
    return sum(1 << i for i in range(b, len(BIT_ORDER) + _OTHERS, BANDS))


def _half(word: Column, shorter: Column, side: int) -> Column:
    """The first or the second half of a word, cut as the shorter word of a pair is."""
    first = F.floor(shorter / 2).cast("int")
    return F.substring(word, F.lit(1), first) if side == 0 else F.substring(word, F.char_length(word) - (shorter - first) + 1, shorter - first)


def _places(vocabulary: DataFrame, shorter: list[Column]) -> DataFrame:
    """word, n, mask, len, and one row for each place (band, half and length of the pair's shorter word) with its key."""
    place = lambda length, b, side: F.struct(
        F.xxhash64(length, F.lit(b), F.lit(side), F.col("mask").bitwiseAND(band(b)), _half(F.col("word"), length, side)).alias("key"), F.lit(2 * b + side).alias("place")
    )
    return vocabulary.select("*", F.inline(F.array(*[place(x, b, s) for x in shorter for b in range(BANDS) for s in (0, 1)])))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: the words that differ by exactly one edit, each pair once. `vocabulary`: word, n."""
    masked = vocabulary.select("word", "n", F.char_length("word").alias("len"), parity(F.col("word")).alias("mask"))
    named = lambda df, suffix: df.select("key", "place", *[F.col(c).alias(f"{c}_{suffix}") for c in ("word", "n", "len", "mask")])
    a, b = named(_places(masked, [F.col("len")]), "a"), named(_places(masked, [F.col("len"), F.col("len") - 1]), "b")
    flipped = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    differ = [flipped.bitwiseAND(band(i)) != 0 for i in range(BANDS)]
    prefix = lambda w: F.substring(F.col(w), F.lit(1), F.floor(F.col("len_a") / 2).cast("int"))
    #: The pair's first shared band and half.
    first = 2 * F.when(~differ[0], 0).when(~differ[1], 1).otherwise(2) + F.when(prefix("word_a") == prefix("word_b"), 0).otherwise(1)
    lengths = (F.col("len_b") == F.col("len_a") + 1) | (F.col("len_b") == F.col("len_a")) & (F.col("word_a") < F.col("word_b"))
    found = a.join(b, ["key", "place"]).where(lengths & (F.bit_count(flipped) <= 2) & (F.col("place") == first))
    found = found.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return found.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of `forms` (word, form): the end of its chain. Pointers double each round."""
    ends = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = ends.join(further, "root", "left")
        moved = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def variants(vocabulary: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `vocabulary` (word, n; words are distinct)."""
    vocabulary = written(vocabulary.select("word", "n"), "spelling-words")
    near = near_pairs(vocabulary).select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= times * F.col("n")
    named = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    named = written(named, "spelling-forms")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(documents(spark, sf_dir)))


#: The same by deletion neighbourhoods: near words are equal after one deletion at one place, or one is the other's deletion.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, k, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM counted
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
), noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, rest FROM cut JOIN words w ON w.word = rest
  UNION SELECT rest, cut.word FROM cut JOIN words w ON w.word = rest
), ranked AS (
  SELECT near.word, other, m.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY m.n DESC, other) AS place
  FROM near JOIN words m ON m.word = other
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
), chain AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT chain.word, f.form FROM chain JOIN forms f ON f.word = chain.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""
