"""Spelling variants and license templates against brute force."""

import os
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrail.llm import license_scan, spelling

# --- spelling --------------------------------------------------------------


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def found_variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def typos(spark):
    """Words with edits in all places, chains of forms, accents, and one word of a third of all occurrences."""
    rng = random.Random(11)
    letters = "abcdefgéßñ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(40)] + ["aaaaaaaa", "Straßenbahn", "ÀÀÀÀÀÀÀÀ"]

    def edited(w):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind < 2) :]

    rows, hot = [], "Frequently"
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 3 + i % 40])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                w = edited(w)
            words += [w, rng.choice(["-", " ", "\n", "1", "×"]), hot if rng.random() < 0.5 else "kurz", " "]
        rows.append((i, "".join(words)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (4, None), (5, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_variants_by_brute_force(typos):
    rows, df = typos
    want = brute_variants(brute_words(rows))
    assert found_variants(spelling.variants(spelling.words(df))) == want
    assert sum(w[1] is not None for w in want) > 50 and max(w[4] for w in want) > 5


def test_chains_of_forms(spark):
    counts = {"variant": 2, "variantx": 20, "variantxy": 200, "variantxyz": 2000, "wariantxyz": 1999, "xariantxyz": 2000, "lonelyword": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_variants(spelling.variants(df)) == brute_variants(counts)
    assert dict((r.word, r.root) for r in spelling.variants(df).collect())["variant"] == "variantxyz"


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeéàÿ×", min_size=7, max_size=12), st.integers(0, 11), st.sampled_from("abzàÿ"), st.integers(0, 2))
def test_an_edit_keeps_a_band(word, at, letter, kind):
    at %= len(word)
    other = word[:at] + (letter if kind else "") + word[at + (kind < 2) :]

    def mask(w):
        m = 0
        for c in w:
            m ^= 1 << (spelling.BIT_ORDER.index(c) if "a" <= c <= "z" else len(spelling.BIT_ORDER) + ord(c) % 4)
        return m

    assert any((mask(word) ^ mask(other)) & spelling.band(b) == 0 for b in range(3))
    assert sum(spelling.band(b) for b in range(3)) == 2**30 - 1


def test_parity_column(spark):
    df = spark.createDataFrame([("aabbc",), ("éé",), ("zé",), ("",)], "w string").select(spelling.parity(F.col("w")).alias("m"))
    bit = spelling.BIT_ORDER.index
    assert [r.m for r in df.collect()] == [1 << bit("c"), 0, 1 << bit("z") | 1 << (26 + ord("é") % 4), 0]


def test_spelling_awkward(spark, awkward, no_rows, folder):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found_variants(spelling.variants(spelling.words(awkward))) == brute_variants(brute_words(rows))
    long = spark.createDataFrame([(1, "q" * 50_000 + " " + "q" * 50_001), (2, "q" * 50_000 + " " + "q" * 50_001)], "doc_id long, text string")
    assert [r.n_near for r in spelling.variants(spelling.words(long)).collect()] == [1, 1]
    assert spelling.op11_parity_bands(spark, folder(no_rows)).count() == 0


def test_spelling_against_sql(spark, sf, same_rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents.parquet')}'")
    same_rows(spelling.op11_parity_bands(spark, sf).toPandas(), con.sql(spelling.OP11_SQL).df())


# --- licenses --------------------------------------------------------------


def as_pattern(template):
    """The template as a pattern over words between single spaces, each word with its space before it."""
    out = []
    for token in re.finditer(r"\[|\]|<[^:<>]*:(\d+)-(\d+)>|[^\[\]<>]+", template):
        if token[0] == "[":
            out.append("(?:")
        elif token[0] == "]":
            out.append(")?")
        elif token[1]:
            out.append(f"(?: [^ ]+){{{token[1]},{token[2]}}}")
        else:
            out += [f" {re.escape(w)}" for w in words_of(token[0])]
    return re.compile("".join(out) + "(?= )")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def brute_places(text, templates):
    words = words_of(text)
    flat = f" {' '.join(words)} " if words else " "
    starts = [i for i, c in enumerate(flat) if c == " "]
    return len(words), {(label, n) for label, template in templates for n, at in enumerate(starts) if as_pattern(template).match(flat, at)}


def filled(template, rng, holders="the authors of it"):
    """A form of the template: some optional regions gone, replaceable ones filled."""
    while (inner := re.search(r"\[([^\[\]]*)\]", template)) is not None:
        template = template[: inner.start()] + (inner[1] if rng.random() < 0.5 else "") + template[inner.end() :]
    return re.sub(r"<[^:]*:(\d+)-(\d+)>", lambda m: " ".join(["a", "b"][: int(m[2])]) if int(m[2]) < 3 else holders, template)


def license_texts():
    rng = random.Random(3)
    texts = [None, "", "-- !! --", "The MIT\nLicense, the MIT license; THE-MIT-LICENSE", "cc by nc nd", "CC-BY-NC 4.0 and Apache License. Version 2 é", "the mit licensed", "Apache License version 20"]
    for label, template in license_scan.TEMPLATES:
        good = filled(template, rng)
        texts += [f"Intro é {label}. {good} -- the end.", good + " " + good]
        words = good.split()
        if len(words) > 8:
            words[len(words) // 2] = "otherwise-worded"
            texts.append(" ".join(words))
    return texts


def test_licenses_by_brute_force(spark):
    texts = license_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        n, base = brute_places(text or "", license_scan.BASE)
        _, own = brute_places(text or "", license_scan.TEMPLATES)
        assert rows[i].n_words == n
        assert {(m.label, m.start) for m in rows[i].matches if m.base} == base
        assert {(m.label, m.start) for m in rows[i].matches if not m.base} == own, text
        assert 0 <= rows[i].score <= 1 and (rows[i].score == 1) == bool(base | own)
    assert all(any((label, n) for label, n in brute_places(f"Intro é {t}", license_scan.TEMPLATES)[1]) for t in texts if t and t.startswith("Intro"))


def test_base_places_by_the_contract(spark, folder):
    """Base phrases as the contract lists them, whatever the module holds."""
    texts = ["Under the MIT license; the MIT license", "under\nTHE mit-license, under the mit license", "under an mit license", "the mit license", "Apache License, Version 2.0 under the MIT license", "cc by nc cc-by-nc by nc", "under the mit licenses", None]
    at = folder(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in license_scan.op12_license_templates(spark, at).collect()}
    found = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for _, r in sorted(rows.items())]
    assert found == [(7, 1, 0, 0, "mit"), (8, 2, 0, 4, "mit"), (4, 0, None, None, ""), (3, 0, None, None, ""), (9, 2, 0, 5, "apache-2,mit"), (8, 2, 0, 3, "cc-by-nc"), (4, 0, None, None, ""), (0, 0, None, None, "")]
    assert rows[3].labels == "mit" and rows[0].labels == "mit"  # the method's own


def test_altered_wording_has_no_label():
    scanner, rng = license_scan.Scanner(), random.Random(5)
    mit = filled(next(t for label, t in license_scan.TEMPLATES if label == "mit"), rng)
    assert {m.label for m in scanner.scan(mit)[1]} == {"mit"}
    n, found, score = scanner.scan(mit.replace("sublicense", "relicense"))
    assert not found and 0.1 < score < 1
    _, found, score = scanner.scan(mit.replace("the authors of it", " ".join(["word"] * 31)))
    assert not found and score < 1
    _, found, _ = scanner.scan(mit.replace("the authors of it", " ".join(["be liable"] * 15)))
    assert [m.label for m in found] == ["mit"]


def test_markup():
    one = license_scan.Automaton("x", "alpha [beta [gamma]] <gap:1-3> delta")
    run = lambda words: one.run(iter(words.split()), 0)[0]
    assert run("beta gamma x delta") == 5 and run("x delta") == 3 and run("delta") is None and run("delta delta") == 3
    assert run("beta x y z delta") == 6 and run("x y z v delta") is None and run("gamma y delta delta") == 5
    with pytest.raises(ValueError):
        license_scan.Automaton("x", "[beta] alpha")
    with pytest.raises(ValueError):
        license_scan.Automaton("x", "alpha [beta")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=30), st.sampled_from(["a [b] c", "a <g:0-4> c", "a [b [c]] <g:1-2> d", "a b", "a <g:2-5> b [<h:0-2> d]", "a [a] [a] b"]))
def test_automata_against_patterns(words, template):
    text = " ".join(words)
    scanner = license_scan.Scanner((), (("x", template),))
    assert {("x", m.start) for m in scanner.scan(text)[1]} == brute_places(text, (("x", template),))[1]


@pytest.mark.parametrize("unit", ["permission is hereby granted free of charge to any ", "redistribution and use in source ", "the mit license ", "word ", "! ", "spdx license identifier mit "])
def test_scan_is_linear(unit):
    scanner = license_scan.Scanner()
    began = time.perf_counter()
    scanner.scan(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 8


def test_license_query(spark, awkward, no_rows, folder, sf):
    at = folder(awkward)
    assert license_scan.op12_license_templates(spark, at).count() == awkward.count()
    assert license_scan.scan(no_rows).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = license_scan.op12_license_templates(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, base = brute_places(texts[r.doc_id] or "", license_scan.BASE)
        starts = [s for _, s in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({b for b, _ in base})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        stands = "gnu general public license version 3" in " ".join(words_of(texts[r.doc_id] or ""))
        assert ("gpl-3" in r.labels.split(",")) == stands
