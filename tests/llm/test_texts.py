"""Language, tokens, sketches, pages, repeats, personal data and near duplicates against brute force."""

import base64
import binascii
import hashlib
import html
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from kinetrail.llm import byte_bpe, common, html_text, language_id, pii, simhash, sketch, suffix_dedup


def texts_of(df):
    rows = df.select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


# --- tokens ----------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(byte_bpe.default_path()), byte_bpe.default_pattern())


def test_ids_equal_the_library(coder, reference):
    rng = random.Random(1)
    cases = ["", "a" * 3000, "ab" * 2000, "\n" * 600 + "x", " " * 999, "é" * 700, "的" * 300 + "漢字", "\u0000\x1f😀" * 100, "don't I'LL we've"]
    cases += ["".join(rng.choice("abcdeétion 12,\n的") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    cases += ["".join(rng.choice("abtioné") for _ in range(rng.randint(257, 3000))) for _ in range(20)]
    for text, ids in zip(cases, coder.encode(cases), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他", "a", "theingtion", "ABCdef+/0123456789"])
def test_long_pieces(coder, reference, unit):
    rng = random.Random(3)
    for n in (1_000, 30_000, 300_000):
        text = "".join(rng.choice(unit) for _ in range(n // len(unit[0].encode())))
        began = time.perf_counter()
        ids = coder.encode([text])[0]
        took = time.perf_counter() - began
        if n < 100_000 or len(set(text)) > 1:
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    assert took < 6


def test_memo_is_bounded(reference):
    small = byte_bpe.ByteBpe(byte_bpe.read_ranks(byte_bpe.default_path()), byte_bpe.default_pattern(), memo=12_000, cells=64)
    for n in range(40):
        text = " ".join(f"word{n}x{i}" for i in range(20))
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
        assert small.held <= 24_000 and len(small.memo) <= 120
    assert small.encode(["x" * 9000, "y z", "x" * 9000])[0] == small.encode(["x" * 9000])[0] and small.held == small._cost({"x" * 9000})


def test_token_query(spark, awkward, no_rows, reference):
    rows = byte_bpe.token_digests(awkward).collect()
    assert len(rows) == 9
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in rows:
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    full = byte_bpe.encode_decode(awkward).where("doc_id = 7").first()
    assert bytes(full.decoded).decode() == texts[7]
    assert byte_bpe.token_digests(no_rows).count() == 0


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 500, "c" * 10, "", "d" * 30, "e" * 30])], names=["text"])
    assert [p.num_rows for p in common.slices([batch], 3, 60)] == [2, 1, 3, 1]
    assert sum((p.to_pylist() for p in common.slices([batch], 1, 60)), []) == batch.to_pylist()


# --- sketches --------------------------------------------------------------


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketch_query(corpus):
    rows = {r.doc_id: r for r in sketch.edited_likeness(corpus.repartition(5)).collect()}
    texts = texts_of(corpus)
    order, plain = sorted(texts), sketch.Sketcher()
    assert sorted(rows) == order
    for i, key in enumerate(order):
        text, after, r = texts[key], texts[order[(i + 1) % len(order)]], rows[key]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (plain.sketch(t) for t in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (sketch.to_string(a), sketch.to_string(b))
        assert (r.near_edited, r.near_next) == (sketch.likeness(a, b), sketch.likeness(a, c))
        assert np.array_equal(sketch.from_string(r.fingerprint), a)


@pytest.mark.parametrize("same", [False, True])
def test_one_id_for_most_rows(spark, same):
    """Ids null for most rows, whose texts differ or are all equal: whole results, no task with most of them."""
    rows = [(None, "one text for all of them" if same else f"text {i} of so many words {i * i}") for i in range(4000)] + [(i, f"own {i} text") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sketch.edited_likeness(docs).collect()
    hashed = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h, r.text))
    want = []
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(r.text) // 4
        want.append((r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - cut] + after.text[:cut]).encode()).hexdigest()))
    key = lambda x: (x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=key) == sorted(want, key=key)
    sizes = [r["count"] for r in sketch.with_successor(docs).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= (1 if same else 4) and max(sizes) < (100 if same else 2000)


def test_sketch_estimates():
    rng = random.Random(3)
    words = [f"v{i}" for i in range(5000)]
    plain, off = sketch.Sketcher(), []
    for _ in range(30):
        a = [rng.choice(words) for _ in range(3000)]
        b = a[: rng.randint(300, 2900)] + [rng.choice(words) for _ in range(500)]
        x, y = " ".join(a), " ".join(b)
        true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        off.append(sketch.likeness(plain.sketch(x), plain.sketch(y)) - true)
        part = " ".join(a[:400])
        assert sketch.containment(plain.sketch(part), plain.sketch(x)) == 1.0
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_merged_sketch_is_the_sketch_of_both():
    rng, plain = random.Random(4), sketch.Sketcher()
    for _ in range(400):
        a, b = (plain.hashes(" ".join(f"m{rng.randint(0, 30)}" for _ in range(rng.choice([0, 1, 3, 6, 9, 14, 200])))) for _ in range(2))
        both = plain.kept(np.concatenate([a, b]))
        assert np.array_equal(sketch.merge(plain.kept(a), plain.kept(b)), both)
        if len(a) and plain.kept(a)[0] < plain.limit:
            assert sketch.containment(plain.kept(a), both) == 1.0


def test_sketch_awkward(spark, awkward, no_rows):
    rows = sketch.edited_likeness(awkward).collect()
    assert len(rows) == 9 and sketch.edited_likeness(no_rows).count() == 0
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    single = sketch.edited_likeness(awkward.where("doc_id = 7")).first()
    assert single.near_next == 1.0
    assert sketch.fingerprints(awkward).count() == 9


# --- language --------------------------------------------------------------

SAMPLES = {"en": "the and that with this from have they which their would there", "de": "der und nicht mit dem auch sich eine wird noch über für", "fr": "les des dans que pour une avec est pas sont être déjà"}


def test_language_on_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(rng.randint(6, 60))), lang, "s", 0) for i, lang in enumerate(list(SAMPLES) * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = language_id.identify(docs, docs.where(~language_id.held_out())).join(docs.select("doc_id", "lang", language_id.held_out().alias("out")), "doc_id").where("out").collect()
    assert len(found) > 40 and sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97
    again = language_id.identify(docs.repartition(3), docs.repartition(9).where(~language_id.held_out()))
    first = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, docs.where(~language_id.held_out())).collect()}
    assert all(first[r.doc_id] == (r.lang_pred, pytest.approx(r.score)) for r in again.collect())


def test_bundle_against_letters():
    enc = language_id.Encoder(64, 5)
    got, n = enc.bundle(["Ab,  c!", None, "12"])
    letters = {c: enc.letters[enc.row_of[ord(c)]].astype(int) for c in " abc"}
    text, want = " ab c ", np.zeros(64)
    for i in range(len(text) - 2):
        want += np.prod([np.roll(letters[text[i + k]], 2 - k) for k in range(3)], axis=0)
    assert np.array_equal(got[0], want) and n.tolist() == [4, 0, 0] and not got[1:].any()


def test_language_by_its_definition(spark, folder):
    """Bundles, prototypes, cosine and choice again, a letter and a trigram at a time."""
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(rng.randint(1, 9))), lang) for i, lang in enumerate(list(SAMPLES) * 12)] + [(90, "1 2 3", "en"), (91, None, None), (92, "Der Ö", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    letter = lambda c: np.random.default_rng([language_id.SEED, ord(c)]).integers(0, 2, language_id.DIMENSIONS, dtype=np.int8).astype(int) * 2 - 1

    def bundle(text):
        plain = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
        total = np.zeros(language_id.DIMENSIONS)
        if plain.strip():
            for i in range(len(plain) - 2):
                total += np.prod([np.roll(letter(plain[i + k]), 2 - k) for k in range(3)], axis=0)
        return total

    learned = {lang: sum(bundle(t) for i, t, x in rows if x == lang and binascii.crc32(str(i).encode()) % 4 != 2) for lang in sorted(SAMPLES)}
    unit = {k: v / np.linalg.norm(v) for k, v in learned.items()}
    mean = np.mean(list(unit.values()), axis=0)
    found = {r.doc_id: r for r in language_id.op1_language_id(spark, folder(docs)).collect()}
    for i, text, _ in rows:
        v, r = bundle(text), found[i]
        assert r.held_out == (binascii.crc32(str(i).encode()) % 4 == 2)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        near = {k: v @ (u - mean) / np.linalg.norm(u - mean) for k, u in unit.items()}
        best = max(near, key=near.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0.0, v @ unit[best] / np.linalg.norm(v)))


def test_language_awkward(spark, awkward, no_rows, folder):
    rows = {r.doc_id: r for r in language_id.op1_language_id(spark, folder(awkward)).collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (3, 4, 6))
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[5].lang_pred in ("en", "de", "es", "fr")
    stage = language_id.language_stage(spark, awkward, "")
    assert stage.columns == awkward.columns and sorted(str(r.doc_id) for r in stage.collect()) == ["1", "2", "2", "5", "7", "None"]
    assert language_id.identify(no_rows).count() == 0
    unlabelled = language_id.language_stage(spark, awkward.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert sorted(str(r.doc_id) for r in unlabelled) == ["1", "2", "2", "5", "7", "None"] and {r.lang for r in unlabelled} == {None}
    assert {r.lang_pred for r in language_id.identify(awkward, no_rows).collect()} == {"und"}


def test_language_stage_decides(spark):
    """Null languages are filled, texts far from every learned language go, short ones stay."""
    rng = random.Random(21)
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, line(SAMPLES[lang].split(), 40), None if i % 10 == 0 else lang) for i, lang in enumerate(list(SAMPLES) * 40)]
    rows += [(1000, line(["что", "это", "как", "они", "были", "слово", "время"], 60), None), (1001, "это", None), (1002, "12 ...", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stays = {r.doc_id: r.lang for r in language_id.language_stage(spark, docs, "").collect()}
    assert set(stays) == set(range(120)) | {1001}
    assert all(stays[i] == lang for i, lang in enumerate(list(SAMPLES) * 40))


# --- personal data ---------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    finder, rng = pii.Finder(), random.Random(9)
    cases = ["a@b.c@d.e", "x@y", "a@b.c.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111-", "+1 (279) 555-0216.", "++12", "0000.0.0.00255", "é@é.de a_b@c-d.e-f"]
    cases += ["".join(rng.choice("a1@..+ -()@%é9 0") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    for text in cases:
        assert [s for s in finder.spans(text) if s[0] in pii.BASE] == brute_spans(text), text


def test_added_spans():
    text = "my account number: 12345678, IBAN GB82 WEST 1234 5698 7654 32; https://u:p@h.example/x?y mailto:a@b.co http://plain.example account of it"
    spans = pii.Finder().spans(text)
    assert [(k, text[s:e]) for k, s, e in spans if k not in pii.BASE] == [("url", "https://u:p@h.example/x?y"), ("url", "mailto:a@b.co"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("account", "12345678")]
    assert "12345678" not in pii.redact(text, spans) and "[account]" in pii.redact(text, spans)
    bad = "IBAN GB83 WEST 1234 5698 7654 32"
    assert not [s for s in pii.Finder().spans(bad) if s[0] == "iban"]


def iban_of(country, rng):
    body = "".join(rng.choice("0123456789" if country != "GB" or i > 3 else "ABCDEFGH") for i in range(pii.IBAN_LENGTHS[country] - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def labelled(kind, rng):
    """A text and what of it is of the kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n: "a1" + "".join(rng.choice("abcdef0123456789") for _ in range(n - 2))
    word = lambda: rng.choice(["the sum", "see", "und", "voilà", "pay"])
    if kind == "iban":
        code = iban_of(rng.choice(sorted(pii.IBAN_LENGTHS)), rng)
        value = rng.choice([code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))])
        head = rng.choice(["IBAN: ", "iban ", "pay to ", "", "account number ", "(", "Konto "])
    elif kind == "account":
        value = rng.choice([digits(8), digits(12), "X" + digits(7), f"{digits(3)}-{digits(2)}-{digits(4)}"])
        head = rng.choice(["account number: ", "Acct #", "SSN ", "passport no. ", "tax id = ", "Customer ID "])
    elif kind == "secret":
        value = rng.choice([mixed(40), mixed(32).upper(), "sk-" + mixed(24), mixed(20) + "/+" + mixed(16)])
        head = rng.choice(['token = "', "api_key: ", "API key is ", "Authorization: Bearer ", "client_secret='", 'SECRET="'])
        if rng.random() < 0.3:
            value, head = rng.choice(["hunter2!x", "Pa55-wörd", "correct-horse"]), rng.choice(["password: ", "passwd=", 'pwd = "'])
    else:
        value = rng.choice(["https://u:p4ss@db.example.org/x", "mailto:a.b@c.example", "postgres://me:pw@10.0.0.1:5432/db", "tel:+4930123456", "ftp://anna@files.example/a"])
        head = rng.choice(["", "at ", "link=", "("])
    tail = '"' if head.endswith('"') else "'" if head.endswith("'") else ")" if head.endswith("(") and kind == "iban" else rng.choice([",", " and on", "\n", ""])
    if kind == "url":
        tail = rng.choice([" and on", "\n", ""])
    return f"{word()} {head}{value}{tail}", value


@pytest.mark.parametrize("kind", pii.ADDED)
def test_recall_of_added_kinds(kind):
    rng, finder, hits, more = random.Random(kind), pii.Finder(), 0, 0
    for _ in range(400):
        text, value = labelled(kind, rng)
        found = [text[s:e] for k, s, e in finder.spans(text) if k == kind]
        hits += value in found
        more += len(found) - (value in found)
    assert hits >= 0.95 * 400 and more <= 0.02 * 400


def test_added_kinds_leave_plain_text_alone():
    plain = "The token of thanks is a secret: we account for 12 of 345 ids. No password is needed, is it? DE or GB12 KEY 1234567890123456 in the API key section, iban unknown. Passport control took 20 minutes; bearer of news arrived. " * 3
    assert pii.Finder().spans(plain) == []
    code = iban_of("DE", random.Random(1))
    wrong = [code[:-1] + str((int(code[-1]) + 1) % 10), "X" + code, code + "7", code[:10], code.lower()]
    assert not [s for t in wrong for s in pii.Finder().spans(t) if s[0] == "iban"]
    for text in (f"IBAN: {code}", f"iban {code}", f"pay to {code[:4]} {code[4:8]} {code[8:12]} {code[12:16]} {code[16:20]} {code[20:]}", f"account {code}."):
        assert [k for k, _, _ in pii.Finder().spans(text) if k in pii.ADDED] == ["iban"]


def test_personal_data_query(spark, awkward, no_rows, folder):
    docs = awkward.withColumn("text", F.when(F.col("doc_id") == 7, "é mail a.b@c.de 10.0.0.1 ").otherwise(F.col("text")))
    rows = {r.doc_id: r for r in pii.op6_anchor_pii(spark, folder(docs)).collect()}
    assert rows[7].spans == "email:7:15,ip:16:24" and rows[7].base_sha256 == hashlib.sha256(b"email:7:15,ip:16:24").hexdigest()
    assert (rows[7].n_email, rows[7].n_ip, rows[7].n_card, rows[7].n_phone, rows[7].n_spans) == (1, 1, 0, 0, 2)
    assert rows[3].spans == "" and rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_spans(no_rows).count() == 0


ANCHORS = [*pii.SCHEMES, *(f"{t}{g}" for t in pii.TOKENS for g in ("=", " is ", " ", ": x=")), *(f"{c}: " for c in pii.CUES), "@", "a@b", "a@b.", "+", "+1 ", "1.", "1 ", "DE12", "ftp://a:", "https://a@", "secret=a.", "token=1", "pwd a1/"]


@pytest.mark.parametrize("unit", ANCHORS)
def test_spans_are_linear(unit):
    finder = pii.Finder()

    def seconds(size):
        text, took = unit * (size // len(unit)), []
        for _ in range(2):
            began = time.perf_counter()
            finder.spans(text)
            took.append(time.perf_counter() - began)
        return min(took)

    short, long = seconds(50_000), seconds(400_000)
    assert long < 0.8 or long < 16 * short  # eight times the text


@pytest.mark.parametrize("unit", ["secret=", "mailto:", "tel:"])
def test_a_megabyte_of_anchors(unit):
    began = time.perf_counter()
    pii.Finder().spans(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 2


# --- pages -----------------------------------------------------------------


def page(body, around=True):
    if not around:
        return body
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class='cookie-banner'>We use cookies on this site for you.</div><div class=ad>Buy it now while it is cheap and good.</div>{body}<aside>Other things to read today</aside><div id='comments'><article class=comment><p>I liked this text very much, thank you all for it.</p></article></div><form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"


def test_main_text_cases():
    cases = [
        (page("<article><h1>A &amp; B</h1><p>First  one\n here<br>now &eacute;&#233;.</p><p>Short.</p><p>Second paragraph with <b>bold</b> and <a href=x>a link</a> in it.</article>"), "A & B\n\nFirst one here now éé.\n\nShort.\n\nSecond paragraph with bold and a link in it."),
        (page("<div class='content'><h2>Head</h2><p>Long enough text in a plain container, which goes on and on.</p><ul><li>point one of it</li><li>point two</li></ul><p>End.</p></div>"), "Head\n\nLong enough text in a plain container, which goes on and on.\n\npoint one of it\n\npoint two\n\nEnd."),
        (page("<main><div class='share'>Share this</div><p>Main text stands here, with words enough.</p><!-- note --><p>x</p></main>"), "Main text stands here, with words enough.\n\nx"),
        (page("<article><header><h1>Kept title</h1></header><p>Body text of some length follows it.</p><footer>by me</footer></article>"), "Kept title\n\nBody text of some length follows it."),
        (page("<div class='wrap has-sidebar'><article class='post ad-free'><h1>T</h1><p>Text of the article, with words enough to count.</p></article></div>"), "T\n\nText of the article, with words enough to count."),
        (page("<div id=col><h1>T</h1><p>Text in a plain column, with words enough to count.</p><p>Ok.</p></div><div id=other><ul><li><a href=1>One more link</a></li><li><a href=2>Another link</a></li></ul></div>"), "T\n\nText in a plain column, with words enough to count.\n\nOk."),
        ("", ""),
        ("<html><body><nav><a href=x>only menu</a></nav></body></html>", ""),
        ("plain text without any tag", "plain text without any tag"),
        ("<p>unclosed <b>bold<p>next &lt;tag&gt; &amp;amp;", "unclosed bold\n\nnext <tag> &amp;"),
    ]
    for source, want in cases:
        assert html_text.main_text(source) == want, source[:80]
    assert html_text.main_text(None) == ""


LONG = "This paragraph of the story has words enough to stand out, and it goes on for a good while after that."


def test_regions_of_other_templates():
    cases = {
        "two articles": (page(f"<article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG} Again.</p><p>Ok.</p></article>"), f"One\n\n{LONG}\n\nTwo\n\n{LONG} Again.\n\nOk."),
        "story around a small article": (page(f"<main><h1>T</h1><p>{LONG}</p><article><p>Short box text.</p></article><p>{LONG} More.</p><p>End.</p></main>"), f"T\n\n{LONG}\n\nShort box text.\n\n{LONG} More.\n\nEnd."),
        "small card in main": (page(f"<main><article class='card'><a href=x>Card</a></article><div><p>{LONG}</p><p>{LONG}</p></div></main>"), f"{LONG}\n\n{LONG}"),
        "no article": (page(f"<div id=page><div id=story><h1>T</h1><p>{LONG}</p><p>x</p><div><p>{LONG}</p></div></div><div id=links><ul><li><a href=1>More of one</a></li><li><a href=2>More of two</a></li></ul></div></div>"), f"T\n\n{LONG}\n\nx\n\n{LONG}"),
        "body alone": (f"<body><div class=menu><a href=1>A</a></div><h1>T</h1><p>{LONG}</p><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>Five.</p><div>Imprint</div></body>", f"T\n\n{LONG}\n\nOne.\n\nTwo.\n\nThree.\n\nFour.\n\nFive."),
        "heading before the column": (page(f"<h1>T</h1><div class=text><p>{LONG}</p><p>{LONG}</p></div>"), f"T\n\n{LONG}\n\n{LONG}"),
        "header, body and table inside": (page(f"<article><header><h1>T</h1></header><div class=body><p>{LONG}</p><table><tr><td>1<td>2<tr><td>3<td>4</table><ul><li>a<li>b</ul><p>{LONG}</p></div><footer>by</footer></article>"), f"T\n\n{LONG}\n\n1\n\n2\n\n3\n\n4\n\na\n\nb\n\n{LONG}"),
        "comments longer than the text": (page(f"<article><p>{LONG}</p></article><section class=comments>" + f"<div><p>{LONG} I agree.</p></div>" * 4 + "</section>"), LONG),
        "deep link": (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><p><a href=x><b><i><u><s><em><small>{LONG}</small></em></s></u></i></b></a></p></div>", f"{LONG}\n\n{LONG}"),
    }
    for name, (source, want) in cases.items():
        assert html_text.main_text(source) == want, name


def test_clusters_decide(monkeypatch, spark, sf):
    """Masks that leave closed lines closed, so only what the clusters say of open text differs."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    found, rng, real = [html_text.main_text(p) for p in pages], np.random.default_rng(5), html_text.clusters
    is_open = lambda lines: np.array([not line[3] for line in lines])
    for mask, least in ((lambda lines: ~real(lines) & is_open(lines), 0.9), (lambda lines: (rng.random(len(lines)) < 0.5) & is_open(lines), 0.2)):
        monkeypatch.setattr(html_text, "clusters", mask)
        other = [html_text.main_text(p) for p in pages]
        assert sum(a != b for a, b in zip(found, other, strict=True)) > least * len(pages)
    # Without any name or element that tells the article, clusters still find it.
    monkeypatch.setattr(html_text, "clusters", real)
    bare = [html_text.main_text(re.sub("<(/?)(?:article|main|nav|footer|header|aside)\\b[^>]*>", r"<\1div>", re.sub("<div class=[^>]*>", "<div>", p))) for p in pages]
    assert all(a in b for a, b in zip(found, bare, strict=True))  # what is more are lines of prose, as adverts and footers have here
    assert sum(a == b for a, b in zip(found, bare, strict=True)) > 0.5 * len(pages)


NAMES = ["share-prices", "social-history", "comment-policy", "related-work", "notice-period", "subscription-law", "modal-verbs", "cookie-recipe", "banner-making", "navigation-history", "promo-code-review"]


@pytest.mark.parametrize("name", [*NAMES, "socialHistory", "notice", "modal", "widget", "with-sidebar", "comment"])
def test_names_do_not_delete_articles(name):
    body = "\n".join(f"<p>{LONG}</p>" for _ in range(9))
    want = "\n\n".join([LONG] * 9)
    for source in (f"<article><div class='{name}'>{body}</div></article>", f"<article><h1>T</h1><div class='{name}'>{body}</div></article>", f"<div id='{name}'>{body}</div>", f"<div class='{name}'><article>{body}</article></div>", f"<span class='{name}'>{body}</span>"):
        assert html_text.main_text(page(source)).removeprefix("T\n\n") == want, source[:60]
    assert html_text.main_text(page(f"<article><p><span class='{name}'>{LONG}</span></p><p>{LONG}</p></article>")).endswith(LONG)


@pytest.mark.parametrize("name", ["share-buttons", "cookie-banner", "siteFooter", "related-posts", "newsletter-box", "comment-list", "sidebar-left", "ad-slot-2", "menu-items", "post-comments", "skip-link", "social-media-icons"])
def test_parts_are_left_out(name):
    part = f"<div class='{name}'><p>Words of another part of the page, a line of them.</p></div>"
    for source in (f"<article><p>{LONG}</p><p>{LONG}</p>{part}</article>", f"{part}<div id=story><p>{LONG}</p><p>{LONG}</p></div>", f"<article><p>Two words.</p></article>{part}"):
        assert html_text.main_text(page(source)) == ("Two words." if "Two words." in source else f"{LONG}\n\n{LONG}"), source


def test_form_around_the_page():
    assert html_text.main_text(f"<body><form id=all><div><p>{LONG}</p><p>{LONG}</p><button>Go</button></div></form></body>") == f"{LONG}\n\n{LONG}"
    assert html_text.main_text(f"<body><article><p>{LONG}</p><form><label>Your name, please, and your address</label><input></form></article></body>") == LONG


@pytest.mark.parametrize("unit", ["<div>x", "<font>x <p>y</p>", "<li></li><div>z", "<a href=x>q <b>", "<td>c<div>", "<!-- ", "</p><i>", "<article>x", "<?x ", "<a b=\"", "<a "])
def test_work_is_linear(unit):
    def seconds(n: int) -> float:
        began = time.perf_counter()
        html_text.main_text(unit * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 5  # a quadratic parser takes minutes


def test_pages_against_the_article(spark, sf):
    rows = html_text.op4_text_tag_ratio(spark, sf).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(sources)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", "\n"))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_awkward(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, None, None), (None, "u", page("<article><p>Text of it.</p></article>")), (2, "u", deep), (2, "u", deep), (3, "u", "<" * 50_000), (4, "u", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert len(out) == 6 and [r.text for r in out if r.page_id == 2] == ["deep text"] * 2 and [r.n_chars for r in out if r.page_id == 4] == [499_999]
    assert html_text.extract(df.limit(0)).count() == 0


# --- repeats ---------------------------------------------------------------


def brute_removed(texts, span):
    data = [t.encode() for t in texts]
    seen = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                cover[i : i + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_window_order_is_sorted():
    rng = random.Random(4)
    for _ in range(300):
        text = bytes(rng.choice(b"abc\xfe\x00") for _ in range(rng.randint(1, 80)))
        order = suffix_dedup.window_order(text, np.arange(len(text)), 400).tolist()
        keys = [text[i:] + b"\xff" * 500 for i in order]
        assert keys == sorted(keys)


def test_common_prefixes():
    rng = random.Random(6)
    for _ in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 50))) * rng.randint(1, 3)
        starts = np.array(sorted(rng.sample(range(len(text)), rng.randint(2, len(text)))))
        order = suffix_dedup.window_order(text, starts, 400)
        got = suffix_dedup.common_prefixes(text, order, 24).tolist()
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), got[1:], strict=True):
            assert text[a : a + n] == text[b : b + n] and n <= 24
            end = max(a, b) + n
            assert n == 24 or end >= len(text) or text[a + n] != text[b + n]


def test_repeated_windows():
    rng = random.Random(8)
    for _ in range(400):
        span, alphabet = rng.choice([3, 9, 16, 40]), rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(alphabet) for _ in range(60))
        contexts = [base[rng.randint(0, 20) : rng.randint(25, 60)] if rng.random() < 0.7 else bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + span] for t in contexts for i in range(len(t) - span + 1))
        want = [[i for i in range(len(t) - span + 1) if seen[t[i : i + span]] > 1] for t in contexts]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(contexts, span)] == want


@pytest.mark.parametrize(("group", "part"), [(16384, 16384), (6, 16384), (1, 16384), (16384, 3), (6, 2)], ids=["suffixes", "cores", "window_starts", "salted", "salted_cores"])
def test_removal_against_windows(spark, group, part):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alpha", "be", "ça", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [text(rng.randint(5, 40)) for _ in range(6)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 30)) for _ in range(rng.randint(0, 8))) for _ in range(80)]
    texts += [texts[3], texts[3], "a" * 300, "ab" * 200, "", texts[5] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, span=60, gram=30, group=group, batch_bytes=3000, part=part, keep_bytes=True).orderBy("doc_id").collect()
    want = brute_removed(texts, 60)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out) and sum(w[1] for w in want) > 0


@pytest.mark.parametrize("group", [16384, 1], ids=["suffixes", "cores"])
def test_short_periodic_texts(spark, group):
    """Anchors of one short text share the whole text as context: that is one place."""
    rng = random.Random(12)
    unit = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [(unit(period) * 90)[:size] for period in (7, 14, 22, 29, 41) for size in (59, 60, 61, 66, 75, 89, 90, 91, 118, 119, 120)]
    texts += ["tail " + texts[3], texts[5][:62] + "x", texts[8], texts[8]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, span=60, gram=30, group=group, part=4).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == brute_removed(texts, 60)
    alone = (unit(83) * 5)[:414]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([(1, alone)], "doc_id long, text string")).first().n_removed == 0


def test_rows_without_ids(spark):
    """Rows are told apart by their row number, whatever their ids are."""
    rng = random.Random(13)
    shared = "".join(rng.choice("abcdef ") for _ in range(70))
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) + (shared if i % 3 == 0 else "") for i in range(300)]
    df = spark.createDataFrame([(None if i % 2 else -(2**63), t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, span=60, gram=30).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(brute_removed(texts, 60))
    assert {r.doc_id for r in out} == {None, -(2**63)}


def test_anchors_do_not_depend_on_blocks():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdef") for _ in range(5000))
    whole, blocks = suffix_dedup.Anchors(60, 30), suffix_dedup.Anchors(60, 30, block=700)
    (_, a, h), (_, b, g) = next(whole.of([text])), next(blocks.of([text]))
    assert a.tolist() == b.tolist() and len(a) > 50
    assert [x.tolist() for _, x, _ in whole.of([text[:900], b"x", text])] == [x.tolist() for t in (text[:900], text) for _, x, _ in whole.of([t])]
    assert len(h) == len(g)


def test_repeats_awkward(spark, awkward, no_rows, folder):
    rows = suffix_dedup.op5_suffix_dedup(spark, folder(awkward)).collect()
    assert len(rows) == 9 and suffix_dedup.remove_repeats(no_rows).count() == 0
    want = brute_removed(["palabra " * 30_000], 400)[0]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id == 5] == [want]
    assert sum(r.doc_id is None for r in rows) == 1
    twice = spark.createDataFrame([(1, "x y z " * 100), (1, "x y z " * 100)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()] == [600, 600]


# --- near duplicates -------------------------------------------------------


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {i: i for i in prints}
    while True:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], moved = label[b], True
        if not moved:
            return label


def test_near_duplicates_against_pairs(spark, corpus, folder):
    texts = texts_of(corpus)
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    rows = {r.doc_id: r for r in simhash.op10_simhash_vptree(spark, folder(corpus)).collect()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(prints)


def test_links_over_many_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    flip = base ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    chain = [base[0]]
    for _ in range(600):
        chain.append(chain[-1] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    dense = [base[1] ^ np.uint64(a | b) for a in (1 << np.arange(30)) for b in (1 << np.arange(0, 30, 7))]
    points = np.unique(np.concatenate([base, flip, np.array(chain, np.uint64), np.array(dense, np.uint64)]))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = simhash.forest(len(points), i, j)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    found = {r.node: r.label for r in simhash.components(simhash.links(df, sample=400, shard=100, least=100)).collect()}
    got = [found.get(int(x), int(x)) for x in points.view(np.int64)]
    assert len(set(zip(got, want.tolist(), strict=True))) == len(set(got)) == len(set(want.tolist()))


def test_bit_counts():
    hashes = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    want = [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash._bit_counts(hashes).tolist() == want


def test_near_awkward(spark, awkward, no_rows):
    rows = simhash.near_groups(awkward).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    stay = simhash.near_stage(spark, awkward, "")
    assert stay.columns == awkward.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["1", "3", "5", "6", "7", "None"]
    assert simhash.near_groups(no_rows).count() == 0
