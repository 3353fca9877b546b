"""Personal data by anchor expansion (operator 6).

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits (beside
dots, in runs, after two capitals), schemes and identifier cues. From an anchor a deterministic
local parser expands to the boundaries of an email, address, card, phone, account or secret
and validates it; none retries.

Base kinds follow fixed grammars (leftmost, non-overlapping per kind; failing matches are
dropped whole): email, ip, card, phone. The method adds:

* url - a scheme with user information (`https://user:pass@host/...`), or `mailto:`/`tel:`/
  `sip:` links with what follows them;
* iban - anywhere: a country code of the IBAN registry, two digits and as many capitals or
  digits as that country's numbers have (single spaces or hyphens may stand between them), not
  inside a longer word, with check value 1 modulo 97;
* account - an identifier cue (account, acct, passport, ssn, tax id, ...), up to a few
  separators and an identifier of 6 to 20 digits or capital letters with at least 4 digits,
  where no iban stands;
* secret - a secret's cue (token, api key, secret, password, ...), a `=`, `:` or `is` and, in
  quotes or not, a value of at least 16 letters, digits or `+/_.~-` with a letter and a digit;
  after password and the like at least 6 characters other than white space, quotes and commas
  (after `is` with a digit among them).

Positions are code points, end exclusive. Defined results: null text is empty (no spans);
repeated rows are all returned; an empty input gives an empty result; only id and text are
read. Work and memory are linear in a text, whatever it holds: what a parser reads from an anchor
either ends before the next anchor of its kind, or has a bounded length, or becomes a span that later
anchors of its kind skip. Tests double texts made of each anchor.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mailto:", "tel:", "sip:")
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "tax id", "vat id", "routing", "konto", "compte", "cuenta", "customer id", "patient id", "driver license", "driving licence", "national id")
PASSWORDS = ("password", "passwd", "passphrase", "pwd")
TOKENS = ("token", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "secret", "secret_key", "secret key", "private key", "private_key", "bearer", "auth_key", "client_secret", *PASSWORDS)
# Lengths of account numbers by country code, as in the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_PHONE = frozenset(" ().0123456789-")
_CARD_GAP = frozenset(" -")
_CODE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_AFTER_CUE = re.compile(r"[\s:#=.]{0,4}(?:(?:no|nr|num|number|id|is)\b[\s:#=.]{0,4}){0,2}")
_IDENTIFIER = re.compile(r"[A-Z0-9](?:[- ]?[A-Z0-9]){5,19}(?![A-Za-z0-9])")
_GIVEN = re.compile(r"[\"'`]?\s{0,4}(?:[:=]{1,2}>?|\bis\b)\s{0,4}[\"'`]?|\s(?=[A-Za-z0-9+/_.~-]{16})")
# No lookahead for the letter and the digit: from each of many cues it would read on to the same end.
_SECRET = re.compile(r"[A-Za-z0-9+/_~-][A-Za-z0-9+/_.~-]{14,}[A-Za-z0-9+/_~-]={0,2}")
_PASSWORD = re.compile(r"[^\s\"'`,;<>]{6,}")
_USERINFO = re.compile(r"[^\s/@:?#<>\"']+(?::[^\s/@?#<>\"']*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
_LINK = re.compile(r"[^\s<>\"'?]+")
_EMAIL_AT, _PLUS, _DIGIT, _SCHEME, _CUE, _TOKEN = range(6)

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", (_EMAIL_AT, "@"))
    found.add_word("+", (_PLUS, "+"))
    for d in "0123456789":
        found.add_word(d, (_DIGIT, d))
    for s in SCHEMES:
        found.add_word(s, (_SCHEME, s))
    for c in CUES:
        found.add_word(c, (_CUE, c))
    for t in TOKENS:
        found.add_word(t, (_TOKEN, t))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end, n, labels = at + 1, len(text), 0
    while True:
        stop = end
        while stop < n and text[stop] in _LABEL:
            stop += 1
        if stop == end:
            end -= labels > 0  # the dot before a missing label is not part
            break
        labels, end = labels + 1, stop
        if stop < n and text[stop] == ".":
            end = stop + 1
            continue
        break
    return (start, end) if labels >= 2 else None


def _digit_run(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in _DIGITS:
        at += 1
    return at


def _ip(text: str, start: int) -> tuple[int, int] | None:
    """The four dotted numbers from `start`, valid or not."""
    end = _digit_run(text, start)
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        stop = _digit_run(text, end + 1)
        if stop == end + 1:
            return None
        end = stop
    return start, end


def _card(text: str, start: int) -> int:
    """The end of the longest run of digits with single gaps."""
    n, end = len(text), start + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in _CARD_GAP and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def _phone(text: str, plus: int) -> int | None:
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in _DIGITS:
        return None
    stop = plus + 2
    last = None
    while stop < n and text[stop] in _PHONE:
        if stop >= plus + 3 and text[stop] in _DIGITS:
            last = stop
        stop += 1
    return None if last is None else last + 1


def _iban(text: str, start: int) -> int | None:
    """The end of a valid IBAN from `start`, None if there is none."""
    size = IBAN_LENGTHS.get(text[start : start + 2])
    if not size or start and text[start - 1].isalnum():
        return None
    code, end, n = text[start : start + 2], start + 2, len(text)
    while len(code) < size and end < n:
        gap = text[end] in _CARD_GAP and len(code) >= 4 and end + 1 < n
        if text[end + gap] not in _CODE:
            return None
        code += text[end + gap]
        end += 1 + gap
    if len(code) < size or not code[2:4].isdigit() or end < n and text[end].isalnum():
        return None
    return end if mod97(code) else None


def _mixed(value: str) -> bool:
    return not _DIGITS.isdisjoint(value) and not _LETTERS.isdisjoint(value)


class Finder:
    def __init__(self):
        self.automaton = _automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans, by kind as listed, then start."""
        out: dict[str, list[Span]] = {k: [] for k in BASE + ADDED}
        free = dict.fromkeys(BASE + ADDED, 0)
        # Only letters A-Z fold, so that positions stay those of the text.
        folded = text.translate(_FOLD) if not text.isascii() else text.lower()
        run_end = 0
        for last, (kind, word) in self.automaton.iter(folded):
            if kind == _DIGIT:
                if last < run_end:
                    continue
                run_end = _digit_run(text, last)
                if last - 2 >= free["iban"] and last >= 2 and (end := _iban(text, last - 2)):
                    free["iban"] = end
                    out["iban"].append(("iban", last - 2, end))
                if last >= free["ip"] and (hit := _ip(text, last)):
                    free["ip"] = hit[1]
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[hit[0] : hit[1]].split(".")):
                        out["ip"].append(("ip", *hit))
                if last >= free["card"] and (end := _card(text, last)) - last >= 2:
                    free["card"] = end
                    digits = text[last:end].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(("card", last, end))
                continue
            start = last - len(word) + 1
            if kind == _EMAIL_AT:
                if start >= free["email"] and (hit := _email(text, start, free["email"])):
                    free["email"] = hit[1]
                    out["email"].append(("email", *hit))
            elif kind == _PLUS:
                if start >= free["phone"] and (end := _phone(text, start)):
                    free["phone"] = end
                    if 9 <= sum(c in _DIGITS for c in text[start:end]) <= 15:
                        out["phone"].append(("phone", start, end))
            elif kind == _SCHEME:
                if start >= free["url"] and (hit := (_USERINFO if word.endswith("//") else _LINK).match(text, last + 1)):
                    free["url"] = hit.end()
                    out["url"].append(("url", start, hit.end()))
            elif start and text[start - 1].isalnum():
                continue  # cues begin words
            elif kind == _TOKEN:
                given = _GIVEN.match(text, last + 1) if start >= free["secret"] else None
                hit = given and (_PASSWORD if word in PASSWORDS else _SECRET).match(text, given.end())
                if hit and (any(c in ":=" for c in given[0]) or not _DIGITS.isdisjoint(hit[0]) if word in PASSWORDS else _mixed(hit[0])):
                    free["secret"] = hit.end()
                    out["secret"].append(("secret", *hit.span()))
            elif start >= free["account"]:
                place = _AFTER_CUE.match(text, last + 1).end()
                hit = _IDENTIFIER.match(text, place)
                if hit and place > last + 1 and sum(c in _DIGITS for c in hit[0]) >= 4 and not _iban(text, place):
                    free["account"] = hit.end()
                    out["account"].append(("account", *hit.span()))
        return [s for k in BASE + ADDED for s in out[k]]


_FOLD = {c: c + 32 for c in range(65, 91)}


def spans_string(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans join."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<kind, start, end>>."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        finder = Finder()
        return lambda texts, columns: {"id": columns["id"], "spans": pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t)] for t in texts], kind)}

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return map_texts(rows, make, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
