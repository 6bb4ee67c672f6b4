"""Secret scan: three rules for known forms, and a token-efficiency test for random strings.

Words and identifiers are spelled with few tokens of a tokenizer's vocabulary; random strings need many.  Every run of
credential characters is counted; one whose characters per token are at a limit or below is reported, unless it is a known
digest, its words explain it (half of its characters are in words that are few tokens by themselves, or in parts too short to
tell), or a rule has found it.  Digits alone are numbers of accounts and cards up to a length, and are spelled with fewer
tokens than letters, so they have bounds of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.spans import Span, digest, spelled, without_overlaps
from plumbline.llm.texts import read_public_file, with_kernel
from plumbline.llm.token_counts import VOCABULARY, encoding

KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
#: A candidate's characters at least, and the characters per token up to which it counts as random.
MIN_CHARS = 16
MAX_CHARS_PER_TOKEN = 2.0
#: Letters of one case (the first may be a capital) may be a word that the vocabulary lacks: shorter ones must be below the limit.
ONE_CASE_CHARS = 20
#: Digits alone: at least so many, and their limit.
MIN_DIGITS, MAX_DIGITS_PER_TOKEN = 20, 2.7
#: A word explains itself from so many letters on, at so many letters per token; shorter parts than PART_CHARS tell nothing.
WORD_LETTERS, WORD_LETTERS_PER_TOKEN, PART_CHARS = 4, 3.0, 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Letters of alphabets whose words are written without spaces inside: what touches one is a part of a word.
_LETTER = re.compile(r"[\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u052F\u1E00-\u1FFF]")
_SIGNS = re.compile(r"[+/_=-]+")
_WORDS = re.compile(r"[A-Z]?[a-z]{%d,}|[A-Z]{%d,}(?![a-z])" % (WORD_LETTERS - 1, WORD_LETTERS))


def unexplained(s: str, count) -> int:
    """Characters of s outside of words that are few tokens, and outside of short parts."""
    out = 0
    for part in _SIGNS.split(s):
        if len(part) >= PART_CHARS:
            words = [w for w in _WORDS.findall(part) if len(w) >= WORD_LETTERS]
            out += len(part) - sum(len(w) for w in words if len(w) >= WORD_LETTERS_PER_TOKEN * count(w.lower()))
    return out


def is_digest(s: str) -> bool:
    return len(s) in DIGEST_CHARS and bool(_DIGEST.fullmatch(s)) or bool(_UUID.fullmatch(s))


def base_spans(text: str) -> list[Span]:
    """Spans of the three rules: each rule's leftmost matches that don't overlap; those too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def is_random(s: str, count) -> bool:
    """The token-efficiency test; count gives a string's tokens."""
    if is_digest(s):
        return False
    if not any(c.isalpha() for c in s):
        digits = _SIGNS.sub("", s)
        return len(digits) >= MIN_DIGITS and len(s) <= MAX_DIGITS_PER_TOKEN * count(s)
    tokens = count(s)
    if len(s) > MAX_CHARS_PER_TOKEN * tokens:
        return False
    if len(s) < ONE_CASE_CHARS and s.isalpha() and (s.isupper() or s[1:].islower()) and len(s) == MAX_CHARS_PER_TOKEN * tokens:
        return False
    return 2 * unexplained(s, count) >= len(s)


def random_spans(text: str, count) -> list[Span]:
    """Runs that are spelled with too many tokens; of a run that touches a further letter, the part beyond its first sign on that side."""
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if a and _LETTER.match(text, a - 1):
            sign = _SIGNS.search(text, a, b)
            a = sign.end() if sign else b
        if b < len(text) and _LETTER.match(text, b):
            signs = [x.start() for x in _SIGNS.finditer(text, a, b)]
            b = signs[-1] if signs else a
        s = text[a:b].strip("=-+/_")
        if len(s) >= MIN_CHARS and is_random(s, count):
            start = text.index(s, a)
            out.append(("random", start, start + len(s)))
    return out


SCANNED = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def _scanner(content: bytes):
    own = encoding(content)

    def count(s: str) -> int:
        return len(own.encode_ordinary(s))

    def kernel(texts: list[str | None]) -> list:
        rows = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            more = without_overlaps(random_spans(t, count), base)
            kinds = [k for k, _, _ in base] + [k for k, _, _ in more]
            rows.append((*(kinds.count(k) for k in KINDS), digest(spelled(base, KINDS)), spelled(base + more, KINDS)))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in SCANNED.fields]

    return kernel


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns `keep`, then counts by kind, base_sha256 (the rules' spans) and spans (all), for each whole text.

    Offsets are code points, the end exclusive.  A null or empty text has no spans; repeated rows give
    repeated results, an empty table an empty one, and columns not named in `keep` are ignored.
    The vocabulary file is read on the driver and broadcast; its size is fixed.
    """
    return with_kernel(docs, keep, text, SCANNED, _scanner, read_public_file(vocabulary, VOCABULARY))
