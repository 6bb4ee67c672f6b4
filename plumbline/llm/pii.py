"""Personal data: four rules for known forms, and a linear-chain conditional random field for others.

The field (pii_field.py) labels the words of each line by the features of their shapes and of their neighbours' shapes.  It
finds what the rules can't: names, addresses, numbers of persons, phone numbers without a country's code, spelled-out mail
addresses.  It is trained on the small labelled table of pii_lines.py and decoded by Viterbi in numpy batches.  A name or an
address is reported only if the field is sure of each of its words (LEAST_SURE, by marginal probabilities).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.pii_field import ENTITIES, STATES, Field, core, decode_surely, tokens, train, viterbi, words_of
from plumbline.llm.spans import Span, digest, spelled, without_overlaps
from plumbline.llm.texts import with_kernel

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE_KINDS, *(f"crf_{e.lower()}" for e in ENTITIES)))}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four rules: each rule's leftmost matches that don't overlap; failing ones are dropped.

    Each rule takes time in proportion to the text, also on long runs of letters or digits.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


_BEGINS = np.array([s[0] == "B" for s in STATES])


#: How probable the least sure word of an entity must be.  Names and addresses are made of words that other sentences have as well.
LEAST_SURE = {"NAME": 0.95, "ADDRESS": 0.7}


def plausible(kind: str, found: str) -> bool:
    """What an entity's text must have, whatever the field says."""
    digits = [c for c in found if "0" <= c <= "9"]
    if kind == "CARD":
        return 14 <= len(digits) <= 19 and luhn("".join(digits))
    if kind == "PHONE":
        return 7 <= len(digits) <= 15
    if kind in ("ID", "ADDRESS"):
        return bool(digits)
    if kind == "NAME":
        return sum(c.isalpha() for c in found) > 1 and all(c.isalpha() or c in " .'-" for c in found)
    if kind == "IP":
        return found.count(":") > 1
    return True


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """What the field finds in each text; all lines are decoded together."""
    whole = "\n".join(texts)
    found = words_of(whole)
    entities = []

    def asked(states: np.ndarray) -> np.ndarray:
        """Fills entities with what is plausible, and marks those that must be sure."""
        marks = np.zeros(len(states), dtype=bool)
        for k in np.flatnonzero(_BEGINS[states]).tolist():
            kind, last = STATES[states[k]][2:], k
            inside = STATES.index("I-" + kind)
            while last + 1 < len(states) and states[last + 1] == inside and not found.opens[last + 1]:
                last += 1
            start = int(found.start[k]) + core(found.words[k])[0]
            end = int(found.start[last]) + core(found.words[last])[1]
            if plausible(kind, whole[start:end]):
                entities.append((kind, k, last, start, end))
                marks[k] = kind in LEAST_SURE
        return marks

    chance = decode_surely(field, found, asked)[1]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    out: list[list[Span]] = [[] for _ in texts]
    for kind, k, last, start, end in entities:
        if chance[k : last + 1].min() >= LEAST_SURE.get(kind, 0.0):
            i = int(np.searchsorted(first, start, side="right")) - 1
            out[i].append((f"crf_{kind.lower()}", start - int(first[i]), end - int(first[i])))
    return out


FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def _finder(field_parts):
    field = Field(*field_parts)

    def kernel(texts: list[str | None]) -> list:
        texts = [t or "" for t in texts]
        rows = []
        for t, found in zip(texts, field_spans(field, texts), strict=True):
            base = base_spans(t)
            spans = base + without_overlaps(found, base)
            kinds = [s[0] for s in spans]
            rows.append((*(kinds.count(k) for k in KINDS), digest(spelled(base, KINDS)), spelled(spans, KINDS)))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FOUND.fields]

    return kernel


def find_personal_data(docs: DataFrame, keep: list[str], text: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """The columns `keep`, then counts by kind, base_sha256 (the rules' spans) and spans (all), for each whole text.

    The field is trained on the driver from `labelled` (the table of pii_lines.py by default) and broadcast; its size is that of
    the table.  A text is decoded line by line, whatever a line's or a word's length.  Offsets are code points, the end exclusive.
    A span of the field that overlaps a rule's span is not reported again.  A null or empty text has none; repeated rows give
    repeated results, an empty table an empty one, and columns not named in `keep` are ignored.
    """
    field = train(labelled) if labelled else train()
    return with_kernel(docs, keep, text, FOUND, _finder, (field.index, field.weights, field.between, field.moves))
