"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one vocabulary entry can be the last token of the prefix's
encoding.  Walking the prefixes from left to right, the entries that end there (found by the
suffix automaton of the vocabulary) are tried: an entry is the one if the rest of the prefix
is empty, or if the entry is compatible with the last token of the rest, that is, if merging the two
tokens' bytes gives just these two tokens again.  Back-pointers then spell out the ids.  The work is
linear in the piece's length, for a piece of any length.

Two tokens are compatible unless some merge rule joins a part on the right rim of the first with a
part on the left rim of the second while both parts still stand: before the rule that swallows the
left part runs, and not after the one that swallows the right part (equal rules run leftmost first).
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm import automaton
from plumbline.llm.texts import read_public_file, with_kernel

VOCABULARY = "byte_bpe_50k.json"
#: The published pattern that cuts a text into pieces before merging (a fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that the regex package takes for letters or numbers (Unicode 17) and the tokenizers library for neither (fixed values).
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
_NEWER_CLASS = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER)
_HAS_NEWER = re.compile(f"[{_NEWER_CLASS}]").search
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NEWER_CLASS}]]", rf"[\p{{N}}--[{_NEWER_CLASS}]]"
#: The same pattern for texts with such code points.
OLDER_PIECES = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:[^\s\p{{L}}\p{{N}}]|[{_NEWER_CLASS}])+|\s+(?!\S)|\s+"""
#: Pieces, and chunks between single spaces, that a Python worker remembers, twice over.
REMEMBERED_PIECES, REMEMBERED_CHUNKS = 250_000, 100_000
#: Compatible pairs of tokens that are remembered.
REMEMBERED_PAIRS = 300_000
#: Steps of the automaton that are remembered.
REMEMBERED_STEPS = 300_000
LONGEST_REMEMBERED = 48
#: Where this finds nothing, every space stands alone between two visible characters or at an end of
#: the text, and so starts a piece: the text may be cut there.
_CROWDED = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]").search

FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, content: bytes, built: automaton.SuffixAutomaton | None = None) -> None:
        read = json.loads(content)
        letters = byte_letters()
        spelled = read["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in spelled.items()}
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens") or []}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, rule in enumerate(read["model"]["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            pair = spelled[left], spelled[right]
            self.rank.setdefault(pair, n)
            self.parts.setdefault(spelled[left + right], (*pair, n))
        self._left_rim: dict[int, list[tuple[int, int]]] = {}
        self._right_rim: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.automaton = built or automaton.build({self.bytes_of[i]: i for i in spelled.values() if self.whole(i)})
        self._steps: dict[int, tuple[int, int, tuple[tuple[int, int], ...]]] = {}

    def _rim(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts on one rim of a token, each with the number of the rule that swallows it."""
        known = self._right_rim if side else self._left_rim
        if token not in known:
            out, ends = [], FOREVER
            at = token
            while True:
                out.append((at, ends))
                if at not in self.parts:
                    break
                ends = self.parts[at][2]
                at = self.parts[at][side]
            known[token] = out
        return known[token]

    def fits(self, first: int, second: int, limit: int = FOREVER) -> bool:
        """Whether the two tokens' bytes, merged by the rules before `limit`, are these two tokens."""
        key = first, second
        if limit == FOREVER and key in self._fits:
            return self._fits[key]
        good = True
        for a, a_ends in self._rim(first, 1):
            for b, b_ends in self._rim(second, 0):
                n = self.rank.get((a, b))
                if n is not None and n < limit and n < a_ends and n <= b_ends:
                    good = False
        if limit == FOREVER:
            if len(self._fits) > REMEMBERED_PAIRS:
                self._fits.clear()
            self._fits[key] = good
        return good

    def whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this one token."""
        if token not in self._whole:
            part = self.parts.get(token)
            self._whole[token] = part is None or (self.whole(part[0]) and self.whole(part[1]) and self.fits(part[0], part[1], part[2]))
        return self._whole[token]

    def _step(self, state: int, byte: int) -> tuple[int, int, tuple[tuple[int, int], ...]]:
        """The next state, how long a suffix it holds if not one byte more than before (else -1), and the entries that may end there."""
        own = self.automaton
        at, short = state, -1
        edge = own.labels.find(byte, own.first[at], own.first[at + 1])
        while edge < 0 and at:
            at = own.link[at]
            short = own.longest[at] + 1
            edge = own.labels.find(byte, own.first[at], own.first[at + 1])
        out = (0, 0, ()) if edge < 0 else (own.target[edge], short, own.words_of(own.target[edge]))
        if len(self._steps) > REMEMBERED_STEPS:
            self._steps.clear()
        self._steps[state << 8 | byte] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [-1] * (n + 1)
        last[0] = -2
        size = [0] * (n + 1)
        fits, known, steps = self.fits, self._fits, self._steps
        state = held = 0
        for end, byte in enumerate(piece, 1):
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state, short, entries = step
            held = held + 1 if short < 0 else short
            for token, length in entries:
                if length > held:
                    continue
                before = last[end - length]
                if before >= 0:
                    good = known.get((before, token))
                    if good is None:
                        good = fits(before, token)
                    if not good:
                        continue
                elif before == -1:
                    continue
                last[end] = token
                size[end] = length
                break
        if n and last[n] < 0:
            raise ValueError(f"the vocabulary has no encoding for {piece!r}")
        out = []
        while n > 0:
            out.append(last[n])
            n -= size[n]
        return out[::-1]


class _Memory(dict):
    """Results for keys, in two generations: when the young one is full it becomes the old one, and
    what is still asked for moves back.  Frequent keys stay, and at most twice `most` are held."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST_REMEMBERED:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, content: bytes, built: automaton.SuffixAutomaton | None = None) -> None:
        self.vocabulary = Vocabulary(content, built)
        self.find = regex.compile(PIECES).findall
        self.find_older = regex.compile(OLDER_PIECES, regex.V1).findall
        self.pieces = _Memory(self._piece, REMEMBERED_PIECES)
        self.chunks = _Memory(self._pieces_of, REMEMBERED_CHUNKS)
        special = self.vocabulary.special
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        top = max(self.vocabulary.bytes_of) + 1
        self.spelling = [self.vocabulary.bytes_of.get(i, b"") for i in range(top)]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; strings of special tokens are these tokens."""
        if not text:
            return b""
        if self.cut is None or "<" not in text and not self.cut.search(text):
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(pack("<I", self.vocabulary.special[x]) if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _piece(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return pack(f"<{len(ids)}I", *ids)

    def _pieces_of(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut_pieces(text)))

    def cut_pieces(self, text: str) -> list[str]:
        return self.find(text) if text.isascii() or not _HAS_NEWER(text) else self.find_older(text)

    def _plain(self, text: str) -> bytes:
        if _CROWDED(text):
            return self._pieces_of(text)
        head, *rest = text.split(" ")
        return self.chunks[head] + b"".join([self.chunks[x] for x in map(" ".__add__, rest)])

    def decode(self, ids: bytes) -> str:
        """The text of the ids; ids outside the vocabulary have none, and broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODEC: dict[int, Codec] = {}


def codec(content: bytes, built: automaton.SuffixAutomaton | None = None) -> Codec:
    """One codec for each Python process and vocabulary."""
    key = hash(content)
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(content, built)
    return _CODEC[key]


ENCODED = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
)


def _encode_decode(payload: tuple[bytes, automaton.SuffixAutomaton]):
    own = codec(*payload)

    def kernel(texts: list[str | None]) -> list:
        ids = [own.encode(t) for t in texts]
        return [[len(x) // 4 for x in ids], ids, [own.decode(x) for x in ids]]

    return kernel


def encode_and_decode(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """For each row: the columns `keep`, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded.

    vocabulary: path of a byte-level BPE file of the tokenizers library, read on the driver and broadcast with the suffix
    automaton of its entries, which is built there (their sizes are fixed).  A null or empty text has no tokens and decodes to ''.  Texts are encoded whole,
    at any length; repeated rows give repeated results, an empty table an empty one, and columns that
    aren't named in `keep` are ignored, whatever their names.
    """
    content = read_public_file(vocabulary, VOCABULARY)
    return with_kernel(docs, keep, text, ENCODED, _encode_decode, (content, codec(content).vocabulary.automaton))
