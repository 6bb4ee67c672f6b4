"""Benchmark decontamination: n-gram seeds find where a test item may stand, and Smith-Waterman scores it.

Items and documents are read as words in lower case, without punctuation.  (1) Three words of four in a row, one at most
of the inner two left out, are a seed: of items and documents alike, so that a word that was changed, put in or left out between them does not
part them.  Each seed of an item counts, however often it is found, so a copy needs one of them only.  (2) Where a document has a seed,
the words around it are aligned with the item's; the score is the best local alignment's over the item's length, so
edited copies score less than 1 but far more than chance.  Before that, a window that cannot reach the
threshold is left out: a score is never more than the share of the item's words that the window has.  A part of a short item
says little: one edit is all that items of 5 to 7 words may have, and shorter ones are sought as runs of all their words, without seeds.

The benchmark is handled in blocks of bounded size, one after the other: each is broadcast, all documents meet it, and what they
keep or match is written before the next one is read.  Nothing of the documents comes back to the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut, ship
from plumbline.llm.bytewords import Batch, mix, shingles
from plumbline.llm.texts import free_name, kernel_column

#: Which words of a row make a seed.
SEEDS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Items of fewer words are found just where all their words stand in a row; from there to MIN_FREE_WORDS they may have one edit.
MIN_ITEM_WORDS, MIN_FREE_WORDS = 5, 8
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4_000_000
#: Seeds met, and words of items looked up, in one numpy pass.
PASS_HITS, PASS_WORDS = 1_000_000, 1_000_000

_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")


def normal(text: str | None) -> str:
    """The text in lower case, with ASCII punctuation as spaces."""
    return _PUNCTUATION.sub(" ", (text or "").lower())


def needed(n_words: int) -> float:
    """The least score of a match with an item of so many words: that of one changed word below MIN_FREE_WORDS, else THRESHOLD of its length."""
    return n_words - MATCH + MISMATCH if n_words < MIN_FREE_WORDS else THRESHOLD * n_words


def seeds(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds' hashes, and the word where each begins; first: each text's first word (one more entry than texts)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for pattern in SEEDS:
        at = np.flatnonzero(text[: len(text) - pattern[-1]] == text[pattern[-1] :])
        own = np.zeros(len(at), dtype=np.uint64)
        for k in pattern:
            own = mix(own) + hashes[at + k]
        found.append(mix(own))
        places.append(at)
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Block:
    """Items as word hashes, and their seeds: sorted hashes, and the places (hash's number, item, word) where they stand, sorted.

    short: by number of words, the short items: the hash of all words, and the ids that have it.
    """

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    places: np.ndarray
    short: dict[int, dict[int, list[int]]]


def read_block(rows: list[tuple[int, str | None]]) -> Block:
    rows = sorted((i, t or "") for i, t in rows)
    batch = Batch([normal(t) for _, t in rows])
    begin, end, first = batch.words()
    hashes = batch.word_hashes(begin, end)
    ids, words, runs = [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    for k, (item, _) in enumerate(rows):
        own = hashes[first[k] : first[k + 1]]
        if len(own) < MIN_ITEM_WORDS:
            if len(own):
                whole = int(shingles(own, np.array([0, len(own)]), len(own))[0][0])
                short.setdefault(len(own), {}).setdefault(whole, []).append(item)
            continue
        runs.append(seeds(own, np.array([0, len(own)])))
        ids.append(item)
        words.append(own)
    if not ids:
        return Block(ids, words, np.zeros(0, dtype=np.uint64), np.zeros((0, 3), dtype=np.int64), short)
    grams, gram = np.unique(np.concatenate([r for r, _ in runs]), return_inverse=True)
    item = np.repeat(np.arange(len(ids)), [len(r) for r, _ in runs])
    at = np.concatenate([a for _, a in runs])
    return Block(ids, words, grams, np.stack((gram, item, at), axis=1)[np.lexsort((at, item, gram))], short)


def gram_places(texts: list[str | None], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the texts have seeds of the sorted list: text, word in the text, place in the list; and the words' hashes and first words."""
    batch = Batch([normal(t) for t in texts])
    begin, end, first = batch.words()
    hashes = batch.word_hashes(begin, end)
    if not len(grams):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, hashes, first
    runs, word = seeds(hashes, first)
    at = np.minimum(np.searchsorted(grams, runs), len(grams) - 1)
    hit = np.flatnonzero(grams[at] == runs)
    hit = hit[np.argsort(word[hit], kind="stable")]
    text = np.searchsorted(first, word[hit], side="right") - 1
    return text, word[hit] - first[text], at[hit], hashes, first


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """The best local alignment's score, and the window word after its last one."""
    n = len(window)
    slope = -GAP * np.arange(n + 1)
    before = np.zeros(n + 1)
    best, end = 0.0, 0
    for w in item:
        here = np.zeros(n + 1)
        here[1:] = before[:-1] + np.where(window == w, MATCH, MISMATCH)
        np.maximum(here, before + GAP, out=here)
        np.maximum(here, 0.0, out=here)
        here = np.maximum.accumulate(here + slope) - slope
        top = int(here.argmax())
        if here[top] > best + 1e-9:
            best, end = float(here[top]), top
        before = here
    return best, end


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from start to stop, and the range that each is of."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + start[owner], owner


class _Matcher:
    """Matches with a block's items; what is looked up is laid out once."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.size = np.array([len(w) for w in block.words], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.needed = np.array([needed(n) for n in self.size.tolist()])
        self.vocabulary, self.word = np.unique(np.concatenate(block.words), return_inverse=True) if block.ids else (np.zeros(0, dtype=np.uint64),) * 2
        self.keys = block.places[:, 0] * len(block.ids) + block.places[:, 1]
        self.short = {n: np.array(sorted(whole), dtype=np.uint64) for n, whole in block.short.items()}

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text its best match with each item: (item id, score, seeds in it, first word, word after the last)."""
        text, word, gram, hashes, first = gram_places(texts, self.block.grams)
        out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in texts]
        if len(text):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            held = np.flatnonzero(self.vocabulary[at] == hashes)
            stands = np.sort(at[held] * (len(hashes) + 1) + held)
            self._some(text, word, gram, 0, len(self.block.ids), hashes, first, stands, out)
        for n, wholes in self.short.items():
            self._whole(n, wholes, hashes, first, out)
        return [sorted(x) for x in out]

    def _whole(self, n: int, wholes: np.ndarray, hashes: np.ndarray, first: np.ndarray, out) -> None:
        """The first place in each text of each short item of n words; wholes: their sorted hashes."""
        runs, offset = shingles(hashes, first, n)
        if not len(runs):
            return
        place = np.minimum(np.searchsorted(wholes, runs), len(wholes) - 1)
        hit = np.flatnonzero(wholes[place] == runs)
        text = np.searchsorted(offset, hit, side="right") - 1
        once = np.unique(np.stack((text, place[hit])), axis=1, return_index=True)[1] if len(hit) else hit
        for t, g, at in zip(text[once].tolist(), place[hit[once]].tolist(), (hit - offset[text])[once].tolist(), strict=True):
            out[t] += [(item, 1.0, 1, at, at + n) for item in self.block.short[n][int(wholes[g])]]

    def _some(self, text, word, gram, low, high, hashes, first, stands, out) -> None:
        """The matches with the items from low to high, in parts of PASS_HITS seeds as far as that can be."""
        n = len(self.block.ids)
        start, stop = np.searchsorted(self.keys, gram * n + low), np.searchsorted(self.keys, gram * n + high)
        if (stop - start).sum() > PASS_HITS and (text[0] < text[-1] or high - low > 1):
            if text[0] < text[-1]:
                cut = np.searchsorted(text, (text[0] + text[-1] + 1) // 2)
                for part in (slice(None, cut), slice(cut, None)):
                    self._some(text[part], word[part], gram[part], low, high, hashes, first, stands, out)
            else:
                for a, b in ((low, (low + high) // 2), ((low + high) // 2, high)):
                    self._some(text, word, gram, a, b, hashes, first, stands, out)
            return
        place, hit = _ranges(start, stop)
        if not len(place):
            return
        text, word = text[hit], word[hit]
        item, at = self.block.places[place, 1], self.block.places[place, 2]
        order = np.lexsort((word - at, item, text))
        text, word, item, at = text[order], word[order], item[order], at[order]
        slack = self.size[item] // 2
        a = np.maximum(0, word - at - slack) + first[text]
        b = np.minimum(first[text + 1], word - at + self.size[item] + slack + first[text])
        pair = np.ones(len(text), dtype=bool)
        pair[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        new = pair.copy()
        new[1:] |= a[1:] > b[:-1]
        window = np.flatnonzero(new)
        a, b = a[window], b[np.concatenate((window[1:], [len(text)])) - 1]
        pairs = np.flatnonzero(pair)
        of = np.searchsorted(pairs, window, side="right") - 1
        ends = np.concatenate((pairs[1:], [len(text)]))
        best: dict[int, tuple[float, int, int]] = {}
        for k in np.flatnonzero(self._share(item[window], a, b, len(hashes) + 1, stands) >= self.needed[item[window]]).tolist():
            own, words = self.block.words[item[window[k]]], hashes[a[k] : b[k]]
            score, end = align(own, words)
            if score >= needed(len(own)) and score > best.get(of[k], (0.0,))[0]:
                back, length = align(own[::-1], words[:end][::-1])
                begin = int(a[k] - first[text[window[k]]])
                best[of[k]] = score, begin + end - length, begin + end
        for p, (score, begin, end) in best.items():
            hits = slice(pairs[p], ends[p])
            seeds = len(np.unique(at[hits][(word[hits] >= begin) & (word[hits] < end)]))
            i = item[pairs[p]]
            out[text[pairs[p]]].append((self.block.ids[i], score / int(self.size[i]), seeds, begin, end))

    def _share(self, item: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, stands: np.ndarray) -> np.ndarray:
        """How many of the item's words each window from a to b has; stands: sorted word * n + place of the words of items."""
        out = np.zeros(len(item), dtype=np.int64)
        done = np.cumsum(self.size[item])
        x = 0
        while x < len(item):
            y = max(x + 1, int(np.searchsorted(done, (done[x - 1] if x else 0) + PASS_WORDS, side="right")))
            place, owner = _ranges(self.first[item[x:y]], self.first[item[x:y]] + self.size[item[x:y]])
            word = self.word[place] * n
            next_one = np.searchsorted(stands, word + a[x:y][owner])
            found = (next_one < len(stands)) & (stands[np.minimum(next_one, len(stands) - 1)] < word + b[x:y][owner])
            out[x:y] = np.bincount(owner[found], minlength=y - x)
            x = y
        return out


def matches(texts: list[str | None], block: Block) -> list[list[tuple[int, float, int, int, int]]]:
    """For each text its best match with each item: (item id, score, seeds in it, first word, word after the last)."""
    return _Matcher(block)(texts)


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_seeds", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
)


def _matcher(block: Block):
    names = [f.name for f in FOUND.elementType.fields]
    found = _Matcher(block)
    return lambda texts: [[[dict(zip(names, m, strict=True)) for m in row] for row in found(texts)]]


def _blocks(benchmark: DataFrame):
    size = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / BLOCK_CHARS))
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    for b in range(n):
        block = read_block([tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()])
        if block.ids or block.short:
            yield block


def _matched(docs: DataFrame, block: Block, text: str) -> Column:
    """A column with the array of the matches (see FOUND) with a block's items."""
    return kernel_column(docs.sparkSession, docs[text], T.StructType([T.StructField("found", FOUND)]), _matcher, block)["found"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, end_word): the best match of each document with each item.

    Only matches whose score is enough (see needed); of items of fewer than MIN_ITEM_WORDS words, only whole ones, the first in
    the document.  Words are counted from 0 in the text as it is read here; n_seeds is at how many of the item's words a seed begins that is
    inside the match (1 for an item sought whole).  Of equal scores the first window's counts, and in it the first place where one ends.  Null and empty texts match nothing, and null items are not sought; an item
    whose id repeats is sought in each form.  Repeated rows give repeated matches; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    parts, blocks = [], _blocks(benchmark)
    block = next(blocks, None)
    while block is not None:
        part = own.select("doc_id", F.explode(_matched(own, block, "text")).alias("m"))
        block = next(blocks, None)
        parts.append(cut(part) if parts or block is not None else part)
    if not parts:
        parts = [own.select("doc_id", F.explode(F.array().cast(FOUND)).alias("m"))]
    made = reduce(DataFrame.union, parts)
    return made.select("doc_id", "m.item_id", F.round("m.score", 6).alias("score"), "m.n_seeds", "m.first_word", "m.end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that match no item; documents without text, and all where the benchmark is empty, stay."""
    ship(docs.sparkSession)
    blocks = _blocks(benchmark)
    block, first = next(blocks, None), True
    while block is not None:
        name = free_name(docs, "matches")
        docs = docs.withColumn(name, _matched(docs, block, text)).where(F.size(name) == 0).drop(name)
        block = next(blocks, None)
        docs, first = (docs if first and block is None else cut(docs)), False
    return docs
