"""License scan: fixed phrases, and wordings of licenses found by voting along diagonals.

All rolling hashes of GRAM_WORDS words of every text meet, in a join, the places where a wording has them.  A hit says where the
wording would begin in the text: its diagonal.  Hits are counted by diagonal; neighbouring diagonals, which insertions and omissions
cause, are put together in bins of SLACK diagonals that overlap by half, so that any two less than SLACK / 2 apart share a bin.  A bin with enough votes is
a candidate, and the text's words there are compared with the wording's: a wording of up to EXACT_WORDS words must stand there whole,
of a longer one a share of LEAST_SHARE of its words must be found in order (longest common subsequence).  Of spans that overlap the
one with more of its words found stays, then the one with the larger share, then the first of the list.

A wording needs GRAM_WORDS words in a row to be found; of GRAM_WORDS words at least, else it is an error.  Candidates are named by 128 bits
of hashes of the text, so equal texts are looked at by their own rows but have one list of candidates.

Odd input: a null text is empty (no words, no labels, score 0).  Repeated rows have repeated results.  Columns other than the text and
those to keep aren't read.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.bytewords import Batch, in_slices, shingles
from plumbline.llm.license_texts import PASSAGES
from plumbline.llm.texts import free_name, kernel_column
from plumbline.session import cut, ship

GRAM_WORDS = 3
SLACK = 16
EXACT_WORDS, LEAST_SHARE = 12, 0.7
#: Of a long wording's places, one in so many must vote; of a short one's, all.
VOTES_OF_PLACES = 10
#: Phrases of the base rules (fixed values), and the score of a text that has one but no wording.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
PHRASE_SCORE = 0.5
#: Wordings' places, and candidates, up to which they are broadcast (some 10 MB each); beyond, Spark chooses how to join them.
BROADCAST_PLACES, BROADCAST_CANDIDATES = 200_000, 200_000

_APART = np.zeros(256, dtype=bool)
_APART[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Words(Batch):
    """Texts in small letters, and their words: runs of letters a-z, digits and all that isn't ASCII."""

    def __init__(self, texts: list[str | None]) -> None:
        super().__init__(texts, lower=True)
        self.begin, self.end, self.first = self.words()
        self.hashes = self.word_hashes(self.begin, self.end)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = _APART[self.data]
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edge = np.concatenate(([0], edge))
        begin, end = edge[::2], edge[1::2]
        return begin, end, np.searchsorted(begin, np.concatenate((self.starts, [len(self.data)])))

    def spelled(self, a: int, b: int) -> list[bytes]:
        return [self.data[x:y].tobytes() for x, y in zip(self.begin[a:b], self.end[a:b], strict=True)]


@dataclass(frozen=True)
class Wording:
    label: str
    words: tuple[bytes, ...]


def wordings(passages: tuple[tuple[str, str], ...]) -> list[Wording]:
    out = []
    for label, passage in passages:
        w = Words([passage])
        out.append(Wording(label, tuple(w.spelled(0, len(w.begin)))))
        if len(out[-1].words) < GRAM_WORDS:
            raise ValueError(f"a wording has {GRAM_WORDS} words or more: {passage!r}")
    return out


def places(passages: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int]]:
    """(gram, wording, place) of all wordings."""
    w = Words([p for _, p in passages])
    grams, offset = shingles(w.hashes, w.first, GRAM_WORDS)
    return [(int(g), t, i) for t in range(w.n) for i, g in enumerate(grams[offset[t] : offset[t + 1]].view(np.int64))]


def least_votes(n_words: int) -> int:
    n_places = n_words - GRAM_WORDS + 1
    return n_places if n_words <= EXACT_WORDS else max(1, n_places // VOTES_OF_PLACES)


def in_order(wording: tuple[bytes, ...], words: list[bytes]) -> int:
    """Words of the longest common subsequence; a bit of one integer for each word of the wording."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(wording):
        at[w] = at.get(w, 0) | 1 << i
    mask = (1 << len(wording)) - 1
    rest = mask
    for w in words:
        if met := rest & at.get(w, 0):
            rest = ((rest + met) | (rest - met)) & mask
    return len(wording) - rest.bit_count()


def verified(wording: Wording, words: list[bytes]) -> list[tuple[float, int, int]]:
    """(share, first word, the one after the last) of the wording in these words of a text: all of a short one, one of a longer one."""
    n = len(wording.words)
    if n <= EXACT_WORDS:
        return [(1.0, a, a + n) for a in range(len(words) - n + 1) if tuple(words[a : a + n]) == wording.words]
    share = in_order(wording.words, words) / n
    if share < LEAST_SHARE:
        return []
    known = set(wording.words)  # neither end needs words that the wording doesn't have
    low, high = 0, len(words)
    while words[low] not in known:
        low += 1
    while words[high - 1] not in known:
        high -= 1
    return [(share, low, high)]


def best_spans(found: list[tuple[float, int, int, int]], lengths: list[int]) -> list[tuple[float, int, int, int]]:
    """Of (share, start, end, wording) those that overlap no better one, by start; lengths: the wordings' words."""
    kept: list[tuple[float, int, int, int]] = []
    for s in sorted(set(found), key=lambda s: (-round(s[0] * lengths[s[3]]), -s[0], s[3], s[1])):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[3]))


def _candidates(docs: DataFrame, text: str, passages: tuple[tuple[str, str], ...]) -> DataFrame:
    """(h0, h1, spots): for each text, by its hash, where which wordings may stand (wording, low, high)."""
    spark = docs.sparkSession
    found = places(passages)
    at = spark.createDataFrame(found, "gram long, wording int, place int")
    if len(found) <= BROADCAST_PLACES:
        at = F.broadcast(at)

    def make(_: object):
        def kernel(texts: list[str | None]) -> list:
            w = Words(texts)
            grams, offset = shingles(w.hashes, w.first, GRAM_WORDS)
            grams = grams.view(np.int64)
            return [[grams[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]]

        return kernel

    schema = T.StructType([T.StructField("grams", T.ArrayType(T.LongType()))])
    own = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    rows = own.select(F.monotonically_increasing_id().alias("row"), *_hashes("text"), kernel_column(spark, F.col("text"), schema, make)["grams"].alias("grams"))
    hits = rows.select("row", "h0", "h1", F.posexplode("grams").alias("pos", "gram")).join(at, "gram")
    diagonals = hits.groupBy("row", "h0", "h1", "wording", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    half = F.floor(F.col("diagonal") / (SLACK // 2))
    bins = diagonals.select("*", F.explode(F.array(half, half + 1)).alias("bin")).groupBy("row", "h0", "h1", "wording", "bin")
    lengths = [len(w.words) for w in wordings(passages)]
    enough = F.element_at(F.array(*[F.lit(least_votes(n)) for n in lengths]), F.col("wording") + 1)
    length = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("wording") + 1)
    voted = bins.agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("a"), F.max("diagonal").alias("b")).where(F.col("votes") >= enough)
    spot = F.struct("wording", F.col("a").cast("int").alias("low"), (F.col("b") + length).cast("int").alias("high"))
    return voted.groupBy("h0", "h1").agg(F.collect_set(spot).alias("spots"))


def _hashes(text: str) -> list:
    return [F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1")]


def _scan(passages: tuple[tuple[str, str], ...]):
    """The kernel of the second pass: texts and their spots to the columns of the result."""
    known = wordings(passages)
    lengths = [len(w.words) for w in known]
    phrase_words = Words([p for p, _ in PHRASES])
    phrases = [(phrase_words.hashes[a:b], phrase_words.spelled(a, b), PHRASES[i][1]) for i, (a, b) in enumerate(zip(phrase_words.first[:-1], phrase_words.first[1:], strict=True))]

    def kernel(texts: list[str | None], spots: list[list[dict] | None]) -> list[list]:
        w = Words(texts)
        starts: list[list[int]] = [[] for _ in texts]
        labels: list[set[str]] = [set() for _ in texts]
        text_of = np.repeat(np.arange(w.n), np.diff(w.first))
        for hashes, spelling, label in phrases:
            n = len(hashes)
            if len(w.hashes) < n:
                continue
            same = text_of[: len(text_of) - n + 1] == text_of[n - 1 :]
            for k in range(n):
                same &= w.hashes[k : len(w.hashes) - n + 1 + k] == hashes[k]
            for i in np.flatnonzero(same).tolist():
                if w.spelled(i, i + n) == spelling:
                    starts[text_of[i]].append(i - int(w.first[text_of[i]]))
                    labels[text_of[i]].add(label)
        out: list[list] = [[] for _ in range(8)]
        for t, own in enumerate(spots):
            spans = []
            if own:
                a, b = int(w.first[t]), int(w.first[t + 1])
                for s in own:
                    low, high = max(0, s["low"]), min(b - a, s["high"])
                    found = verified(known[s["wording"]], w.spelled(a + low, a + high))
                    spans += [(share, low + x, low + y, s["wording"]) for share, x, y in found]
                spans = best_spans(spans, lengths)
            names = [known[s[3]].label for s in spans]
            score = max([s[0] for s in spans] + [PHRASE_SCORE * bool(starts[t])])
            made = [{"label": n, "start": s[1], "end": s[2], "share": s[0]} for n, s in zip(names, spans, strict=True)]
            row = (int(w.first[t + 1] - w.first[t]), len(starts[t]), min(starts[t], default=None), max(starts[t], default=None), ",".join(sorted(labels[t])), ",".join(sorted(labels[t] | set(names))), score, made)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return kernel


SPANS = "array<struct<label:string,start:long,end:long,share:double>>"
FIELDS = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text", passages: tuple[tuple[str, str], ...] = PASSAGES) -> DataFrame:
    """The columns `keep`, then n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, start, end, share; in words).

    score: the largest share of a wording that a span carries, PHRASE_SCORE for a phrase without one, else 0.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    spots = cut(_candidates(docs, text, passages))
    size = spots.agg(F.sum(F.size("spots")).alias("n")).first()["n"] or 0
    names = [free_name(docs, n) for n in ("text_", "h0_", "h1_", "spots_")]
    own = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias(names[0]))
    own = own.select("*", *[h.alias(n) for h, n in zip(_hashes(names[0]), names[1:3], strict=True)])
    spots = spots.toDF(*[f"_{c}" for c in spots.columns])
    met = (F.col(names[1]) == F.col("_h0")) & (F.col(names[2]) == F.col("_h1"))
    joined = own.join(F.broadcast(spots) if size <= BROADCAST_CANDIDATES else spots, met, "left").select(*keep, names[0], F.col("_spots").alias(names[3]))
    fields = T._parse_datatype_string(FIELDS)
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = _scan(passages)
        for batch in batches:
            for start, texts in in_slices(batch.column(len(keep))):
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(keep))]
                own = batch.column(len(keep) + 1).slice(start, len(texts)).to_pylist()
                made = [pa.array(c, k) for c, k in zip(kernel(texts, own), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, [*keep, *fields.names])

    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[: len(keep)], *fields.fields]))
