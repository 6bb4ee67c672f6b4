"""Language-model scoring: prediction by partial matching (PPM) over bytes, beside a word-unigram base score.

The model is a byte-context trie of order ORDER, kept as a table: for each context of ORDER bytes and
next byte, how often it occurs in the training texts.  Shorter contexts are marginals of that table.
A byte's probability starts at the longest context.  A byte seen there gets n / (T + D), where T is the
context's total and D its number of different bytes; else the model escapes with D / (T + D) to the
next shorter context, in which the bytes already seen in the longer one are excluded from T and D.  Below the
empty context all bytes not seen there are equally likely.  The probabilities of all symbols after any
context add up to one.

How it is spread over a cluster.  Texts are dealt into chunks of bounded size.  (1) Each task counts its
own words and byte sequences, and the counts are added up by key.  (2) Probabilities are computed in the
table, level by level; a context has at most 255 next bytes, and a key of one level at most 255 keys
above it, so no group is large.  (3) Each chunk asks for just the keys it contains, and is scored with
these.  Nothing that grows with the data is broadcast or sent to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut, ship
from plumbline.llm.bytewords import Batch, in_slices

ORDER = 4
CHUNK_BYTES = 12_000_000
#: Bytes that no UTF-8 text contains: before a text, and its end.
START, END = 0xFE, 0xFF
#: Symbols that can follow a context: all bytes but START.
SYMBOLS = 255
WORD, GRAM = 0, 1
#: The key of the end token among the words.
END_KEY = 0
#: Equal rows are hot if they are more than this share of all; so there are at most its inverse of such rows.
HOT_SHARE, HOT_ROWS = 0.001, 1000
#: Distinct keys that a task gathers before it passes them on.
HELD_KEYS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_codes(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end: the last order + 1 symbols as one number; and each text's first position."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad, end = bytes([START]) * order, bytes([END])
    data = _LOWER[np.frombuffer(b"".join(x for p in parts for x in (pad, p, end)), dtype=np.uint8)].astype(np.uint64)
    code = data[order:].copy()
    for k in range(1, order + 1):
        code |= data[order - k : len(data) - k] << np.uint64(8 * k)
    code = code[(data[order:] != START)]
    first = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    return code, first


def word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word of the texts, with A-Z in lower case, and each text's first word (one more entry)."""
    batch = Batch(texts, lower=True)
    begin, end, first = batch.words()
    return batch.word_hashes(begin, end), first


class _Counts:
    """Keys and how often training texts have them; keys of other texts are there with none."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, train: np.ndarray | None = None) -> None:
        """train: for each key whether it stands in a training text."""
        if not len(keys):
            return
        if train is None or train.all():
            own, n = np.unique(keys, return_counts=True)
        else:
            own, n = np.unique(keys[train], return_counts=True)
            rest = np.setdiff1d(keys[~train], own)
            own, n = np.concatenate((own, rest)), np.concatenate((n, np.zeros(len(rest), dtype=np.int64)))
        self.keys.append(own)
        self.n.append(n)
        self.held += len(own)
        if len(self.keys) >= 24:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys = np.concatenate(self.keys)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate(self.n)[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.keys, self.n = [keys[starts]], [np.add.reduceat(n, starts)]
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.held = len(self.keys[0])
        return self.keys[0], self.n[0]


def _count_slice(words: _Counts, grams: _Counts, texts: list[str | None], train: np.ndarray) -> None:
    h, first = word_keys(texts)
    words.add(h, np.repeat(train, np.diff(first)))
    ends = int(train.sum())
    words.add(np.full(ends or 1, END_KEY, dtype=np.uint64), np.full(ends or 1, bool(ends)))
    code, first = gram_codes(texts)
    grams.add(code, np.repeat(train, np.diff(first)))


def _key_rows(counts: dict[int, _Counts]) -> pa.RecordBatch:
    got = [(kind, *c.merge()) for kind, c in counts.items()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.full(len(k), kind, dtype=np.int8) for kind, k, _ in got])),
            pa.array(np.concatenate([k.view(np.int64) for _, k, _ in got])),
            pa.array(np.concatenate([n.astype(np.int64) for _, _, n in got])),
        ],
        ["kind", "key", "n"],
    )


def _count_partition(batches):
    counts = {WORD: _Counts(), GRAM: _Counts()}
    for batch in batches:
        train = np.array(batch["train"].to_pylist(), dtype=bool)
        for a, texts in in_slices(batch["text"]):
            _count_slice(counts[WORD], counts[GRAM], texts, train[a : a + len(texts)])
            if sum(c.held for c in counts.values()) > HELD_KEYS:
                for c in counts.values():
                    c.merge()
                if sum(c.held for c in counts.values()) > HELD_KEYS // 2:
                    yield _key_rows(counts)
                    counts = {WORD: _Counts(), GRAM: _Counts()}
    yield _key_rows(counts)


def _chunk_keys(key: tuple, group: pa.Table) -> pa.Table:
    """The keys that a chunk contains."""
    counts = {WORD: _Counts(), GRAM: _Counts()}
    for batch in group.select(["text"]).to_batches():
        for _, texts in in_slices(batch["text"]):
            _count_slice(counts[WORD], counts[GRAM], texts, np.ones(len(texts), dtype=bool))
    rows = _key_rows(counts)
    return pa.table({"chunk": pa.array(np.full(rows.num_rows, key[0].as_py(), dtype=np.int64)), "kind": rows["kind"], "key": rows["key"]})


class Lookup:
    """Finds keys among n distinct ones by multiplicative hashing into tables; what collides goes to the next table."""

    MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int64)
        level = 0
        while len(left):
            bits = max(4, int(len(left) - 1).bit_length() + 2)
            multiplier = np.uint64((self.MULTIPLIERS[level % 4] + 2 * level * 0x51ED2701) % 2**64 | 1)
            shift = np.uint64(64 - bits)
            slot = ((keys[left] * multiplier) >> shift).astype(np.int64)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((multiplier, shift, table))
            left = left[table[slot] != left]
            level += 1

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Each asked key's place, or -1."""
        out = np.full(len(asked), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        left = None
        for multiplier, shift, table in self.tables:
            q = asked if left is None else asked[left]
            at = table[(q * multiplier) >> shift]
            hit = (at >= 0) & (self.keys[at] == q)
            if left is None:
                out = np.where(hit, at, -1).astype(np.int64)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = at[hit]
                left = left[~hit]
            if not len(left):
                break
        return out


def _score_chunk(key: tuple, docs: pa.Table, model: pa.Table) -> pa.Table:
    """The texts of a chunk, scored with the rows (kind, key, n, log10_p) of the keys it contains."""
    kind = model["kind"].to_numpy()
    keys = model["key"].to_numpy().view(np.uint64)
    n, log_p = model["n"].to_numpy(), model["log10_p"].to_numpy()
    words, grams = Lookup(keys[kind == WORD]), Lookup(keys[kind == GRAM])
    word_n, word_p, gram_p = n[kind == WORD], log_p[kind == WORD], log_p[kind == GRAM]
    out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
    end = words.find(np.array([END_KEY], dtype=np.uint64))[0]
    for batch in docs.select(["text"]).to_batches():
        for _, texts in in_slices(batch["text"]):
            h, first = word_keys(texts)
            at = words.find(h)
            known = np.concatenate(([0], np.cumsum(word_n[at] > 0)))
            for i in range(len(texts)):
                x, y = first[i], first[i + 1]
                out["base_score"].append(math.fsum(word_p[at[x:y]]) + word_p[end])
            out["n_tokens"] += (np.diff(first) + 1).tolist()
            out["n_known"] += (known[first[1:]] - known[first[:-1]] + (word_n[end] > 0)).tolist()
            code, first = gram_codes(texts)
            out["score"] += np.add.reduceat(gram_p[grams.find(code)], first[:-1]).tolist()
    return pa.table(
        {
            "key": docs["key"].combine_chunks().cast(pa.struct([("k1", pa.int64()), ("k2", pa.int64())])),
            "doc_id": docs["doc_id"].combine_chunks(),
            "held_out": docs["held_out"].combine_chunks(),
            "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array(out["n_known"], pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()),
            "score": pa.array(out["score"], pa.float64()),
        }
    )


def gram_log_probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, log10_p) for each context-and-symbol key, from (key, n): n the training count, 0 for keys of other texts.

    Level k has the last k bytes of the context and the symbol.  `below` is the symbol's probability once
    level k has been left by its escape, with the symbols seen at level k excluded.
    """
    levels = [grams.select("key", "n")]
    for k in range(order - 1, -1, -1):
        short = levels[-1].select(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key"), "n")
        levels.append(short.groupBy("key").agg(F.sum("n").alias("n")))
    levels.reverse()

    def context(k: int):
        return F.shiftrightunsigned("key", 8) if k else F.lit(0)

    lowest = levels[0].agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds"))
    known = levels[0].crossJoin(F.broadcast(lowest)).withColumn("below", F.lit(1.0) / F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1)))
    for k in range(1, order + 1):
        over = Window.partitionBy("context")
        shorter = known.select(F.col("key").alias("short"), *[F.col(c).alias(f"s_{c}") for c in ("n", "total", "kinds", "below")])
        mask = (1 << 8 * k) - 1
        here = levels[k].withColumn("short", F.col("key").bitwiseAND(F.lit(mask))).withColumn("context", context(k))
        if k <= 1:
            shorter = F.broadcast(shorter)  # at most SYMBOLS rows
        here = here.join(shorter, "short")
        here = here.withColumn("total", F.sum("n").over(over)).withColumn("kinds", F.count_if(F.col("n") > 0).over(over))
        excluded = F.sum(F.when(F.col("n") > 0, F.col("s_n")).otherwise(0)).over(over)
        here = here.withColumn("free", F.col("s_total") - excluded).withColumn("free_kinds", F.col("s_kinds") - F.col("kinds"))
        room = F.col("free") + F.col("free_kinds")
        below = (
            F.when(room <= 0, F.col("s_below"))
            .when(F.col("s_n") > 0, F.col("s_n") / F.greatest(room, F.lit(1)))
            .otherwise(F.col("free_kinds") / F.greatest(room, F.lit(1)) * F.col("s_below"))
        )
        known = here.withColumn("below", below).select("key", "n", "total", "kinds", "below")
    whole = F.col("total") + F.col("kinds")
    p = F.when(F.col("n") > 0, F.col("n") / F.greatest(whole, F.lit(1))).when(F.col("kinds") == 0, F.col("below"))
    return known.select("key", "n", F.log10(p.otherwise(F.col("kinds") / F.greatest(whole, F.lit(1)) * F.col("below"))).alias("log10_p"))


def score_texts(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each whole text.

    held_out: a condition; rows where it is false or null are the training texts.  A null text counts as empty
    and has the end token only.  Words are compared by 64-bit hashes.  Repeated rows are counted and scored
    each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        docs[doc_id].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(size / 4_000_000)))
    counted = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count_partition, "kind byte, key long, n long")
    counts = cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = counts.where(F.col("kind") == WORD).agg(F.sum("n").alias("train_tokens"), F.count_if(F.col("n") > 0).alias("types"))
    totals = totals.select(F.coalesce("train_tokens", F.lit(0)).alias("train_tokens"), "types")
    words = counts.where(F.col("kind") == WORD).crossJoin(F.broadcast(totals))
    words = words.select("kind", "key", "n", F.log10((F.col("n") + 1) / (F.col("train_tokens") + F.col("types") + 1)).alias("log10_p"))
    grams = gram_log_probabilities(counts.where(F.col("kind") == GRAM))
    model = words.union(grams.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "n", "log10_p"))
    # Equal rows have one key and would fill one chunk.  Where they are many, one of them is scored for all.
    keyed = rows.withColumn("key", F.struct(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")))
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out")).where(F.col("copies") > HOT_ROWS)
    hot = cut(copies.where(F.col("copies") > HOT_SHARE * rows.count()))
    if hot.isEmpty():
        dealt, hot = keyed, None
    else:
        few = F.broadcast(hot.select("key"))
        dealt = keyed.join(few, "key", "left_anti").unionByName(keyed.join(few, "key", "left_semi").dropDuplicates(["key"]))
    dealt = dealt.withColumn("chunk", F.pmod(F.col("key.k1"), F.lit(chunks)))
    asked = dealt.groupBy("chunk").applyInArrow(_chunk_keys, "chunk long, kind byte, key long")
    answers = asked.join(model, ["kind", "key"]).select("chunk", "kind", "key", "n", "log10_p")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score_chunk, "key struct<k1:long,k2:long>, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    if hot is not None:
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1))))
        scored = scored.join(F.broadcast(hot.select("key", "copies")), "key", "left").select(*scored.columns, times.alias("copy"))
    out = scored.crossJoin(F.broadcast(totals.select("train_tokens")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
