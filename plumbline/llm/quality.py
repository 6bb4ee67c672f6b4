"""Quality classifier by compression: which of two dictionaries, built from good and from bad text, fits better.

A text's blocks are compressed with either zstandard dictionary.  The difference of the compressed
sizes, for each byte of the text, is turned into a calibrated score by a logistic curve that also
sees how compressible and how short the text is.  Texts are cut into blocks because a long text
would otherwise fill the compressor's window and leave the dictionary unused.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.texts import kernel_column

#: Bounds of the training sample, for each class: rows, and characters of their texts.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 6_000_000
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 2048
#: Bytes that are added to a text's length, so that a few bytes more or less don't decide short texts.
SOFT_BYTES = 200
LEVEL = 3

SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)] or [b""]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    blocks = [b for t in texts for b in _blocks(t.encode("utf-8", "surrogatepass")) if b]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed sizes of a text with the good and with the bad dictionary, and its own size."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.with_good, self.with_bad = self._compressor(good), self._compressor(bad)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None
        if held:
            held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for block in _blocks(raw):
            good += len(self.with_good.compress(block))
            bad += len(self.with_bad.compress(block))
        n = len(raw) + SOFT_BYTES
        return 1.0, (bad - good) / n * 20, (bad + good) / n, SOFT_BYTES / n


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, penalty: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Whole texts with their labels, within the sample's bounds, and how many labelled ids each class has.

    The ids come in the order of their hash, so a rerun has the same sample.  Ids with labels that contradict each other aren't
    used.  Of several texts of one id the shortest is used, so that a hot id stays within the bounds.
    """
    rows = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q_max")).where("q = q_max").select("doc_id", "q")
    counts = {r["q"]: r["n"] for r in rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [r for q in (0, 1) for r in rows.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()]
    spark = docs.sparkSession
    if not ids:
        return [], counts
    chosen = spark.createDataFrame([(r["doc_id"], r["q"]) for r in ids], "doc_id long, q int")
    named = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    sizes = named.join(F.broadcast(chosen), "doc_id").select("doc_id", "q", size.alias("size")).groupBy("doc_id", "q").agg(F.min("size").alias("size"))
    used, spent = [], {0: 0, 1: 0}
    for r in sizes.orderBy("q", F.xxhash64("doc_id"), "doc_id").collect():
        if spent[r["q"]] + r["size"]["n"] <= SAMPLE_CHARS:
            spent[r["q"]] += r["size"]["n"]
            used.append((r["doc_id"], r["q"], r["size"]["n"], r["size"]["h"]))
    if not used:
        return [], counts
    kept = spark.createDataFrame(used, "doc_id long, q int, n int, h long")
    same = (named["doc_id"] == kept["doc_id"]) & (F.length(named["text"]) == kept["n"]) & (F.xxhash64(named["text"]) == kept["h"])
    got = named.join(F.broadcast(kept), same).select(kept["doc_id"], "q", "text").dropDuplicates(["doc_id"]).collect()
    return [(r["text"], r["q"]) for r in sorted(got, key=lambda r: r["doc_id"])], counts


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries of good and bad text, and the curve's weights, from the labelled rows where train holds.

    Every other sampled text goes into its class's dictionary, the rest into the calibration, where each
    class weighs as much as all its labelled ids.  With fewer than two classes every score is the share
    of label 1 (0.5 without labels).  A null id has no label, a null text counts as empty, repeated labels count once; empty
    tables give a model that scores 0.5; columns but doc_id, text and quality are ignored, whatever their names.
    """
    sample, counts = training_sample(docs, labels, train)
    halves: dict[tuple[int, int], list[str]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for i, (text, q) in enumerate(sample):
        halves[q, i % 2].append(text)
    if not all(halves.values()):
        total = sum(counts.values())
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return b"", b"", [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]
    good, bad = _dictionary(halves[1, 0]), _dictionary(halves[0, 0])
    sizes = _Sizes(good, bad)
    x = np.array([sizes.features(t) for q in (0, 1) for t in halves[q, 1]])
    y = np.repeat([0.0, 1.0], [len(halves[0, 1]), len(halves[1, 1])])
    weight = np.where(y == 1, counts[1] / len(halves[1, 1]), counts[0] / len(halves[0, 1]))
    return good, bad, _logistic(x, y, weight / weight.mean()).tolist()


def _scorer(model):
    good, bad, weights = model
    sizes, w = _Sizes(good, bad), np.array(weights)

    def kernel(texts: list[str | None]) -> list:
        if not texts:
            return [[]]
        return [1 / (1 + np.exp(-np.clip(np.array([sizes.features(t) for t in texts]) @ w, -30, 30)))]

    return kernel


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]], text: str = "text") -> Column:
    """The score of each whole text, 0 to 1, higher where label 1 is likelier; a null text counts as empty.

    Equal texts have equal scores; an empty table has none; only the text is looked at.
    The model (two dictionaries of at most DICTIONARY_BYTES and four numbers) is broadcast.
    """
    return kernel_column(docs.sparkSession, docs[text], SCORE, _scorer, model)["score"]
