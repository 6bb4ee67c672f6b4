"""Exact histogram of encoded lengths, with suffix sums for every context limit.

One row for each distinct length L (and each value of `by`): how many documents have it, how many are
at least that long, and what truncating at L leaves.  From it, totals, quantiles and truncated totals
for any limit follow without another look at the texts.
"""

from __future__ import annotations

import base64
import re

import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut
from plumbline.llm.bpe import _HAS_NEWER, OLDER_PIECES, PIECES
from plumbline.llm.texts import read_public_file, with_kernel

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The library's pattern engine overflows its stack on longer runs of white space.
_LONG_SPACE = re.compile(r"[\s\x85]{2000}").search

_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(content: bytes) -> tiktoken.Encoding:
    """One encoding for each Python worker and vocabulary."""
    key = hash(content)
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(own: tiktoken.Encoding, text: str | None) -> int:
    if not text:
        return 0
    if _LONG_SPACE(text):  # cut as the library cuts, which doesn't know the newest letters
        pieces = regex.findall(OLDER_PIECES, text, regex.V1) if _HAS_NEWER(text) else regex.findall(PIECES, text)
        return sum(len(own._encode_single_piece(p)) for p in pieces)
    return len(own.encode_ordinary(text))


def _counter(content: bytes):
    own = encoding(content)
    return lambda texts: [[count_tokens(own, t) for t in texts]]


LENGTHS = T.StructType([T.StructField("n_tokens", T.LongType())])


def token_lengths(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens, the encoded length of the whole text (null or empty: 0)."""
    return with_kernel(docs, keep, text, LENGTHS, _counter, read_public_file(vocabulary, VOCABULARY))


#: Columns of the histogram.
HISTOGRAM = ("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens", "truncated_tokens", "share_below")


def length_histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Suffix sums over the histogram of n_tokens, for each value of `by` (nulls are a value).

    Columns: by..., n_tokens (L), n_docs, docs_at_least (length >= L), tokens_at_least, total_docs,
    total_tokens, truncated_tokens (sum of min(length, L) over all), share_below (documents of length
    <= L over all: L is the quantile of that order).  An empty table gives no rows.  A column of `by` that is called like one of
    the results gets an underscore behind its name.

    Rows are combined before the shuffle, and written before they are summed, so that no text is encoded twice.  The sums run
    inside blocks of lengths with the same whole square root, and over the blocks' totals: for lengths up to n no task sees
    more than about 2 * sqrt(n) rows for each value of `by`.
    """
    names = list(by or [])
    by = [f"by_{i}" for i in range(len(names))]
    block, later_docs, later_tokens = "block_", "later_docs", "later_tokens"
    lengths = lengths.select(*[F.col(c).alias(k) for c, k in zip(names, by, strict=True)], "n_tokens")
    rows = cut(lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    rows = rows.withColumn(block, F.floor(F.sqrt("n_tokens")))
    blocks = rows.groupBy(*by, block).agg(
        F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens")
    )
    over = Window.partitionBy(*by).orderBy(F.col(block).desc())
    later = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *[F.col(c).alias(f"{c}_") for c in by],
        F.col(block).alias("own_block_"),
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias(later_docs),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias(later_tokens),
        F.sum("block_docs").over(whole).alias("total_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    same = F.col(block) == F.col("own_block_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    inside = Window.partitionBy(*by, block).orderBy(F.col("n_tokens").desc())
    out = rows.join(blocks, same)
    at_least = F.sum("n_docs").over(inside) + F.col(later_docs)
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col(later_tokens)
    out = out.withColumn("docs_at_least", at_least).withColumn("tokens_at_least", tokens)
    below = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        *[F.col(k).alias(f"{c}_" if c.lower() in HISTOGRAM else c) for k, c in zip(by, names, strict=True)],
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        (below / F.col("total_docs")).alias("share_below"),
    )
