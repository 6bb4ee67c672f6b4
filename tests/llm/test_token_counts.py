"""Token counts against the other library on long white space and letters newer than the library's, and clashing names."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import token_counts
from plumbline.llm.texts import read_public_file


def test_long_white_space_with_newer_letters():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = token_counts.encoding(read_public_file(None, token_counts.VOCABULARY))
    rng = random.Random(4)
    letters = ["\U0003ea97", "\U000323b0", "ౝ", "\U0001e030", "a", "é", "'s", " ", "\n", "1", "٣", "!", " "]
    for _ in range(300):
        tail = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
        for text in (tail, " " * 2500 + tail, tail + "\n \t" * 900 + tail, "\x85" * 2100 + tail):
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert token_counts.count_tokens(own, text) == want, repr(tail)


def test_clashing_names(spark):
    rows = spark.createDataFrame([("a", "x", 3), ("a", None, 3), ("b", "x", 5), ("b", "x", 0)], "n_docs string, block_ string, n_tokens long")
    got = token_counts.length_histogram(rows, ["n_docs", "block_"])
    assert got.columns[:4] == ["n_docs_", "block_", "n_tokens", "n_docs"]
    assert sorted((r["n_docs_"], r["block_"] or "", r["n_tokens"], r["docs_at_least"]) for r in got.collect()) == [("a", "", 3, 1), ("a", "x", 3, 1), ("b", "x", 0, 2), ("b", "x", 5, 1)]
