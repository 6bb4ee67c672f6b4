"""License scan against plain patterns and plain searches."""

import random
import re

import pytest

from plumbline.llm import licenses as li
from plumbline.llm.license_texts import PASSAGES

FILLER = "der la and of the software license mit general with une Ünder x9 public to any".split()


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spots_ int").repartition(3)
    return {r["doc_id"]: r for r in li.scan_licenses(docs, ["doc_id"]).collect()}


def base(text):
    w = words(text)
    at = [(i, label) for p, label in li.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def filler(rng, n):
    return " ".join(rng.choice(FILLER) + rng.choice(["", "", ",", ".\n", "-", " "]) for _ in range(n))


def test_base_columns_and_short_wordings(spark):
    rng = random.Random(5)
    pieces = ["MIT License", "mit\tlicense", "Apache-License", "GENERAL public. License", "mit license mit license", "licensed under CC BY-NC", "licensed under CC BY", "Released under the MIT License", "ſ mit licensé"]
    texts = [None, "", " \n", "mit", "license mit"] + [" ".join(rng.choice([rng.choice(pieces), filler(rng, rng.randrange(6))]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    got = scan(spark, texts)
    short = [(w.label, [x.decode() for x in w.words]) for w in li.wordings(PASSAGES) if len(w.words) <= li.EXACT_WORDS]
    for i, text in enumerate(texts):
        r, w = got[i], words(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text
        there = [(1.0, a, a + len(x), n, label) for n, (label, x) in enumerate(short) for a in range(len(w)) if w[a : a + len(x)] == x]
        best = li.best_spans([s[:4] for s in there], [len(x) for _, x in short])
        assert [(s["label"], s["start"], s["end"]) for s in r["spans"]] == [(short[s[3]][0], s[1], s[2]) for s in best], text
        assert set(r["labels"].split(",")) - {""} == {x for x in base(text)[4].split(",") if x} | {short[s[3]][0] for s in best}
        assert r["score"] == (1.0 if best else li.PHRASE_SCORE if r["n_base"] else 0.0)


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.15])
def test_edited_wordings_are_found_and_nothing_else(spark, rate):
    rng = random.Random(8)
    long = [(label, p) for label, p in PASSAGES if len(words(p)) > li.EXACT_WORDS]
    texts, truth = [], []
    for _ in range(6):
        for label, p in long:
            copy = []
            for x in p.split():
                k = rng.random()
                copy += [] if k < rate / 3 else [x, "zz"] if k < 2 * rate / 3 else ["zz"] if k < rate else [x]
            texts.append(f"{filler(rng, 40)} {' '.join(copy)} {filler(rng, 40)}")
            truth.append(label)
    texts += [filler(rng, 400) for _ in range(40)]
    got = scan(spark, texts)
    found = reach = 0
    for i, label in enumerate(truth):
        shares = [li.in_order(w.words, [x.encode() for x in words(texts[i])]) / len(w.words) for w in li.wordings(PASSAGES) if w.label == label and len(w.words) > li.EXACT_WORDS]
        if max(shares) >= li.LEAST_SHARE:
            hit = any(s["label"] == label and s["start"] < 160 for s in got[i]["spans"])
            found, reach = found + hit, reach + 1
            assert hit or rate > 0.1, texts[i]
    assert found >= 0.98 * reach and reach >= 0.95 * len(truth)
    assert not any(s for i in range(len(truth), len(texts)) for s in got[i]["spans"])


def test_common_subsequence_equals_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert li.in_order(tuple(a), b) == table[-1][-1]


def test_copies_long_texts_and_empty_tables(spark, monkeypatch):
    mit = next(p for label, p in PASSAGES if label == "mit" and len(p) > 300)
    text = "word " * 50_000 + mit
    for bound in (li.BROADCAST_CANDIDATES, 0):
        monkeypatch.setattr(li, "BROADCAST_CANDIDATES", bound)
        got = scan(spark, [text] * 5 + ["mit " * 3000] + [None] * 3)
        assert [got[i]["labels"] for i in range(9)] == ["mit"] * 5 + [""] * 4
        assert all((got[i]["spans"][0]["start"], got[i]["spans"][0]["share"]) == (50_000, 1.0) for i in range(5))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert li.scan_licenses(empty, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        li.wordings((("x", "two words"),))
