"""The text operators: edge cases, and results against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from held_out_lines import held_out

from plumbline.llm import automaton, bpe, components, decontaminate, line_dedup, lm, near, pii, pii_field, quality, rules, secrets, token_counts
from plumbline.llm.texts import read_public_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ra", "to", "mi", "len", "sk", "ou", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_documents():
    """Nulls in any column, empty and very long texts, ties and repeated rows, and the like."""
    a, b = passage(1), passage(2)
    rows = [
        (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t\n ", "en", None, 5), (4, a, "en", "s", 9), (5, a, "en", "s", 9), (5, a, "en", "s", 9),
        (6, b + "\n" + a, "fr", "s", 9), (None, b, "en", "s", 9), (None, None, None, None, None), (7, "x" * 300_000, "de", "s", 9),
        (8, "\n".join(["one two three"] * 3000), "en", "s", 9), (9, "short", "xx", "s", 5), (10, a + " <|endoftext|> " + "é中\U0001f600", "en", "s", 9),
        (11, " ".join(map(str, range(4000))), "es", "s", 9), (12, b.replace("ra", "RA", 1), "en", "s", 9), (13, " " * 50_000 + "end", "en", "s", 9),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    extra = [F.lit(1).alias(c) for c in ("row", "removed", "score", "matches", "n_tokens", "spans", "kept", "v", "bucket", "key_")]
    return spark.createDataFrame(odd_documents(), SCHEMA).select("*", *extra)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(i, i) for i in (1, 2)] + [(-5, 7), (7, 9), (9, -5)]
    rng.shuffle(edges)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {500 + i: 500 for i in range(40)} | {-5: -5, 7: -5, 9: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secret_rules_equal_plain_patterns():
    rng = random.Random(3)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ": ", '"', "abc", "12345678", "AKIA", "ABCDEFGH12", "deadbeef", " ", "é", "_", "ſecret", "Key"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 16)))
        assert sorted(plain_secrets(t)) == sorted(secrets.base_spans(t)), t


def test_random_strings_are_told_from_digests_and_identifiers(spark):
    secret = "q7ZpX0vLm3KdT9wRbY2n"
    texts = [f"use {secret} now", "sha1 " + "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301", "the internationalization_of_software_systems", "VERY_LONG_CONSTANT_NAME_2024", "https://example.com/some/long/path/to/a/page"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df, ["doc_id"]).collect()}
    assert got[0] == f"random:4:{4 + len(secret)}" and not any(got[i] for i in range(1, len(texts)))


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef", "0123456789ABCDEF"]
ALPHABETS += [ALPHABETS[0] + ALPHABETS[1], ALPHABETS[0] + ALPHABETS[2], ALPHABETS[1] + ALPHABETS[2], ALPHABETS[0] + ALPHABETS[1] + ALPHABETS[2]]
ALPHABETS += [ALPHABETS[-1] + "+/", ALPHABETS[-1] + "-_", ALPHABETS[1] + "234567"]
IDENTIFIERS = """internationalization_of_software_systems VERY_LONG_CONSTANT_NAME_2024 getUserAccountByIdentifier AbstractSingletonProxyFactoryBean
x86_64-unknown-linux-gnu org/apache/spark/sql/catalyst/expressions MAX_CONNECTIONS_PER_HOST 2024-01-05T10-30-00 utf8mb4_unicode_ci a/b/c/d/e/f/g/h/i/j
responsibilities acknowledgements disproportionately kubernetes-dashboard-metrics-scraper feature/JIRA-1234-fix-login node_modules/react-dom/cjs
ISO8859_15_ENCODING 978-3-16-148410-0 4111-1111-1111-1111 0123456789012345 SELECT_STATEMENT_TIMEOUT application/json-patch+json""".split()


def test_random_strings_of_every_alphabet():
    own = token_counts.encoding(read_public_file(None, token_counts.VOCABULARY))
    rng = random.Random(1)

    def count(s):
        return len(own.encode_ordinary(s))

    for letters in ALPHABETS:
        for n in (20, 27, 41):
            runs = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(400)]
            found = [secrets.random_spans(f"say {r}.", count) == [("random", 4, 4 + n)] for r in runs]
            assert sum(found) >= 0.95 * len([r for r in runs if r[0] not in "+/-_" and r[-1] not in "+/-_"]) - 4, (letters, n)
    assert not [s for s in IDENTIFIERS if secrets.random_spans(s, count)]
    key = "q7ZpX0vLm3KdT9wRbY2n"
    for text in (f"Schl\u00fcssel={key}", f"{key} \u00fcber", f"{key}\u3001", f"\u5bc6\u7801{key}", f"cl\u00e9-{key}-\u00e9"):
        assert [text[a:b] for _, a, b in secrets.random_spans(text, count)] == [key]
    for text in (f"\u00e9{key}", f"{key}\u00df", "chte\u00e4einpfauaueinchpfenau\u00e4"):
        assert secrets.random_spans(text, count) == []


def plain_random(t, count):
    """The random kind by trying every start and end."""
    allowed, out, k = set("+/_=-" + ALPHABETS[8]), [], 0
    while k < len(t):
        n = k
        while n < len(t) and t[n] in allowed:
            n += 1
        run = t[k:n]
        begin = 0
        if k and t[k - 1].isalpha():
            begin = next((i for i, c in enumerate(run) if c in "+/_=-"), len(run))
        if n < len(t) and t[n].isalpha():
            run = run[: next((i for i in range(len(run) - 1, begin - 1, -1) if run[i] in "+/_=-"), begin)]
        run = " " * begin + run[begin:] if begin else run
        left = len(run) - len(run.lstrip("+/_=- "))
        s = run.strip("+/_=- ")
        if len(s) >= secrets.MIN_CHARS and secrets.is_random(s, count):
            out.append(("random", k + left, k + left + len(s)))
        k = n + 1
    taken = {x for _, a, b in secrets.base_spans(t) for x in range(a, b)}
    return [x for x in out if not taken & set(range(x[1], x[2]))]


def test_random_spans_equal_brute_force():
    rng = random.Random(6)
    bits = [" ", "=", "-", "+", "token=", "deadbeef" * 3, "word", "q7ZpX0vLm3KdT9wRbY2n", "ABCD", "9", "é", "\n", "kxqzvjwpgh"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert sorted(secrets.without_overlaps(secrets.random_spans(t, lambda s: len(s) // 2 + 1), secrets.base_spans(t))) == sorted(plain_random(t, lambda s: len(s) // 2 + 1)), t


# --- 2 ---------------------------------------------------------------------------------------------


def test_histogram_answers_totals_and_truncation(spark):
    lengths = [0, 0, 1, 5, 5, 1023, 1024, 1025, 9000]
    df = spark.createDataFrame([(n, "a") for n in lengths] + [(3, None)], "n_tokens long, source string")
    rows = token_counts.length_histogram(df, ["source"]).collect()
    own = {r["n_tokens"]: r for r in rows if r["source"] == "a"}
    for limit, r in own.items():
        at_least = [n for n in lengths if n >= limit]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(limit), len(at_least), sum(at_least))
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths) and r["total_tokens"] == sum(lengths)
        assert r["share_below"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    assert [r["truncated_tokens"] for r in rows if r["source"] is None] == [3]
    assert token_counts.length_histogram(df.limit(0)).count() == 0


def test_token_counts_equal_the_other_library(odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for r in token_counts.token_lengths(odd, ["text"]).collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)


# --- 3 ---------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = quality.remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(documents, labels, ~held)
    rows = documents.select("doc_id", quality.score(documents, model).alias("s"), held.alias("h")).join(labels, "doc_id").collect()
    test = [(r["s"], r["quality"]) for r in rows if r["h"]]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(0 <= s <= 1 for s, _ in test)


def test_the_compressed_sizes_carry_the_score():
    table = "/root/testdata/sf0.1/{}.parquet"
    if not os.path.exists(table.format("labels")):
        pytest.skip("needs the larger tables")
    import pyarrow.parquet as pq

    texts = dict(zip(*[c.to_pylist() for c in pq.read_table(table.format("documents"), columns=["doc_id", "text"]).columns], strict=True))
    labels = [(i, q) for i, q in zip(*[c.to_pylist() for c in pq.read_table(table.format("labels"), columns=["doc_id", "quality"]).columns], strict=True) if i in texts]
    train = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5]
    halves = {(q, h): [texts[i] for k, (i, y) in enumerate(train) if y == q and k % 2 == h] for q in (0, 1) for h in (0, 1)}
    sizes = quality._Sizes(quality._dictionary(halves[1, 0]), quality._dictionary(halves[0, 0]))
    x, y = (np.array(v) for v in zip(*[(sizes.features(texts[i]), q) for i, q in train], strict=True))
    held, truth = (np.array(v) for v in zip(*[(sizes.features(texts[i]), q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0], strict=True))

    def area(columns):
        score = held[:, columns] @ quality._logistic(x[:, columns], y, np.ones(len(y)))
        return np.mean(score[truth == 1][:, None] > score[truth == 0][None, :])

    assert area([0, 1, 2, 3]) > 0.98 and area([0, 1]) > 0.98 and area([0, 2, 3]) < area([0, 1]) - 0.05


def test_a_hot_id_stays_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 1000)
    docs = spark.createDataFrame([(1, "x" * n) for n in (900, 800, 100)] * 20 + [(2, "y" * 950), (3, None), (4, "z" * 2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    got = quality.training_sample(docs, labels, F.lit(True))[0]
    assert sorted((len(t), q) for t, q in got) == [(0, 1), (100, 1), (950, 0)] and got == quality.training_sample(docs, labels, F.lit(True))[0]


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, none, F.lit(True))
    assert {r[0] for r in odd.select(quality.score(odd, model)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 1), (6, 1), (8, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    assert len({r[0] for r in odd.select(quality.score(odd, quality.fit(odd, one, F.lit(True)))).collect()}) == 1
    both = spark.createDataFrame([(4, 1), (6, 1), (8, 0), (7, 0), (11, 0), (5, 1)], "doc_id long, quality int")
    scores = odd.select(quality.score(odd, quality.fit(odd, both, F.lit(True)))).collect()
    assert len(scores) == len(odd_documents()) and all(0 <= r[0] <= 1 for r in scores)
    crc = spark.createDataFrame([(17,), (None,)], "i long").select(quality.remainder(F.col("i"), 5)).collect()
    assert [r[0] for r in crc] == [zlib.crc32(b"17") % 5, None]


# --- 4 ---------------------------------------------------------------------------------------------


def plain_lines(rows, least=line_dedup.MIN_CHARS):
    def close(x, y):
        if x == y:
            return True
        if abs(len(x) - len(y)) > 1:
            return False
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return x[k + 1 :] == y[k + 1 :] or x[k:] == y[k + 1 :] or x[k + 1 :] == y[k:]

    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            near = [s for s in seen if s == line or min(len(s), len(line)) >= least and close(line, s)]
            if words(line):
                seen.append(line)
            if not words(line) or not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("broadcast,hot", [(200_000, 1000), (0, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    rng = random.Random(5)
    bases = [passage(s, 6) for s in range(8)] + ["a" * 30, "ab" * 15, "é\U0001f600" * 14]

    def edited(x):
        k, c = rng.randrange(len(x) + 1), rng.choice(["a", "b", "é", " "])
        return rng.choice([x, x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :]])

    rows = []
    for i in range(40):
        lines = [edited(edited(rng.choice(bases))) for _ in range(rng.randint(0, 5))] + rng.choice([[], ["short"], [""], [" \t"], ["}"]])
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == plain_lines(rows)
    exact = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, max_edits=0).collect()}
    assert sum(exact.values()) < sum(r["n_removed"] for r in line_dedup.dedup_lines(df).collect())


def test_lines_edges(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(odd_documents()) and set(out.columns) == {*odd.columns, "n_lines", "n_removed"}
    rows = {(r["doc_id"], r["n_chars"]): r for r in out.collect()}
    assert rows[1, None]["text"] is None and rows[1, None]["n_lines"] == 0 and rows[2, 0]["n_lines"] == 1
    assert rows[4, 9]["n_removed"] == 0 and rows[5, 9]["text"] == "" and rows[6, 9]["text"] == passage(2) and rows[None, 9]["text"] == ""
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.removed_lines(odd, max_edits=2)


# --- 5 ---------------------------------------------------------------------------------------------


def plain_near(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    reps = sorted(first.values())
    links, parent = Counter(), {i: i for i in reps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(reps)):
        for y in range(x):
            a, b = sets[reps[x]], sets[reps[y]]
            if 10 * len(a & b) >= 8 * len(a | b):
                links[reps[x]] += 1
                links[reps[y]] += 1
                p, q = sorted((root(reps[x]), root(reps[y])))
                parent[q] = p
    return {i: (root(first[s]), first[s], links[first[s]]) if s else (i, i, 0) for i, s in sets.items()}


def near_copies(n_groups=6, n_copies=12, seed=2):
    rng, rows, i = random.Random(seed), [], 0
    for g in range(n_groups):
        base = words(passage(100 + g, 300))
        for _ in range(n_copies):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(["changed", "edited"])
            rows.append((i, " ".join(w)))
            i += 1
    return rows + [(i + k, t) for k, t in enumerate(["", "one", "one", "one two three four", " \n"])]


@pytest.mark.parametrize("block,node", [(1000, 2000), (5, 4)])
def test_near_copies_equal_brute_force(spark, monkeypatch, block, node):
    monkeypatch.setattr(near, "BLOCK_TEXTS", block)
    monkeypatch.setattr(near, "NODE_TEXTS", node)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["text_class_id"], r["n_links"]) for r in near.near_duplicates(df).collect()}
    want = plain_near(rows)
    assert any(v[2] for v in want.values()) and got == want


def test_depth_leaves_the_target_recall():
    assert near.depth_for(0) == near.DEPTH and near.depth_for(near.TREES) < near.DEPTH
    for heavy in range(1, near.TREES + 1):
        d = near.depth_for(heavy)
        missed = (1 - 0.8**near.LEAST) ** (near.TREES - heavy) * (1 - 0.8**d) ** heavy
        assert near.LEAST < d and missed <= 1 - near.TARGET_RECALL


def test_common_counts_in_strips(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]
    for strip in (2048, 7):
        monkeypatch.setattr(near, "STRIP", strip)
        assert near.common_counts(sets[:4], sets[4:]).tolist() == want
    assert near.common_counts(sets[:2], []).shape == (2, 0)


def test_half_alike_texts_in_large_nodes(spark, monkeypatch):
    """Texts that share half of a template fill nodes; splitting and chunks find the similar ones among them all the same."""
    monkeypatch.setattr(near, "NODE_TEXTS", 20)
    template, rows = passage(7, 60), []
    for i in range(160):
        own = passage(5000 + i // 4, 30)
        rows.append((i, f"{template} {own} tail{i % 4}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["text_class_id"], r["n_links"]) for r in near.near_duplicates(df).collect()}
    want = plain_near(rows)
    assert {v[2] for v in want.values()} == {3} and got == want


def test_near_copies_without_ids(spark):
    rows = near_copies(2, 3)[:6]
    df = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    assert near.keep_one(df).count() == len({v[0] for v in plain_near(rows).values()})
    some = spark.createDataFrame([(None, rows[0][1]), (7, rows[0][1]), (None, rows[0][1] + " x"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.keep_one(some).collect()) == [(0, ""), (0, ""), (7, rows[0][1])]


def test_near_edges(spark, odd):
    out = near.near_duplicates(odd)
    rows = out.collect()
    assert len(rows) == len(odd_documents())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["n_copies"] == 3 and by[5]["class_id"] == 4 and by[1]["class_id"] == 1 and by[2]["n_links"] == 0
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13} - {i for i in by if by[i]["class_id"] != i})
    assert near.near_duplicates(odd.limit(0)).count() == 0 and near.keep_one(odd.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force_and_edited_copies_are_found(spark):
    rng = random.Random(8)
    items = [(i, passage(300 + i, 40)) for i in range(12)] + [(50, "too short"), (51, None)]
    rows, planted = [], set()
    for d in range(80):
        w = words(passage(1000 + d, 200))
        if d % 2:
            item = rng.randrange(12)
            copy = words(items[item][1])
            for _ in range(rng.choice([0, 3, 6])):
                copy[rng.randrange(len(copy))] = "paraphrased"
            if rng.random() < 0.5:
                del copy[5:7]
            at = rng.randrange(len(w))
            w[at:at] = copy
            planted.add((d, item))
        rows.append((d, " ".join(w).capitalize() + "!"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    block = decontaminate.read_block(items)
    brute = set()
    for d, t in rows:
        _, _, _, h, _ = decontaminate.gram_places([t], block.grams)
        brute |= {(d, i) for i, w in zip(block.ids, block.words, strict=True) if decontaminate.align(w, h)[0] >= decontaminate.THRESHOLD * len(w)}
    assert got == brute == planted
    assert decontaminate.without_leaks(docs, bench).count() == 40


def test_a_lone_copy_with_few_seeds_is_found(spark):
    item = [f"w{k}" for k in range(20)]
    copy = [w if k not in (3, 7, 11, 15) else "other" for k, w in enumerate(item)]
    kept = sum(any(k + s[-1] < 20 and "other" not in [copy[k + x] for x in s] for s in decontaminate.SEEDS) for k in range(18))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    leaks = [(k, passage(k, 5) + " " + " ".join(item)) for k in range(1, 60)]
    for rows in ([], leaks):
        docs = spark.createDataFrame([(0, passage(0, 30) + " " + " ".join(copy) + " " + passage(99, 30)), *rows], "doc_id long, text string")
        got = {r["doc_id"]: (r["score"], r["n_seeds"]) for r in decontaminate.find_leaks(docs, bench).collect()}
        assert set(got) == {0, *dict(rows)} and kept < 15 and got[0] == (0.7, kept)


def test_copies_without_three_words_in_a_row_are_found(spark):
    """Every third word replaced, or a word put in after every other one."""
    item = [f"w{k}" for k in range(24)]
    third = ["other" if k % 3 == 2 else w for k, w in enumerate(item)]
    wider = [x for k, w in enumerate(item) for x in ((w, "more") if k % 2 else (w,))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([passage(k, 20), *copy, passage(50 + k, 20)])) for k, copy in enumerate((third, wider, item[:9]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["first_word"], r["end_word"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {0, 1} and got[0][0] == round((16 - 7 * 0.5) / 24, 6) and got[1][0] == round((24 - 11 * 0.5) / 24, 6)


def test_short_items_may_have_one_edit(spark):
    """All copies of items of 5 to 7 words with a word changed, left out or put in; two changed words are too many."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (4, 5, 6, 7)]
    rows, want = [], set()
    for n, text in items:
        w = words(text)
        once = [w[:k] + edit + w[k + 1 :] for k in range(n) for edit in ([], ["other"], [w[k], "other"])]
        twice = [["other" if k in (a, b) else x for k, x in enumerate(w)] for a in range(1, n) for b in range(a + 1, n - 1)]
        for copy, few in [(w, True), *((c, n > 4 or w == c[:n]) for c in once), *((c, False) for c in twice)]:
            want |= {(len(rows), n)} if few else set()
            rows.append((len(rows), " ".join(["x y z", *copy, "u v"])))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == want


def test_short_items(spark):
    items = [(1, "What is the capital, then?"), (2, "Who wrote it"), (3, "Kumquat!"), (4, "one two three four five six seven"), (5, "?!"), (6, "who wrote it?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["a b what is the capital then c what is the capital then", "what is the capital", "who wrote it", "say who wrote", "so a KUMQUAT, a kumquat", "one two three four six seven", "", None, "one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())
    whole = [(2, 2, 1.0, 1, 0, 3), (2, 6, 1.0, 1, 0, 3), (4, 3, 1.0, 1, 2, 3)]
    assert got == [(0, 1, 1.0, 3, 2, 7), (1, 1, 0.8, 2, 0, 4), *whole, (5, 4, round(5.5 / 7, 6), 4, 0, 6), (8, 4, 1.0, 5, 0, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 6, 7]


def test_matches_by_blocks(spark, monkeypatch):
    items = [(i, passage(600 + i, 30)) for i in range(6)]
    rows = [(d, passage(2000 + d, 40) + " " + items[d % 6][1]) for d in range(9)] + [(20, passage(9, 50)), (21, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole and len(whole) == 9
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [20, 21]


@pytest.mark.parametrize("size", [1_000_000, 7])
def test_matches_in_parts(monkeypatch, size):
    for name in ("PASS_HITS", "PASS_WORDS"):
        monkeypatch.setattr(decontaminate, name, size)
    rng = random.Random(6)
    base = [words(passage(700 + i, 12)) for i in range(5)]
    block = decontaminate.read_block([(i, " ".join(w)) for i, w in enumerate(base)])
    texts = [" ".join(w for _ in range(6) for w in (rng.choice(base) if rng.random() < 0.5 else words(passage(rng.random(), 9)))) for _ in range(8)] + ["", None]
    got = [{(m[0], round(m[1] * 12, 6)) for m in row} for row in decontaminate.matches(texts, block)]
    want = []
    for t in texts:
        h = decontaminate.gram_places([t], block.grams)[3]
        scores = [(i, round(decontaminate.align(w, h)[0], 6)) for i, w in zip(block.ids, block.words, strict=True)]
        want.append({(i, s) for i, s in scores if s >= 6})
    assert any(want) and got == want


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontaminate.align(a, b)[0] == pytest.approx(h.max())


def test_leak_edges(spark, odd):
    bench = spark.createDataFrame([(1, passage(1)), (1, passage(2)), (2, "x y"), (None, passage(1))], "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.find_leaks(odd, bench).collect()}
    assert found == {4, 5, 6, None, 10, 12}
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(odd.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == len(odd_documents())


# --- 7 ---------------------------------------------------------------------------------------------


def test_rule_counts_equal_plain_versions(spark, odd, documents):
    for df in (odd, documents.limit(60)):
        for r in rules.judge(df, ["doc_id", "text"]).collect():
            t = r["text"] or ""
            w = words(t)
            grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            n = Counter(grams)
            repeated = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if words(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
            assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rules.judge(odd.limit(0), ["doc_id"]).count() == 0


def test_distance(spark):
    def d(p, q):
        return spark.range(1).select(rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]

    assert d([1.0, 0.0], [0.0, 3.0]) == pytest.approx(1.0) and d([1.0, 1.0], [2.0, 2.0]) == pytest.approx(0.0)
    assert d([0.0, 0.0], [1.0, 1.0]) is None


@pytest.mark.parametrize("broadcast", [10_000, 3])
def test_each_language_has_its_reference(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_LANGUAGES", broadcast, raising=False)
    rows = [(i, passage(i, 60 + i % 7) + "9" * (2 * i), f"l{i:03}", "s", 9) for i in range(230)] + [(230, passage(3, 120), None, "s", 9)]
    got = {r["doc_id"]: r["class_distance"] for r in rules.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    alone = {i for i, t, *_ in rows[:230] if len(t) >= rules.MIN_CHARS}
    assert max(alone) > 220 and {i for i, d in got.items() if d == 0} == alone and got[230] > 0


def test_a_language_learns_its_common_words(spark):
    junk = "buy now " * 200
    rows = [(i, "zum zum und " + passage(i, 60), "xx", "s", 9) for i in range(40)] + [(100 + i, junk, "xx", "s", 9) for i in range(15)]
    rows += [(200, "unlike all of the others " + " ".join(f"w{k}" for k in range(150)), "xx", "s", 9), (201, "zum und " * 3 + passage(77, 120), "xx", "s", 9), (202, None, "yy", "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = {r["list_language_"]: r["list_"] for r in rules.common_words(df).collect()}
    assert lists["xx"][:2] == ["und", "zum"] and len(lists["xx"]) == rules.COMMON_WORDS and set(lists) == {"xx"}
    got = {r["doc_id"]: r for r in rules.judge(df, ["doc_id"]).collect()}
    assert got[200]["common_distance"] > got[201]["common_distance"] and got[100]["base_failed"] and got[202]["class_distance"] is None


# --- 8 ---------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark, odd, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    rng = random.Random(1)
    bits = ["a", "b", "th", "the", " ", "\n", "é", "1", "23", "!", "ing", "sss", "\U0001f600", "'s", " ,", "́", "\x1c", "\xa0", " ", "\x85", "<|endoftext|>", "中"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [" lead trail ", "a" * 3000, "  \n\n\t x  "]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        got = own.encode(x)
        assert np.frombuffer(got, "<u4").tolist() == ids, x
        assert own.decode(got) == t.decode(ids, skip_special_tokens=False), x
    for df in (odd, documents):
        for r in bpe.encode_and_decode(df.select("doc_id", "text"), ["text"]).collect():
            want = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == (r["text"] or "")
    assert bpe.encode_and_decode(odd.limit(0), ["doc_id"]).count() == 0


def test_pieces_of_every_code_point_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    cutter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    own = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"a{c}1{c}! {c}{c}'s\n" for c in points[k : k + 4000])
        place, ends = 0, []
        for piece in own.cut_pieces(text):
            place += len(piece)
            ends.append(place)
        assert ends == [b for _, (_, b) in cutter.pre_tokenize_str(text)], k


def test_texts_with_newer_letters_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    rng = random.Random(2)
    bits = [chr(int(r.split("-")[0], 16)) for r in bpe.NEWER] + ["a", " ", "1", "'s", "!", "\n", "é", "\u168c"]
    for _ in range(3000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(own.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_suffix_automaton_finds_every_word():
    rng = random.Random(9)
    for _ in range(60):
        made = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        own = automaton.build({w: i for i, w in enumerate(sorted(made))})
        text, state, held = bytes(rng.choice(b"abcd") for _ in range(40)), 0, 0
        for end in range(1, 41):
            while True:
                edge = own.labels.find(text[end - 1], own.first[state], own.first[state + 1])
                if edge >= 0 or not state:
                    break
                state = own.link[state]
                held = own.longest[state]
            state, held = (own.target[edge], held + 1) if edge >= 0 else (0, 0)
            got = {n for _, n in own.words_of(state) if n <= held}
            assert got == {len(w) for w in made if text[:end].endswith(w)}


def test_memory_keeps_what_is_asked_for():
    made = []
    m = bpe._Memory(lambda k: made.append(k) or k.encode(), 3)
    for k in ("a", "b", "c", "a", "d", "a", "e", "f", "a", "g", "a"):
        assert m[k] == k.encode()
    assert made.count("a") == 1


# --- 9 ---------------------------------------------------------------------------------------------


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_personal_rules_equal_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "b.", "@", "@a.b", "1", "23", "255", ".", "-", " ", "+4", "(", "9999 ", "4012888888881881", "é", "\n", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        assert sorted(plain_personal(t)) == sorted(pii.base_spans(t)), t


def test_field_on_held_out_lines():
    field, rows = pii.train(), held_out()
    hit, wrong, missed = Counter(), Counter(), Counter()
    for (_, spans), got in zip(rows, pii.field_spans(field, [t for t, _ in rows]), strict=True):
        got = {(k.removeprefix("crf_").upper(), a, b) for k, a, b in got}
        hit.update(k for k, _, _ in got & set(spans))
        wrong.update(k for k, _, _ in got - set(spans))
        missed.update(k for k, _, _ in set(spans) - got)
    assert len(rows) >= 200 and not {t for t, _ in rows} & {t for t, _ in pii_field.read_labelled(pii_field.LABELLED)}
    for k in pii.ENTITIES:
        assert hit[k] >= 0.8 * (hit[k] + missed[k]) and hit[k] >= 0.9 * (hit[k] + wrong[k]), k


def test_cut_lines_decode_as_whole_lines(documents):
    field = pii.train()
    assert 0 < field.cut_at < 24
    texts = [t for t, _ in pii_field.read_labelled(pii_field.LABELLED)] + [r["text"] or "" for r in documents.limit(40).collect()]
    texts += ["plain words " * 30 + "call (212) 555-0144 now " + "and so on " * 20 + "Dear Anna Lee of the " + "old mill " * 9]
    lines = [w for t in texts for x in t.split("\n") if (w := pii.tokens(x))]
    for a, b in zip(pii.viterbi(field, lines), pii.viterbi(field, lines, cut=False), strict=True):
        assert a.tolist() == b.tolist()


def test_words_of_a_text_equal_those_of_its_lines():
    rng = random.Random(3)
    bits = ["a", "Bc", ".", ", ", " ", "  ", "\n", '"', "=", "é", "\U0001f600", "Bc", "!", "\t,", "|", "12", "\r\n"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        got, at, want = pii.words_of(t), 0, []
        for line in t.split("\n"):
            own = pii.tokens(line)
            want += [(w, at + a, b, k == 0, k == len(own) - 1) for k, (w, a, b) in enumerate(own)]
            at += len(line) + 1
        assert list(zip(got.words, got.start.tolist(), got.between.tolist(), got.opens.tolist(), got.closes.tolist(), strict=True)) == want, t


def test_the_field_looks_into_long_words_and_over_gaps():
    field = pii.train()
    for t in ("data " + "x" * 90 + "=" + "y" * 90 + ";ssn 321-54-9876;" + "z" * 90, "call (404)" + " " * 40 + "555-0102 now", "mail " + "a" * 80 + "(at)example.com please"):
        assert any(pii.field_spans(field, [t])[0]), t


def test_long_runs_take_linear_time():
    for t in ("x" * 400_000, "1" * 400_000, "a1" * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "aB" * 200_000 + "9z9z", "token " * 60_000, " " * 400_000):
        pii.base_spans(t)
        pii.field_spans(pii.train(), [t])
        secrets.without_overlaps(secrets.random_spans(t, len), secrets.base_spans(t))


def test_viterbi_equals_all_paths():
    field = pii.train()
    seq = pii.tokens("call (404) 555-0102 Dear")
    own = [pii_field.features(w) for w, _, _ in seq]
    emit = [pii_field.Field._emit(field, f) for f in own]
    emit = [emit[j][1] + (emit[j - 1][0] if j else field.edge[0]) + (emit[j + 1][2] if j + 1 < len(own) else field.edge[2]) + field.between[seq[j][2]] for j in range(len(own))]
    start = [-1e9 if s.startswith("I") else 0 for s in pii.STATES]
    best = max(itertools.product(range(len(pii.STATES)), repeat=4), key=lambda p: start[p[0]] + sum(emit[j][s] for j, s in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert pii.viterbi(field, [seq])[0].tolist() == list(best)


def test_marginals_equal_all_paths():
    field = pii.train()
    for text in ("Dear Anna Lee\nÜ. Ahm wer", "at 5 Oak Road"):
        found = pii.words_of(text)
        state, chance = pii_field.decode_surely(field, found, lambda s: np.array([pii.STATES[x][2:] in pii.LEAST_SURE for x in s]), cut=False)
        at, known = 0, False
        for line in text.split("\n"):
            seq = pii.tokens(line)
            own = [pii_field.features(w) for w, _, _ in seq]
            emit = [pii_field.Field._emit(field, f) for f in own]
            emit = [emit[j][1] + (emit[j - 1][0] if j else field.edge[0]) + (emit[j + 1][2] if j + 1 < len(own) else field.edge[2]) + field.between[seq[j][2]] for j in range(len(own))]
            start = [-1e9 if s.startswith("I") else 0 for s in pii.STATES]
            paths = np.array(list(itertools.product(range(len(pii.STATES)), repeat=len(own))))
            score = np.array(start)[paths[:, 0]] + sum(emit[j][paths[:, j]] for j in range(len(own))) + sum(field.moves[paths[:, j], paths[:, j + 1]] for j in range(len(own) - 1))
            p = np.exp(score - score.max())
            p /= p.sum()
            asked = any(pii.STATES[s][2:] in pii.LEAST_SURE for s in state[at : at + len(own)])
            for j in range(len(own)):
                assert abs(chance[at + j] - (p[paths[:, j] == state[at + j]].sum() if asked else 1)) < 1e-6
            at, known = at + len(own), known or asked
        assert known


def test_sentences_without_persons_have_no_names():
    field = pii.train()
    prose = ["The rain came. Ü. Ahmer went out.", "Mill Hall stood empty.", "la ville. É ê. Ö. Vermer"]
    assert not [s for t in prose for s in pii.field_spans(field, [t])[0] if s[0] in ("crf_name", "crf_address")]


def test_personal_data_of_texts(spark):
    df = spark.createDataFrame([(1, "tel (404) 555-0102 or +1 (404) 555-0102, a@b.co"), (2, "version 3.0 of 2004"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df, ["doc_id"]).collect()}
    assert got[1]["spans"] == "crf_phone:4:18,phone:22:39,email:41:47" and got[2]["spans"] == "" and got[3]["spans"] == ""
    assert got[1]["base_sha256"] == hashlib.sha256(b"phone:22:39,email:41:47").hexdigest() and got[1]["n_email"] == 1


# --- 1, 9: every odd document ----------------------------------------------------------------------


@pytest.mark.parametrize("run,plain,kinds", [(secrets.scan_secrets, plain_secrets, secrets.KINDS), (pii.find_personal_data, plain_personal, pii.KINDS)])
def test_spans_of_odd_documents(odd, run, plain, kinds):
    rows = run(odd, ["doc_id", "text"]).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        base = sorted(plain(r["text"] or ""), key=lambda s: (s[1], kinds[s[0]]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert all(f"{k}:{a}:{b}" in r["spans"] for k, a, b in base)
    assert run(odd.limit(0), ["doc_id"]).count() == 0


# --- 10 --------------------------------------------------------------------------------------------


def test_scores_equal_a_plain_model(spark, odd):
    held = quality.remainder(F.col("doc_id"), 7) == 2
    small = odd.where(F.length("text").isNull() | (F.length("text") < 5000))
    got = lm.score_texts(small, held).collect()
    source = [(r["doc_id"], r["text"]) for r in small.collect()]
    k = lm.ORDER

    def low(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    def steps(t):
        b = [lm.START] * k + list(low(t).encode()) + [lm.END]
        return [(tuple(b[i - k : i]), b[i]) for i in range(k, len(b))]

    def tokens(t):
        return [*words(low(t)), "<end>"]

    def is_held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    count, levels = Counter(), [{} for _ in range(k + 1)]
    for i, t in source:
        if not is_held(i):
            count.update(tokens(t))
            for c, s in steps(t):
                for n in range(k + 1):
                    levels[n].setdefault(c[k - n :], Counter())[s] += 1
    total, kinds = sum(count.values()), len(count)

    def p(c, s):
        out, gone = 1.0, set()
        for n in range(k, -1, -1):
            some = {x: y for x, y in levels[n].get(c[k - n :], {}).items() if x not in gone}
            if some:
                room = sum(some.values()) + len(some)
                if s in some:
                    return out * some[s] / room
                out *= len(some) / room
                gone |= set(some)
        return out / (lm.SYMBOLS - len(gone))

    want = sorted(
        (is_held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6), round(sum(math.log10(p(*x)) for x in steps(t)), 6))
        for i, t in source
    )
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    context = next(iter(levels[k]))
    assert sum(p(context, s) for s in range(256) if s != lm.START) == pytest.approx(1.0)
    assert lm.score_texts(small.limit(0), held).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_many_equal_rows_are_scored_once(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_ROWS", hot)
    rows = [(None, "same text")] * 30 + [(None, None)] * 5 + [(i, passage(i, 10)) for i in range(6)] + [(7, "x"), (7, "x")]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), quality.remainder(F.col("doc_id"), 7) == 2).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert sorted(Counter(round(r["score"], 9) for r in got if r["doc_id"] is None).values()) == [5, 30]


def test_lookup_finds_all_and_nothing_else():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    rng = np.random.default_rng(1)
    keys = rng.permutation(keys)
    found = lm.Lookup(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert (found.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert lm.Lookup(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]
