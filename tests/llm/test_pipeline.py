import math

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, odd_documents, plain_lines, plain_near, words

from plumbline.llm import queries


def test_every_stage_equals_a_plain_version(spark, data, monkeypatch):
    """Each stage on what its predecessor kept, against the rules written out, the library, and alignment without seeds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from plumbline.llm import quality

    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 6000")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def run(stage, now):
        made = stages[stage](spark, now, data).cache()
        return made, {r["doc_id"]: r["text"] if "text" in made.columns else r for r in made.collect()}

    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), F.lit(True))
    sizes, w = quality._Sizes(*model[:2]), np.array(model[2])
    want = {i: t for i, t in rows.items() if 1 / (1 + math.exp(-float(np.array(sizes.features(t)) @ w))) >= corpus_pipeline.REJECT_BELOW}
    docs, got = run("quality classifier", docs)
    assert got == want and len(want) < len(rows)

    lines = plain_lines([(i, t or "") for i, t in got.items()])
    want = {i: lines[i] for i, t in got.items() if words(lines[i]) or lines[i] == (t or "")}
    docs, got = run("line dedup", docs)
    assert got == want

    classes = plain_near(list(got.items()))
    want = {i: t for i, t in got.items() if classes[i][0] == i}
    docs, got = run("n-gram Jaccard join", docs)
    assert got == want

    def normal(t):
        return words("".join(" " if c.isascii() and not c.isalnum() and c > " " else c for c in t.lower()))

    def score(item, text):
        """The best local alignment, all places, by the plain recurrence (a match 1, an edit -0.5)."""
        last, best = np.zeros(len(text) + 1), 0.0
        for x in item:
            now = np.maximum(0, np.maximum(last[1:] - 0.5, last[:-1] + np.where(text == x, 1.0, -0.5)))
            now = np.concatenate(([0.0], now))
            for _ in range(len(item)):
                moved = np.maximum(now[1:], now[:-1] - 0.5)
                if (moved == now[1:]).all():
                    break
                now[1:] = moved
            best, last = max(best, now.max()), now
        return best

    items = [normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    number = {}
    coded = [np.array([number.setdefault(x, len(number)) for x in item]) for item in items]

    def leaks(t):
        text = np.array([number.get(x, -1) for x in normal(t)])
        return any(score(item, text) >= 0.5 * len(item) for item in coded if np.isin(text, item).sum() >= 0.5 * len(item))

    want = {i: t for i, t in got.items() if not leaks(t or "")}
    docs, before = run("benchmark decontamination", docs)
    assert before == want and len(want) < len(got)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, got = run("BPE encoding and decoding", docs)
    assert {i: np.frombuffer(r["ids"], "<u4").tolist() for i, r in got.items()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in before.items()}
    assert all(r["round_trip"] for r in got.values())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark for the odd documents."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(4, 1), (6, 1), (8, 0), (7, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "kumquat pie"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_and_empty_documents(spark, folder, name, stage):
    """Nulls, empty and very long texts, repeated rows, and columns whose names an operator uses itself."""
    names = ("row", "removed", "score", "matches", "n_tokens", "n_lines", "N_Removed", "ids", "key", "text_", "v")
    docs = spark.createDataFrame(odd_documents(), SCHEMA).select("*", *[F.lit(77).alias(c) for c in names])
    made = stage(spark, docs, folder)
    rows = made.collect()
    if name == corpus_pipeline.STAGES[-1][0]:
        assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    else:
        assert made.columns == docs.columns and [t for _, t in made.dtypes] == [t for _, t in docs.dtypes]
        assert 0 < len(rows) <= docs.count() and all(r[c] == 77 for r in rows for c in names)
        assert name == "quality classifier" or any(r["text"] is None for r in rows)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_writes_and_reads_every_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = corpus_pipeline.run(spark, data)
    assert docs.count() / 2 < made.count() < docs.count() and set(made.columns) == {"doc_id", "n_tokens", "ids", "round_trip"}


def test_names():
    assert {q.split("_")[0] for q in queries.QUERIES if q != "pipeline"} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
