"""Conversation repair against a plain search over all edits, whole and in pieces."""

import hashlib
import random
import re
from itertools import pairwise

import pytest

from plumbline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text): the least (cost, edits) for each shape so far."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(now):
        for _ in range(3):
            for at, (cost, edits, made) in list(now.items()):
                for to, name in (("u", "user"), ("a", "assistant")):
                    if step.get((at, to)):
                        now[to] = min(now.get(to, (10**9, "", ())), (cost + 5, edits + "I", (*made, f"{name}:")))
        return now

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(to, value, new=new):
            new[to] = min(new.get(to, (10**9, "", ())), value)

        for at, (cost, edits, made) in best.items():
            offer(at, (cost + 2, edits + "D", made))
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if step.get((at, role[:1])):
                    offer(role[:1], (cost, edits + "K", (*made, f"{role}:{text}")))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if step.get((at, to)):
                        offer(to, (cost + 1, edits + "R", (*made, f"{name}:{text}")))
        best = inserted(new)
    cost, edits, made = min(best[x] for x in ("", "a") if x in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in pairwise(rows))
    digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, digest), made


def made_up(seed, n_conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "é.", "Yes. ", None, "a\nb."]
    rows = []
    for conv in range(n_conversations):
        for _ in range(rng.randrange(1, longest)):
            turn = rng.choice([None, *range(12)])
            rows.append((conv if conv else None, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}."))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


def reports(spark, rows):
    made = cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in made}, len(made)


@pytest.mark.parametrize("bounds", [(2000, 20_000), (5, 3), (1, 1)])
def test_repair_equals_plain_search(spark, monkeypatch, bounds):
    monkeypatch.setattr(cv, "WHOLE_ROWS", bounds[0])
    monkeypatch.setattr(cv, "PIECE_ROWS", bounds[1])
    rows = made_up(7, 60, 14)
    got, n = reports(spark, rows)
    assert n == len(got) == 60
    for conv in got:
        assert got[conv] == plain([r[1:] for r in rows if r[0] == conv])[0], conv


def test_one_conversation_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(cv, "WHOLE_ROWS", 50)
    monkeypatch.setattr(cv, "PIECE_ROWS", 40)
    rng = random.Random(3)
    rows = [(9, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "Same", f"Text {t}.", ""])) for t in range(600)] + [(9, 5, "user", "Same.")] * 300
    got, _ = reports(spark, rows)
    assert got[9] == plain([r[1:] for r in rows])[0]


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(cv, "WHOLE_ROWS", 6)
    monkeypatch.setattr(cv, "PIECE_ROWS", 4)
    rows = made_up(11, 20, 16)
    made = cv.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    for conv in {r[0] for r in rows}:
        own = [f"{r['role']}:{r['text']}" for r in sorted((r for r in made if r["conv_id"] == conv), key=lambda r: (r["piece"], r["n"]))]
        assert tuple(own) == plain([r[1:] for r in rows if r[0] == conv])[1]


def test_damage_and_odd_tables(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    out = cv.damaged(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS copies", "1 AS piece")).collect()
    assert len(out) == len(rows)
    for r in out:
        hit = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        text = " " if r["conv_id"] is None else "One. Two!"
        assert r["copies"] == {0: 0, 3: 2}.get(hit, 1)
        assert r["role"] == ("user" if hit == 4 else " " if r["conv_id"] is None else "assistant")
        assert r["text"] == ("" if hit == 1 else "One Two" if hit == 2 else text)
    gone = spark.createDataFrame([(1, 1, "user", "Hi.", 0), (1, 2, "user", "Hi.", 0)], SCHEMA + ", copies int")
    assert [tuple(r) for r in cv.repair(gone).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    far = spark.createDataFrame([(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Hi.")], SCHEMA)
    assert cv.repair(far).first()["gaps"] == 2**63 - 1
