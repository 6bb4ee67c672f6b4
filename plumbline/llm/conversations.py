"""Conversation structure repair: the cheapest edits that give a conversation the shape system? (user assistant)+.

A conversation is its rows by turn, nulls first.  Rows of one turn stand by role (its first 32 characters), text (its first 64), then a
hash of both, so their order is the same on every run; repeated rows stand together.  A row's first fault counts: blank (no
visible character), duplicate (role and text stand earlier in the conversation; equality is that of 128 bits of hashes where a
conversation is worked on in pieces), truncated (its last visible character doesn't end a sentence).

Edits and costs: Keep 0, Rerole (to what the grammar wants next) 1, Delete 2, Insert (an empty turn of the wanted role) 5; blank and
duplicate rows must go, and a truncated row that stays costs 5 more.  A backward pass computes the cost to go from every row and
grammar state; a forward walk takes the ASCII-least edit among those that keep to it.  The grammar fixes the role of an edit's
result, so the letters of the edits name one repair.

How it runs: one range shuffle lays the rows in order.  A conversation that lies inside a partition and is not long is repaired
there and then.  All others (those at partition borders, and long ones, of any size) are cut into pieces of bounded size: each
piece's costs between all pairs of grammar states are a 4 x 4 matrix over (min, +), matrices are folded from the end to give each
piece its cost to go, each piece is then walked from all four states, and the walks are chained.  Only the digest of a conversation and
its string of edits, which are one value each by definition, pass through one task: texts stream through it, they aren't held.

Odd input: a null role or text is one space (a blank row); null conversation ids are one conversation; null turns come first and don't
count for gaps; an unknown role can't be kept; gaps beyond the largest long are that long.  Empty tables give empty results.  Columns
other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import cut, scratch_path, ship

#: A conversation beyond these is cut into pieces; a piece has no more than PIECE_ROWS rows, or about PIECE_CHARS characters.
WHOLE_ROWS, WHOLE_CHARS = 2_000, 4_000_000
PIECE_ROWS, PIECE_CHARS = 20_000, 8_000_000
#: Rows of output that a task gathers before it hands them on.
BATCH_ROWS, BATCH_CHARS = 2_000, 4_000_000

DELETE, INSERT, KEEP, REROLE = "DIKR"
RETAIN, BROKEN = 5, 1 << 60
#: Grammar states: nothing yet, after system, after user, after assistant; the state that an inserted or reroled turn leads to.
WANTED = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Where a kept row of each kind (other, s, u, a) leads from each state; -1: nowhere.
KEPT = ((-1, -1, -1, -1), (1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
KIND = {"s": 1, "u": 2, "a": 3}
FAULTS = ("", "blank", "duplicate", "truncated")
#: The cost to go after the last row: the end is allowed after nothing and after an assistant.
END = (0, 10, 5, 0)

_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows spoilt by a checksum of their conversation and turn; copies 0 means dropped."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    hit = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


# --- one conversation, or a piece of one: codes of rows (kind * 4 + fault) in order ---------------------------------------------


def code_of(role: str, text: str, seen: bool) -> int:
    last = _LAST.search(text)
    fault = 1 if last is None else 2 if seen else 0 if last[1] in ".!?" else 3
    return KIND.get(role[:1], 0) * 4 + fault


def costs_to_go(codes: bytes, goal: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each row, and behind the last, the least cost from each grammar state to the goal's costs."""
    out = [tuple(goal)]
    for code in reversed(codes):
        after, fault = out[-1], code & 3
        c = [2 + x for x in after]
        if fault not in (1, 2):
            stays = RETAIN if fault == 3 else 0
            for q in range(4):
                c[q] = min(c[q], stays + 1 + after[WANTED[q]])
                to = KEPT[code >> 2][q]
                if to >= 0:
                    c[q] = min(c[q], stays + after[to])
        c[2], c[3] = min(c[2], 5 + c[3]), min(c[3], 5 + c[2])
        c[0], c[1] = min(c[0], 5 + c[2]), min(c[1], 5 + c[2])
        out.append(tuple(c))
    return out[::-1]


def walk(codes: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits among the cheapest from that state, and the state they end in; last: the conversation ends here."""
    edits, i = [], 0
    while i < len(codes) or (last and costs[i][state]):
        left = costs[i][state]
        if i < len(codes):
            after, fault = costs[i + 1], codes[i] & 3
            if left == 2 + after[state]:
                edits.append(DELETE)
                i += 1
                continue
        if left == 5 + costs[i][WANTED[state]]:
            edits.append(INSERT)
            state = WANTED[state]
            continue
        to = KEPT[codes[i] >> 2][state]
        keeps = to >= 0 and left == (RETAIN if fault == 3 else 0) + after[to]
        edits.append(KEEP if keeps else REROLE)
        state = to if keeps else WANTED[state]
        i += 1
    return "".join(edits), state


def rebuilt(rows: list[tuple[str, str]], edits: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits leave of the rows."""
    at = 0
    for edit in edits:
        if edit == DELETE:
            at += 1
        elif edit == INSERT:
            state = WANTED[state]
            yield NAMES[state], ""
        else:
            role, text = rows[at]
            state = KEPT[KIND.get(role[:1], 0)][state] if edit == KEEP else WANTED[state]
            yield (role if edit == KEEP else NAMES[state]), text
            at += 1


def line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


class Tally:
    """Counts along rows in order, which can be added to the counts of the rows that follow."""

    def __init__(self, codes: bytes = b"", turns: list[int | None] = (), initials: list[str] = ()) -> None:
        faults = [c & 3 for c in codes]
        self.faults = [faults.count(k) for k in (1, 2, 3)]
        self.illegal = sum(x not in _LEGAL for x in pairwise(initials))
        self.ends = (initials[0], initials[-1]) if initials else None
        known = [t for t in turns if t is not None]
        self.turns = sum(a != b for a, b in pairwise(known)) + bool(known)
        self.reach = (known[0], known[-1]) if known else None

    def add(self, other: Tally) -> None:
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal
        if self.ends and other.ends:
            self.illegal += (self.ends[1], other.ends[0]) not in _LEGAL
        if other.ends:
            self.ends = (self.ends or other.ends)[0], other.ends[1]
        self.turns += other.turns - bool(self.reach and other.reach and self.reach[1] == other.reach[0])
        if other.reach:
            self.reach = (self.reach or other.reach)[0], other.reach[1]

    def values(self) -> list[int]:
        """gaps, blank, duplicate, truncated, illegal."""
        gaps = self.reach[1] - self.reach[0] + 1 - self.turns if self.reach else 0
        return [min(gaps, 2**63 - 1), *self.faults, self.illegal]


def repair_whole(rows: list[tuple[int | None, str, str]]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """The six counts, the edits and the repaired turns of a conversation (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    codes = bytearray()
    for _, role, text in rows:
        codes.append(code_of(role, text, (role, text) in seen))
        seen.add((role, text))
    costs = costs_to_go(codes, END)
    edits, _ = walk(codes, costs, 0, True)
    counts = Tally(codes, [r[0] for r in rows], [r[1][:1] for r in rows]).values()
    return [*counts, costs[0][0]], edits, list(rebuilt([r[1:] for r in rows], edits))


# --- over Spark -----------------------------------------------------------------------------------------------------------------

_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _schema(kind: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in fields]])


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)


class _Out:
    """Rows of output in batches of bounded size."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def put(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= BATCH_ROWS or self.chars >= BATCH_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from _table(self.schema, self.rows).to_batches()
            self.rows, self.chars = [], 0


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(a, BATCH_ROWS).columns], strict=True)


def _first_pass(rows: DataFrame, turns: bool) -> tuple[DataFrame, DataFrame]:
    """Reports (and repaired turns) of the conversations that end inside a partition, and the rows of all others in pieces."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    counts = [(c, T.LongType()) for c in COUNTS]
    schema = _schema(
        kind, *counts, ("audit", T.StringType()), ("repaired_sha256", T.StringType()), ("turns", _TURNS),
        ("piece", T.LongType()), ("seq", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("copies", T.IntegerType()),
    )
    no_report, no_row = (None,) * (len(COUNTS) + 3), (None,) * 6
    limits = WHOLE_ROWS, WHOLE_CHARS, PIECE_ROWS, PIECE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_rows, whole_chars, piece_rows, piece_chars = limits
        out, piece, seq, in_piece, chars_in_piece = _Out(schema), TaskContext.get().partitionId() << 32, 0, 0, 0
        current, held, chars, streaming = None, [], 0, True

        def hand_on(row: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal piece, seq, in_piece, chars_in_piece
            if in_piece >= piece_rows or chars_in_piece >= piece_chars:
                piece, in_piece, chars_in_piece = piece + 1, 0, 0
            n = len(row[2]) + len(row[1])
            seq, in_piece, chars_in_piece = seq + 1, in_piece + 1, chars_in_piece + n
            yield from out.put((current[0], *no_report, piece, seq, *row), n)

        def done() -> Iterator[pa.RecordBatch]:
            every = [r[:3] for r in held for _ in range(r[3])]
            found, edits, made = repair_whole(every)
            digest = hashlib.sha256(b"\n".join(line(*x) for x in made)).hexdigest()
            kept = [{"role": r, "text": x} for r, x in made] if turns else None
            yield from out.put((current[0], *found, edits, digest, kept, *no_row), chars if turns else len(edits))

        for conv, turn, role, text, copies in _rows_of(batches):
            if current is None or conv != current[0]:
                if held:
                    yield from done()
                streaming = current is None  # the first conversation may have begun in an earlier partition
                current, held, chars = (conv,), [], 0
                piece, in_piece, chars_in_piece = piece + 1, 0, 0
            row = (turn, role, text, copies)
            if not streaming:
                held.append(row)
                chars += len(text) + len(role)
                if len(held) <= whole_rows and chars <= whole_chars:
                    continue
                streaming, some, held = True, held, []
                for r in some:
                    yield from hand_on(r)
            else:
                yield from hand_on(row)
        for r in held:  # the last one may go on in the next partition
            yield from hand_on(r)
        yield from out.flush()

    path = scratch_path(spark, "conversations")
    rows.mapInArrow(run, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    whole = made.where("piece IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256", "turns")
    return whole, made.where("piece IS NOT NULL").select("conv_id", "piece", "seq", "turn", "role", "text", "copies")


def _in_order(rows: DataFrame) -> DataFrame:
    """All rows in order over range partitions; rows that are equal in everything may lie in several."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "copies")
    gone = F.col("copies") == 0
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), *[F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")], "copies", F.monotonically_increasing_id().alias("salt"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32).asc(), F.substring("text", 1, 64).asc(), F.xxhash64("role", "text").asc(), F.col("salt").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")


def _piece_rows(table: pa.Table) -> list[tuple]:
    """(seq, turn, role, text, copies) in order."""
    table = table.sort_by("seq").select(["seq", "turn", "role", "text", "copies"])
    return list(zip(*[c.to_pylist() for c in table.columns], strict=True))


def _coded(parts: DataFrame) -> DataFrame:
    """A row for each piece: its rows' codes, counts, and costs between all pairs of states."""
    keys = [F.xxhash64("role", "text").alias("k0"), F.xxhash64(F.lit(1), "role", "text").alias("k1")]
    firsts = parts.where("copies > 0").groupBy("conv_id", *keys).agg(F.min(F.struct("piece", "seq")).alias("at")).select("at.piece", "at.seq")
    schema = _schema(
        parts.schema["conv_id"].dataType, ("piece", T.LongType()), ("codes", T.BinaryType()), ("faults", T.ArrayType(T.LongType())), ("illegal", T.LongType()), ("ends", T.ArrayType(T.StringType())),
        ("n_turns", T.LongType()), ("reach", T.ArrayType(T.LongType())), ("matrix", T.ArrayType(T.LongType())),
    )

    def run(rows: pa.Table, first: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(schema, [])
        new = set(first.column("seq").to_pylist())
        codes, turns, initials = bytearray(), [], []
        for seq, turn, role, text, copies in _piece_rows(rows):
            for k in range(copies):
                codes.append(code_of(role, text, k > 0 or seq not in new))
                turns.append(turn)
                initials.append(role[:1])
        tally = Tally(codes, turns, initials)
        columns = [costs_to_go(codes, tuple(0 if q == r else BROKEN for q in range(4)))[0] for r in range(4)]
        matrix = [columns[r][q] for q in range(4) for r in range(4)]
        own = (rows.column("conv_id")[0].as_py(), rows.column("piece")[0].as_py(), bytes(codes), tally.faults, tally.illegal, list(tally.ends or ()), tally.turns, list(tally.reach or ()), matrix)
        return _table(schema, [own])

    return parts.groupBy("piece").cogroup(firsts.groupBy("piece")).applyInArrow(run, schema)


def _goals(coded: DataFrame) -> DataFrame:
    """For each piece the costs to go at its end; with a conversation's first piece its counts."""
    schema = _schema(coded.schema["conv_id"].dataType, ("piece", T.LongType()), ("goal", T.ArrayType(T.LongType())), ("last", T.BooleanType()), *[(c, T.LongType()) for c in COUNTS])

    def run(table: pa.Table) -> pa.Table:
        pieces = table.sort_by("piece").to_pylist()
        total, goals, goal = Tally(), [], END
        for p in pieces:
            one = Tally()
            one.faults, one.illegal, one.ends, one.turns, one.reach = p["faults"], p["illegal"], tuple(p["ends"]) or None, p["n_turns"], tuple(p["reach"]) or None
            total.add(one)
        for p in reversed(pieces):
            goals.append(goal)
            goal = tuple(min(p["matrix"][4 * q + r] + goal[r] for r in range(4)) for q in range(4))
        goals.reverse()
        counts = [*total.values(), goal[0]]
        none = [None] * len(counts)
        return _table(schema, [(p["conv_id"], p["piece"], list(g), i == len(pieces) - 1, *(none if i else counts)) for i, (p, g) in enumerate(zip(pieces, goals, strict=True))])

    return coded.drop("codes").groupBy("conv_id").applyInArrow(run, schema)


def _edits(coded: DataFrame, goals: DataFrame) -> DataFrame:
    """(conv_id, piece, start, audit): each piece's edits, and the grammar state that they start in."""
    kind = coded.schema["conv_id"].dataType
    walked = _schema(kind, ("piece", T.LongType()), ("ends", T.ArrayType(T.IntegerType())), ("audits", T.ArrayType(T.StringType())))
    chosen = _schema(kind, ("piece", T.LongType()), ("start", T.IntegerType()), ("audit", T.StringType()))

    def four_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, piece, codes, goal, last in _rows_of(batches):
            costs = costs_to_go(codes, tuple(goal))
            ways = [walk(codes, costs, q, last) for q in range(4)]
            yield from _table(walked, [(conv, piece, [w[1] for w in ways], [w[0] for w in ways])]).to_batches()

    def chain(table: pa.Table) -> pa.Table:
        out, state = [], 0
        for p in table.sort_by("piece").to_pylist():
            out.append((p["conv_id"], p["piece"], state, p["audits"][state]))
            state = p["ends"][state]
        return _table(chosen, out)

    both = coded.select("conv_id", "piece", "codes").join(goals.select("piece", "goal", "last"), "piece")
    ways = both.select("conv_id", "piece", "codes", "goal", "last").mapInArrow(four_ways, walked)
    return ways.groupBy("conv_id").applyInArrow(chain, chosen)


def _rebuilt(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, piece, n, role, text): the repaired turns of the pieces."""
    schema = _schema(parts.schema["conv_id"].dataType, ("piece", T.LongType()), ("n", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))

    def run(rows: pa.Table, edit: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(schema, [])
        conv, piece = rows.column("conv_id")[0].as_py(), rows.column("piece")[0].as_py()
        every = [r[2:4] for r in _piece_rows(rows) for _ in range(r[4])]
        own = edit.to_pylist()[0]
        return _table(schema, [(conv, piece, n, *x) for n, x in enumerate(rebuilt(every, own["audit"], own["start"]))])

    return parts.groupBy("piece").cogroup(edits.drop("conv_id").groupBy("piece")).applyInArrow(run, schema)


def _digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): a conversation's turns stream through one task, as a digest needs them in order; they aren't held."""
    schema = _schema(turns.schema["conv_id"].dataType, ("repaired_sha256", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, digest = _Out(schema), None, None
        for conv, role, text in _rows_of(batches):
            if current is None or conv != current[0]:
                if current:
                    yield from out.put((current[0], digest.hexdigest()), 64)
                current, digest = (conv,), hashlib.sha256(line(role, text))
            else:
                digest.update(b"\n" + line(role, text))
        if current:
            yield from out.put((current[0], digest.hexdigest()), 64)
        yield from out.flush()

    laid = turns.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "n")
    return laid.select("conv_id", "role", "text").mapInArrow(run, schema)


def _with_copies(rows: DataFrame) -> DataFrame:
    return rows if "copies" in rows.columns else rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (its edits), repaired_sha256.

    rows: (conv_id, turn, role, text), and copies where rows may be dropped (0) or repeated.  A conversation of which nothing
    is there has zeros, no edits, and the digest of the empty string.
    """
    ship(rows.sparkSession)
    whole, parts = _first_pass(_in_order(_with_copies(rows)), False)
    coded = cut(_coded(parts))
    goals = cut(_goals(coded))
    edits = cut(_edits(coded, goals))
    audit: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    found = goals.where("cost IS NOT NULL").select("conv_id", *COUNTS)
    found = found.unionByName(edits.groupBy("conv_id").agg(audit.alias("audit")), True).unionByName(_digests(_rebuilt(parts, edits)), True)
    names = [*COUNTS, "audit", "repaired_sha256"]
    cut_up = found.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
    cut_up = cut_up.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    return whole.select("conv_id", *names).unionByName(cut_up)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, n, role, text): the repaired conversations; piece, then n, is their order."""
    ship(rows.sparkSession)
    whole, parts = _first_pass(_in_order(_with_copies(rows)), True)
    coded = cut(_coded(parts))
    made = _rebuilt(parts, _edits(coded, _goals(coded)))
    inside = whole.select("conv_id", F.lit(0).cast("long").alias("piece"), F.posexplode("turns").alias("n", "t"))
    return inside.select("conv_id", "piece", F.col("n").cast("long").alias("n"), "t.role", "t.text").unionByName(made)


#: The same rows in SQL: a checksum bit by bit, then the least (cost, edits) for each grammar state, row after row.
ORACLE = r"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS hit FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
    f AS MATERIALIZED (SELECT *, coalesce(conv_id::VARCHAR, 'none') AS id, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM r),
    ids AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS id FROM conversations),
    w(id, n, s0, s1, s2, s3) AS (
        SELECT id, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}, {'c': 5::BIGINT, 'a': 'I', 't': ['user:']}, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} FROM ids
        UNION ALL
        SELECT id, n, s0, s1, s2, list_min([b3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': list_append(s2.t, 'assistant:')}]) FROM (
        SELECT id, n, s0, s1, b3, list_min([b2, {'c': s0.c + 5, 'a': s0.a || 'I', 't': list_append(s0.t, 'user:')}, {'c': s1.c + 5, 'a': s1.a || 'I', 't': list_append(s1.t, 'user:')},
            {'c': b3.c + 5, 'a': b3.a || 'I', 't': list_append(b3.t, 'user:')}]) AS s2 FROM (
        SELECT w.id, f.n, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS s0,
            list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + no_s, 'a': s0.a || 'K', 't': list_append(s0.t, own)}]) AS s1,
            list_min(list_concat([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}], flatten(list_transform([s0, s1, s3],
                lambda s: [{'c': s.c + no_r, 'a': s.a || 'R', 't': list_append(s.t, 'user:' || text)}, {'c': s.c + no_u, 'a': s.a || 'K', 't': list_append(s.t, own)}])))) AS b2,
            list_min([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}, {'c': s2.c + no_r, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)}, {'c': s2.c + no_a, 'a': s2.a || 'K', 't': list_append(s2.t, own)}]) AS b3
        FROM w JOIN (SELECT *, role || ':' || text AS own, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS stays, stays + 1 AS no_r, stays + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS no_s,
            stays + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END AS no_u, stays + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END AS no_a FROM f) f ON f.id = w.id AND f.n = w.n + 1))),
    best AS (SELECT id, arg_max(list_min([s0, s3]), n) AS b FROM w GROUP BY id),
    counts AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
        count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY id)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256 FROM ids JOIN best USING (id) LEFT JOIN counts USING (id)"""
