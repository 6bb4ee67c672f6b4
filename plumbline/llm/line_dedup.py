"""Line dedup: of lines that are equal, or within one edit of each other, the earliest in the corpus stays.

A deletion-neighbourhood join.  Two lines within one edit become equal when a character is deleted from
either, or from the longer one; so each line's variants with one character deleted are emitted as hashed
keys, equal keys are joined, and the edit distance of what meets is verified.

Two things keep this small.  Equal lines are one line from the start.  And an edit leaves one half of a line
as it is: only lines that share a half with another line of a fitting length emit variants, and only
of the other half.  Variants of equal lengths carry the place of the deletion: texts that meet at one
place differ in that character only, so such a group is no larger than the alphabet.  A group of
variants of longer lines has at most one shorter line, to which the longer ones are compared.

The hash of a variant is the exclusive-or of the hashes of (place, character), so running totals give
all variants of a line in time linear in its length, at any length.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut
from plumbline.llm.near import row_key
from plumbline.llm.texts import free_name

#: Lines of fewer characters have no near copies; their exact copies go all the same.
MIN_CHARS = 24
#: A line is hot if more than this share of all lines equal it; so there are at most its inverse of them.
HOT_SHARE, HOT_ROWS = 0.001, 1000
#: Rows of candidate lines up to which they are broadcast to the documents (some 8 MB); beyond, both are shuffled.
BROADCAST_ROWS = 200_000

#: The place of a document without an id, after all others; and which half a pair shares.
LAST = (1 << 63) - 1
PREFIX, SUFFIX = 0, 1


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, at, line): at is the line's place in the corpus; an id that is null comes last."""
    rows = docs.select(
        row_key(docs, doc_id, text).alias("row"),
        F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)).alias("d"),
        F.posexplode(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)).alias("no", "line"),
    )
    return rows.select("row", F.struct("d", "row", "no").alias("at"), "line").where(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")]


def _halves() -> Column:
    """What a line shares with a line within one edit: for either length that a pair's shorter line can have, either half.

    A pair whose shorter line has m characters shares the first m div 2 characters or the last m - m div 2.
    own: this line is the shorter one, or as long as the other.
    """
    line, n = F.col("line"), F.char_length("line")

    def pair(m: Column, own: bool) -> list[Column]:
        p = F.floor(m / 2).cast("int")
        return [
            F.struct(F.xxhash64(F.lit(PREFIX), m, F.left(line, p)).alias("half"), F.lit(own).alias("own"), F.lit(PREFIX).alias("side")),
            F.struct(F.xxhash64(F.lit(SUFFIX), m, F.right(line, m - p)).alias("half"), F.lit(own).alias("own"), F.lit(SUFFIX).alias("side")),
        ]

    return F.array(*pair(n, True), *pair(n - 1, False))


def _rest() -> Column:
    """The half of the line that isn't shared."""
    line, n = F.col("line"), F.char_length("line")
    m = F.when(F.col("own"), n).otherwise(n - 1)
    p = F.floor(m / 2).cast("int")
    return F.when(F.col("side") == PREFIX, F.right(line, n - p)).otherwise(F.left(line, n - (m - p)))


def _near(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2) of the distinct lines that are within one edit of an earlier one."""
    shared = distinct.select("h1", "h2", "at", F.explode("halves").alias("s")).select("h1", "h2", "at", "s.half", "s.own", "s.side")
    meets = shared.groupBy("half").agg(F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("all")).where("owns >= 1 and all >= 2")
    met = cut(shared.join(meets, "half"))
    wanted = met.groupBy(F.col("at.row").alias("row"), F.col("at.no").alias("no"), "h1", "h2", "at").agg(F.count(F.lit(1)).alias("n"))
    by_row = wanted.groupBy("row").agg(F.collect_set(F.struct("no", "h1", "h2", "at")).alias("found"))
    if met.count() <= BROADCAST_ROWS:
        by_row = F.broadcast(by_row)
    texts = docs.select(row_key(docs, doc_id, text).alias("row"), docs[text].alias("text")).join(by_row, "row")
    texts = texts.select(F.split("text", "\n", -1).alias("lines"), F.explode("found").alias("f"))
    texts = texts.select("f.h1", "f.h2", "f.at", F.get("lines", F.col("f.no")).alias("line"))
    texts = cut(texts.dropDuplicates(["h1", "h2"]))

    rests = met.select("h1", "h2", "half", "own", "side", "owns", "all").join(texts.select("h1", "h2", "line"), ["h1", "h2"])
    rests = rests.select("h1", "h2", "half", "own", "owns", "all", F.posexplode(F.split(_rest(), "")).alias("i", "c"))
    rests = rests.withColumn("here", F.xxhash64("i", "c")).withColumn("moved", F.xxhash64(F.col("i") - 1, "c"))
    line = Window.partitionBy("h1", "h2", "half", "own")
    so_far = line.orderBy("i")
    none = F.lit(0).cast("long")
    before = F.coalesce(F.bit_xor("here").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), none)
    upto = F.bit_xor("moved").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    rests = rests.withColumn("deleted", before.bitwiseXOR(upto)).withColumn("moved_all", F.bit_xor("moved").over(line))
    rests = rests.withColumn("whole", F.bit_xor("here").over(line))
    deleted = F.col("deleted").bitwiseXOR(F.col("moved_all"))
    same_length = F.when(F.col("own") & (F.col("owns") > 1), F.struct(F.xxhash64("half", "i", deleted).alias("key"), F.lit("same").alias("kind")))
    longer = F.when(~F.col("own"), F.struct(F.xxhash64("half", F.lit(-1), deleted).alias("key"), F.lit("longer").alias("kind")))
    shorter = F.when(
        F.col("own") & (F.col("owns") < F.col("all")) & (F.col("i") == 0),
        F.struct(F.xxhash64("half", F.lit(-1), "whole").alias("key"), F.lit("shorter").alias("kind")),
    )
    variants = rests.select("h1", "h2", F.explode(F.array_compact(F.array(same_length, longer, shorter))).alias("v")).select("h1", "h2", "v.key", "v.kind")
    group = Window.partitionBy("key")
    variants = variants.withColumn("low", F.min("h1").over(group)).withColumn("high", F.max("h1").over(group)).where("low <> high")
    variants = cut(variants.select("h1", "h2", "key", "kind").distinct().join(texts, ["h1", "h2"]))

    close = F.levenshtein("line", "other_line", 1) >= 0
    same = variants.where("kind = 'same'")
    heads = same.groupBy("key").agg(F.min(F.struct("at", "line")).alias("head"))
    dropped = same.join(heads, "key").withColumn("other_line", F.col("head.line")).where((F.col("at") > F.col("head.at")) & close).select("h1", "h2")
    short = variants.where("kind = 'shorter'").select("key", F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("at").alias("other_at"), F.col("line").alias("other_line"))
    pairs = variants.where("kind = 'longer'").join(short, "key").where(close)
    later = F.col("at") > F.col("other_at")
    more = pairs.select(F.when(later, F.col("h1")).otherwise(F.col("s1")).alias("h1"), F.when(later, F.col("h2")).otherwise(F.col("s2")).alias("h2"))
    return dropped.union(more).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, removed): for each row (see near.row_key) that loses lines, their numbers from 0, in order.

    A line goes if an equal line, or one within max_edits (0 or 1), stands earlier in the corpus: in a document
    of lesser id, or earlier in the same one.  The earlier line counts whether or not it stays itself.
    Lines without a visible character stay; those of fewer than min_chars go for equal lines only.  Equality is that of
    two hashes, 96 bits.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = _lines(docs, doc_id, text)
    halves = [F.first(F.when(F.char_length("line") >= min_chars, _halves())).alias("halves")] if max_edits else []
    distinct = cut(lines.groupBy(*_hashes()).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), *halves))
    again = distinct.where("n > 1").select("h1", "h2", "at", "n", F.lit(False).alias("near"))
    if max_edits:
        near = _near(docs, distinct.where("halves is not null"), doc_id, text)
        again = again.union(near.select("h1", "h2", F.lit(None).alias("at"), F.lit(1).alias("n"), F.lit(True).alias("near")))
        again = again.groupBy("h1", "h2").agg(F.max("at").alias("at"), F.max("n").alias("n"), F.max("near").alias("near"))
    again = cut(again)
    # The rows of a hot line are many and its key is one: such lines are few, and every row meets them where it is.  The
    # other rows are dealt by their line, the hot ones by their document.
    most = max(HOT_ROWS, int(HOT_SHARE * (distinct.agg(F.sum("n")).first()[0] or 0)))
    hot = again.where(F.col("n") > most).select("h1", "h2", F.struct("at", "near").alias("hot"))
    found = again.where(F.col("n") <= most).select(F.col("h1").alias("k1"), F.col("h2").cast("long").alias("k2"), F.struct("at", "near").alias("found"))
    instances = lines.select("row", F.col("at").alias("here"), *_hashes()).join(F.broadcast(hot), ["h1", "h2"], "left")
    is_hot = F.col("hot").isNotNull()
    instances = instances.select(
        "row", "here", "hot", F.when(is_hot, F.col("row.k1")).otherwise(F.col("h1")).alias("k1"), F.when(is_hot, F.col("row.k2")).otherwise(F.col("h2").cast("long")).alias("k2")
    )
    held = F.when(is_hot, F.col("hot")).otherwise(F.col("found"))
    gone = instances.join(found, ["k1", "k2"], "left").withColumn("held", held).where(F.col("held.near") | (F.col("here") > F.col("held.at")))
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("here.no")).alias("removed"))


def without(lines: Column, removed: Column) -> Column:
    """The lines but for those at the sorted places `removed`: the slices between them, in time linear in the lines."""
    n = F.size(removed)

    def piece(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get(removed, j - 1) + 1)
        end = F.when(j == n, F.size(lines)).otherwise(F.get(removed, j))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), piece))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the text after line dedup, then how many lines it had and lost, in two columns called as `counts` says.

    A null text stays null and has no lines; an empty one has one, which stays.  Repeated rows are one
    document with one result.  A document may be left without text ('').  Columns of docs that are
    called as `counts` says are replaced; an empty table gives no rows.
    """
    row, gone = free_name(docs, "row"), free_name(docs, "removed")
    found = removed_lines(docs, doc_id, text, max_edits, min_chars).toDF(row, gone)
    joined = docs.withColumn(row, row_key(docs, doc_id, text)).join(found, row, "left")
    lines = F.split(F.col(text), "\n", -1)
    columns = [c for c in docs.columns if c.lower() not in counts]
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(without(lines, F.col(gone)), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text else F.col(c) for c in columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias(counts[1]),
    )


ORACLE = f"""
WITH l AS (
    SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), d AS (
    SELECT line, min(struct_pack(d := doc_id, n := no)) AS first FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line
), h AS (
    SELECT line, first, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS half
    FROM d, (VALUES (0), (1)) s(side), LATERAL (SELECT unnest([length(line), length(line) - 1]) AS m) WHERE length(line) >= {MIN_CHARS}
), near AS (
    SELECT DISTINCT b.line FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.first < b.first
    WHERE abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1
), marked AS (
    SELECT l.doc_id, l.no, l.line,
        d.line IS NOT NULL AND (struct_pack(d := l.doc_id, n := l.no) > d.first OR near.line IS NOT NULL) AS gone
    FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
