"""Quality rules: counts of a text's words, signs and repeats, and its distance from references of its language.

A language's common words are learned: the COMMON_WORDS words that most of its texts (of at least LEAST_WORDS words) have, once a text,
so that a text that repeats itself has one vote.  Reference histograms of character classes and of these words are added up over
the language's documents that pass the base rules.  A document fails if the Jensen-Shannon distance (base 2, 0 to 1) of its
character classes from its language's exceeds CLASS_DISTANCE, or that of its common words COMMON_DISTANCE.  Short texts say too
little: below `min_chars` characters or `min_words` words that comparison is not made.

All of it is DataFrame functions; a document's counts need no shuffle, and one row for each language is joined, by a
broadcast where they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut

CLASSES = ("lower", "upper", "digit", "other_letter", "sign", "other", "space")
#: Words of the base rules, and how many common words a language has.
LEAST_WORDS, COMMON_WORDS = 50, 20
MIN_CHARS, MIN_WORDS = 200, 100
CLASS_DISTANCE, COMMON_DISTANCE = 0.32, 0.28
#: Languages up to which their rows are broadcast (some 6 MB); beyond, Spark chooses how to join them.
BROADCAST_LANGUAGES = 10_000

_SPACES = "\t\n\x0b\x0c\r"
#: A letter for each common word, after one for all others.
_LETTERS = "." + "".join(chr(ord("A") + i) for i in range(COMMON_WORDS))


def words(text: Column) -> Column:
    """The words of a text.  Splitting at one character needs no pattern."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def _left(text: Column, dropped: str) -> Column:
    """Characters of the text without those of the class."""
    return F.char_length(F.regexp_replace(text, dropped, "")).cast("long")


def repeated_words(w: Column) -> Column:
    """Words that stand in a window of three words found twice or more in the text.

    The windows' hashes are sorted with their places; equal neighbours are repeats.  Each repeated
    window adds the words up to the next one, three at most.
    """
    n = F.size(w)
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = _let(hashed, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, n - 2))

    def places(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(placed, places), covered))

    return F.when(n < 4, 0).otherwise(_let(windows, count)).cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(list_language_, list_): the most frequent words of each language, by the texts that have them; ties by the word."""

    def own(w: Column) -> Column:
        return F.when(F.size(w) >= LEAST_WORDS, F.array_distinct(w))

    rows = docs.where(docs[lang].isNotNull()).select(docs[lang].alias("list_language_"), F.explode(_let(words(F.lower(docs[text])), own)).alias("word"))
    counts = rows.groupBy("list_language_", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("list_language_").orderBy(F.col("n").desc(), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    lists = top.groupBy("list_language_").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
    return cut(lists.select("list_language_", F.col("ranked.word").alias("list_")))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_LANGUAGES else rows


def measured(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keep, the language, and the counts and histograms of each whole text."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(*[docs[c] for c in keep], docs[lang].alias("language_"), t.alias("text_"), words(t).alias("words_"))
    rows = rows.join(_few(common_words(docs, text, lang)), F.col("language_") == F.col("list_language_"), "left")
    t, w, asked = F.col("text_"), F.col("words_"), F.coalesce("list_", F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(" " + _SPACES)) != "")
    joined = F.array_join(w, "")
    # One letter for each word; counting letters is quicker than looking up the words again.
    letters = F.when(F.size(asked) > 0, F.array_join(F.transform(w, lambda x: F.substr(F.lit(_LETTERS), F.array_position(asked, F.lower(x)).cast("int") + 1, F.lit(1))), ""))
    rows = rows.select(
        *keep,
        "language_",
        F.size(asked).alias("asked_"),
        F.char_length(t).cast("long").alias("chars_"),
        F.size(w).cast("long").alias("n_words"),
        F.char_length(joined).cast("long").alias("word_chars"),
        F.regexp_replace(joined, "[a-z]+", "").alias("rest_"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        letters.alias("letters_"),
    )
    rest = F.char_length("rest_").cast("long")
    rows = rows.select(
        "*",
        (F.col("word_chars") - rest).alias("lower"),
        (rest - _left(F.col("rest_"), "[A-Z]+")).alias("upper"),
        (rest - _left(F.col("rest_"), "[0-9]+")).alias("digit"),
        (rest - _left(F.col("rest_"), r"[^\x00-\x7F]+")).alias("other_letter"),
        (rest - _left(F.col("rest_"), r"[#*$%&|<>]+")).alias("n_symbols"),
        (F.col("chars_") - F.col("word_chars")).alias("space"),
        rest.alias("not_lower"),
    )
    rows = rows.withColumn("sign", F.col("n_symbols"))
    rows = rows.withColumn("other", F.col("not_lower") - F.col("upper") - F.col("digit") - F.col("other_letter") - F.col("sign"))
    found = F.array(*[F.coalesce(F.char_length("letters_") - F.char_length(F.replace("letters_", F.lit(c), F.lit(""))), F.lit(0)).cast("long") for c in _LETTERS[1:]])
    counts = F.slice(found, F.lit(1), F.col("asked_"))
    others = F.col("n_words") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        *keep, "language_", "chars_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.array(*[F.col(c) for c in CLASSES]).alias("classes_"), F.concat(counts, F.array(others)).alias("counts_"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of one length, base 2; null if either is empty."""
    total_p = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    total_q = F.aggregate(q, F.lit(0.0), lambda a, b: a + b)
    both = F.zip_with(p, q, lambda a, b: F.struct((a / F.nullif(total_p, F.lit(0.0))).alias("a"), (b / F.nullif(total_q, F.lit(0.0))).alias("b")))

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.transform(both, lambda x: part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(total, F.lit(0.0))))


def references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms of the documents that pass the base rules: one row for each language, and one for all."""

    def sums(column: str, n: int, wanted: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(wanted, F.get(column, F.lit(i)))), F.lit(0)) for i in range(n)])

    good = ~F.col("base_failed")
    by = rows.groupBy("language_").agg(sums("classes_", len(CLASSES), good).alias("ref_classes_"), sums("counts_", COMMON_WORDS + 1, good).alias("ref_counts_"))
    by = cut(by)
    all_rows = by.agg(sums("ref_classes_", len(CLASSES), F.lit(True)).alias("all_classes_"))
    named = by.where(F.col("language_").isNotNull()).select(F.col("language_").alias("ref_language_"), "ref_classes_", "ref_counts_")
    return _few(named), all_rows


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance, kept.

    A null text counts as empty: no words, and base_failed.  A null language is compared with all documents by its
    characters only; so is, with its own language, a document whose language has no text of LEAST_WORDS words.  A language without a
    document that passes the base rules has no reference, and its documents are not compared.  Repeated rows count each; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = cut(measured(docs, keep, text, lang))
    by_language, overall = references(rows)
    rows = rows.join(by_language, F.col("language_") == F.col("ref_language_"), "left").crossJoin(F.broadcast(overall))
    classes = distance(F.col("classes_").cast("array<double>"), F.coalesce("ref_classes_", "all_classes_").cast("array<double>"))
    n = F.size("counts_")
    common = distance(F.col("counts_").cast("array<double>"), F.slice(F.col("ref_counts_"), F.lit(1), n).cast("array<double>"))
    rows = rows.withColumn("class_distance", F.when(F.col("chars_") >= min_chars, classes))
    rows = rows.withColumn("common_distance", F.when((F.col("n_words") >= min_words) & (n > 1), common))
    far = F.coalesce(F.col("class_distance") > CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("common_distance") > COMMON_DISTANCE, F.lit(False))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"), (~F.col("base_failed") & ~far).alias("kept"),
    )


def _oracle() -> str:
    def js(p: str, q: str) -> str:
        pq = f"list_zip(list_transform({p}, lambda x: x / list_sum({p})), list_transform({q}, lambda x: x / list_sum({q})))"
        half = "(({0} + {1}) / 2)"
        term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / " + half + ") ELSE 0 END"
        terms = f"{term.format('x[1]', 'x[2]')} + {term.format('x[2]', 'x[1]')}"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform({pq}, lambda x: {terms})) / 2, 0)) END"

    def left(pattern: str) -> str:
        return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"

    return f"""
WITH w AS (
    SELECT doc_id, lang, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), df AS (
    SELECT lang, word, count(*) AS n FROM (
        SELECT lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS word
        FROM w WHERE lang IS NOT NULL AND len(ws) >= {LEAST_WORDS})
    GROUP BY lang, word
), top AS (
    SELECT lang AS list_lang, list(word ORDER BY n DESC, word)[1:{COMMON_WORDS}] AS list FROM df GROUP BY lang
), win AS (
    SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win
), rep AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY doc_id
), m AS (
    SELECT w.doc_id, lang, length(t) AS chars, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        {left('[#*$%&|<>]+')} AS n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words,
        {left('[a-z]+')} AS lower_, {left('[A-Z]+')} AS upper_, {left('[0-9]+')} AS digit_, {left('[^\\x00-\\x7F]+')} AS letter_,
        coalesce(top.list, []) AS asked, list_transform(ws, lambda x: lower(x)) AS lw
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN top ON lang = list_lang
), h AS (
    SELECT *, [lower_, upper_, digit_, letter_, n_symbols, word_chars - lower_ - upper_ - digit_ - letter_ - n_symbols, chars - word_chars]::DOUBLE[] AS classes,
        list_transform(asked, lambda c: len(list_filter(lw, lambda x: x = c)))::DOUBLE[] AS found
    FROM m
), k AS (
    SELECT *, list_append(found, n_words - coalesce(list_sum(found), 0)) AS counts, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h
), rc AS (
    SELECT lang, list(s ORDER BY i) AS ref FROM (
        SELECT lang, i, coalesce(sum(v) FILTER (WHERE NOT base_failed), 0) AS s FROM (SELECT lang, base_failed, unnest(range(1, 8)) AS i, unnest(classes) AS v FROM k) GROUP BY lang, i) GROUP BY lang
), ra AS (
    SELECT list(s ORDER BY i) AS every FROM (
        SELECT i, coalesce(sum(v) FILTER (WHERE NOT base_failed), 0) AS s FROM (SELECT base_failed, unnest(range(1, 8)) AS i, unnest(classes) AS v FROM k) GROUP BY i)
), rw AS (
    SELECT lang, list(s ORDER BY i) AS ref FROM (
        SELECT lang, i, coalesce(sum(v) FILTER (WHERE NOT base_failed), 0) AS s FROM (SELECT lang, base_failed, unnest(range(1, len(counts) + 1)) AS i, unnest(counts) AS v FROM k) GROUP BY lang, i) GROUP BY lang
), d AS (
    SELECT k.*,
        CASE WHEN chars >= {MIN_CHARS} THEN {js('classes', 'coalesce(rc.ref, every)')} END AS cd,
        CASE WHEN n_words >= {MIN_WORDS} AND len(asked) > 0 THEN {js('counts', 'rw.ref')} END AS wd
    FROM k LEFT JOIN rc ON k.lang = rc.lang LEFT JOIN rw ON k.lang = rw.lang CROSS JOIN ra
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS common_distance,
    NOT base_failed AND NOT coalesce(cd > {CLASS_DISTANCE}, false) AND NOT coalesce(wd > {COMMON_DISTANCE}, false) AS kept
FROM d
"""


ORACLE = _oracle()
