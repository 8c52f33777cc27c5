"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: it goes if it does not end like a sentence, if it looks like navigation or
markup, if it shouts, or if it is boilerplate.  A document that loses more than half of its words that way
is rejected, and so is one that fails the base rules (too short, or mostly repeated three-word windows).
Everything happens within a row, so nothing is shuffled and a hot source costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import free

MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
#: Characters at which a finished line may end.
TERMINAL = r"""[.!?:;…。！？"'”’»)\]][\x20\x09-\x0D]*\z"""
#: Separators of menus and marks of markup; more than one for every four words fails a line.
MARKS = "#*$%&|<>»·•"
#: Phrases of site furniture; a line of up to thirty words that holds one fails.
PHRASES = ("all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy", "sign in", "subscribe to our", "terms of service", "terms of use")
PHRASE_WORDS = 30


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more in the array ``words``."""
    n = F.size(words)

    def covered(z: Column) -> Column:
        # windows with equal hashes become neighbours when sorted; the low bits carry the position
        h, bits = z["h"], F.when(n <= 1 << 16, 16).when(n <= 1 << 24, 24).otherwise(31)
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def places(y: Column) -> Column:
            at = lambda i: h[(y["s"][i].bitwiseAND(low)).cast("int")]
            same = F.filter(y["s"], lambda x, i: F.coalesce(h[x.bitwiseAND(low).cast("int")] == F.when(i > 0, at(i - 1)), F.lit(False)) | F.coalesce(h[x.bitwiseAND(low).cast("int")] == F.when(i + 1 < F.size(y["s"]), at(i + 1)), F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x.bitwiseAND(low).cast("int")))

        s = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(-1 - low).bitwiseOR(i.cast("long"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(let(F.struct(s.alias("s")), places), start, step, lambda a: a["n"])

    h = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n < 4, 0).otherwise(let(F.struct(h.alias("h")), lambda z: F.when(F.size(F.array_distinct(z["h"])) == F.size(z["h"]), 0).otherwise(covered(z))))


def _line(line: Column) -> Column:
    """struct(line, words, ok) of one line."""
    n = F.size(words_of(line))
    marks = F.length(line) - F.length(F.regexp_replace(line, f"[{MARKS}]", ""))
    shouts = F.length(line) - F.length(F.regexp_replace(line, "!!", "!"))
    low = F.lower(line)
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | low.contains(p)

    def judged(k: Column) -> Column:
        bad = (4 * marks > k) | (4 * shouts > k) | ~line.rlike(TERMINAL) | ((k <= PHRASE_WORDS) & phrase)
        return F.struct(line.alias("line"), k.alias("words"), ((k > 0) & ~bad).alias("ok"))

    return let(n, judged)


def judge(docs: DataFrame, text_col: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a column ``name`` (not yet there): the base figures, the verdict, and the text that is left.

    A null or empty text has no words and fails.  Lines without words neither count nor stay.  Each row is
    judged by itself, so repeated rows get equal verdicts; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def figures(z: Column) -> Column:
        worded = F.filter(z["lines"], lambda x: x["words"] > 0)
        good = F.filter(z["lines"], lambda x: x["ok"])
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["words"])
        return F.struct(
            F.size(z["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(z["w"], "")).cast("long").alias("word_chars"),
            (F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            _repeat_words(z["w"]).cast("long").alias("n_repeat_words"),
            total(good).cast("long").alias("n_good_words"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("good_text"),
        )

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_good_words", "good_text")
        return F.struct(*[q[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & (2 * q["n_good_words"] >= q["n_words"])).alias("kept"))

    made = let(let(F.struct(words_of(text).alias("w"), F.transform(F.split(text, "\n", -1), _line).alias("lines")), figures), verdict)
    # a generator is evaluated once for each row, whatever is filtered and selected from it later
    return docs.select("*", F.explode(F.array(made)).alias(name))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_good_words, base_failed, kept) of every row."""
    name = free("quality", [id_col, text_col])
    q = F.col(name)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_good_words", "base_failed", "kept")
    return judge(docs.select(id_col, text_col), text_col, name).select(id_col, *[q[n].alias(n) for n in names])


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, their text less the lines that failed; other columns as they were.

    Null and empty texts go, since they have no words; other columns may have any names; an empty table stays empty.
    """
    name = free("quality", docs.columns)
    made = judge(docs, text_col, name).where(F.col(name)["kept"])
    return made.withColumn(text_col, F.col(name)["good_text"]).drop(name)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
judged AS (SELECT r, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k,
  length(l) - length(regexp_replace(l, '[#*$%&|<>»·•]', '', 'g')) AS marks, length(l) - length(replace(l, '!!', '!')) AS shouts,
  regexp_matches(l, '[.!?:;…。！？"''”’»)\]][\x20\x09-\x0D]*\z') AS ends,
  regexp_matches(lower(l), 'all rights reserved|click here|cookie policy|enable javascript|privacy policy|sign in|subscribe to our|terms of service|terms of use') AS phrase FROM line),
lines AS (SELECT r, count(*) FILTER (k > 0) - count(DISTINCT l) FILTER (k > 0) AS n_dup_lines,
  coalesce(sum(k) FILTER (k > 0 AND NOT (4 * marks > k OR 4 * shouts > k OR NOT ends OR (k <= 30 AND phrase))), 0) AS good FROM judged GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, good::BIGINT AS n_good_words
  FROM w JOIN lines USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_good_words >= n_words AS kept FROM f
"""
