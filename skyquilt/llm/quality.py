"""Quality rules, line first.

Each line with a word is judged by itself: too many symbols, exclamation in place of sentences, navigation,
menus of any length (LEAST_SEPARATORS separators or more that are SEPARATOR_PERCENT of the line's words),
boilerplate phrases in a short line. Failing lines are removed; a document that loses more than LOST of its
word characters is rejected. So is one that fails the document rules (too few words, repetition).

Defined results: null and empty texts have no words and fail; a line without a word is never judged; equal
lines are compared exactly; repeated rows give repeated rows; an empty table gives an empty result. The
input's columns are carried in one struct, so their names cannot clash with the operator's.

Windows of three words are compared by a 64-bit hash of their words' hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, count_of, table, words

LEAST_WORDS = 50
REPEATED_PERCENT = 50
LOST_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
SYMBOL_PERCENT = 20
# Phrases of site furniture.
BOILERPLATE = (
    r"(?i)(^|[^a-z])(accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved"
    r"|enable javascript|click here|sign (in|up)|log ?in|subscribe (now|to our)|skip to (main )?content|share (this|on)|read more)([^a-z]|$)"
)
BOILERPLATE_WORDS = 20
NAVIGATION = r"([»›→].*){2}"
NAVIGATION_WORDS = 15
SHOUT_WORDS = 5
# What stands between the entries of a menu.
SEPARATORS = ("|", "·", "•", ">", "/", "»", "›", "→")
LEAST_SEPARATORS = 3
SEPARATOR_PERCENT = 30
# Only for kept_documents: site furniture in the other languages.
BOILERPLATE_ELSEWHERE = (
    r"(?i)(^|[^\p{L}])(alle cookies akzeptieren|cookie-?(richtlinie|einstellungen)|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|weiterlesen"
    r"|(accepter|gérer) (tous )?les cookies|politique de confidentialité|conditions d'utilisation|tous droits réservés|cliquez ici|lire la suite|mentions légales"
    r"|aceptar (todas )?las cookies|política de (privacidad|cookies)|términos de uso|todos los derechos reservados|haga clic aquí|iniciar sesión|leer más)([^\p{L}]|$)"
)


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def line_fails(line: Column, more: Callable[[Column, Column], Column] | None = None) -> Column:
    """Whether a line is to be removed; ``more`` adds rules on a line and its number of words."""

    def judged(n: Column) -> Column:
        symbols = 100 * count_of(line, SYMBOLS) > SYMBOL_PERCENT * _chars(line)
        shouting = (n >= SHOUT_WORDS) & (2 * count_of(line, "!") > n)
        navigation = (n <= NAVIGATION_WORDS) & line.rlike(NAVIGATION)
        boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        any_rule = symbols | shouting | navigation | boilerplate | is_menu(line)
        return (n > 0) & (any_rule if more is None else any_rule | more(line, n))

    return bind(F.size(words(line)), judged)


def is_menu(line: Column) -> Column:
    """Whether a line of any length consists of entries between separators that stand as words of their own."""

    def judged(w: Column) -> Column:
        n = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        return (n >= LEAST_SEPARATORS) & (100 * n >= SEPARATOR_PERCENT * F.size(w))

    return F.when(line.rlike("[" + "".join(SEPARATORS) + "]"), bind(words(line), judged)).otherwise(F.lit(False))


def line_fails_stage(line: Column) -> Column:
    """What kept_documents removes: also short furniture in the other languages."""
    return line_fails(line, lambda x, n: (n <= BOILERPLATE_WORDS) & x.rlike(BOILERPLATE_ELSEWHERE))


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def of(h: Column) -> Column:
        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])

        def twice(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return bind(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(ordered, twice))

    def windows(w: Column) -> Column:
        three = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) > 3, bind(three, of)).otherwise(F.lit(0))

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), windows).cast("long")


def judge(documents: DataFrame, fails: Callable[[Column], Column] = line_fails) -> DataFrame:
    """The rows of ``documents`` with a struct ``__quality``: counts, verdicts and the cleaned text.

    ``fails`` says whether a line is to be removed; the SQL of op8 fixes it for the query.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.withColumn("__q", F.struct(text.alias("text"), words(text).alias("words"), F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), fails(x).alias("bad"))).alias("lines")))
    full = F.transform(F.filter("__q.lines", lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]")), lambda x: x["line"])
    failed = F.transform(F.filter("__q.lines", lambda x: x["bad"]), lambda x: x["line"])
    counted = split.withColumn(
        "__n",
        F.struct(
            F.size("__q.words").cast("long").alias("n_words"),
            _chars(F.col("__q.text")).cast("long").alias("word_chars"),
            count_of(F.col("__q.text"), SYMBOLS).alias("n_symbols"),
            bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("__q.words")).alias("n_repeat_words"),
            bind(failed, lambda x: F.struct(F.size(x).alias("n"), _chars(F.array_join(x, "")).cast("long").alias("chars"))).alias("failed"),
        ),
    )
    base_failed = (F.col("__n.n_words") < LEAST_WORDS) | (100 * F.col("__n.n_repeat_words") > REPEATED_PERCENT * F.col("__n.n_words"))
    lost_much = 100 * F.col("__n.failed.chars") > LOST_PERCENT * F.col("__n.word_chars")
    cleaned = F.when(F.col("__n.failed.n") == 0, F.col("__q.text")).otherwise(F.array_join(F.transform(F.filter("__q.lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"))
    out = F.struct(
        *[F.col(f"__n.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & ~lost_much).alias("kept"),
        F.col("__n.failed.n").alias("lines_removed"),
        cleaned.alias("cleaned"),
    )
    return counted.withColumn("__quality", out).drop("__q", "__n")


def quality(documents: DataFrame) -> DataFrame:
    """Counts and verdicts of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(documents.select("doc_id", "text")).select("doc_id", *[F.col(f"__quality.{c}").alias(c) for c in names])


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; n_chars follows the text."""
    carried = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")
    # The verdict goes through a generator: a filter on it would otherwise move below and repeat all its work.
    judged = judge(carried, line_fails_stage).select("row", F.inline(F.array(F.struct("__quality.kept", "__quality.cleaned")))).filter("kept")
    values = {"text": F.col("cleaned")}
    if "n_chars" in documents.columns:
        values["n_chars"] = F.length("cleaned").cast(documents.schema["n_chars"].dataType)
    return judged.select(*[values.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def query(spark, sf_dir):
    """op8: quality rules over the whole of documents."""
    return quality(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
wordpos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
windows AS (SELECT doc_id, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM wordpos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM again, (VALUES (0), (1), (2)) AS t(k) WHERE again.n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
judged AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len([x FOR x IN regexp_extract_all(line, '[^\x20\x09-\x0D]+') IF x IN ('|', '·', '•', '>', '/', '»', '›', '→')]) AS n_sep
  FROM lines),
failed AS (
  SELECT doc_id, line, chars, n, n > 0 AND (
      100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 20 * chars
      OR (n >= 5 AND 2 * len(regexp_extract_all(line, '!')) > n)
      OR (n <= 15 AND regexp_matches(line, '([»›→].*){2}'))
      OR (n_sep >= 3 AND 100 * n_sep >= 30 * n)
      OR (n <= 20 AND regexp_matches(line, '(?i)(^|[^a-z])(accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|sign (in|up)|log ?in|subscribe (now|to our)|skip to (main )?content|share (this|on)|read more)([^a-z]|$)'))
    ) AS bad FROM judged),
by_line AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost, (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines
  FROM failed GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, lost
  FROM tokens t JOIN by_line USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * lost > 30 * word_chars) AS kept
FROM counts
"""
