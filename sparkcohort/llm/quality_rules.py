"""Line-first quality rules: failing lines go, then documents that lost too much of their text or fail the base rules.

Every rule looks at one line, all lines of a text are judged inside its row, and nothing is shuffled.  DataFrame functions
only.  Intermediate arrays are bound as lambda variables, so that each is made once a row.

* punctuation: no sentence ends in the line, or a fifth of its words carry symbols, or a third end in doubled marks.
* navigation: a fifth of the words are bare separators, or the line has at most ``MENU_WORDS`` words and no sentence mark.
* boilerplate: at most ``NOTICE_WORDS`` words with a phrase of licences, notices, log-ins or cookie banners, or equal to an
  earlier line of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import SPACES, q, text_of

MIN_WORDS = 50
MENU_WORDS = 4
NOTICE_WORDS = 40
MOST_LOST = 0.5

# The white space and symbols of the word and symbol counts.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][)\]\x22'\x{BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|\z)"
# One match for each word that carries a symbol, ends in doubled marks, or is a bare separator; each scans a line once.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL_WORD = r"[#*$%&|<>][^\x20\x09-\x0D]*"
DOUBLED = r"[!?][!?][)\x22']*(?=[\x20\x09-\x0D]|\z)"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|/>\x{2022}\x{B7}\x{BB}\x{203A}\x{2013}\x{2014}-]+(?=[\x20\x09-\x0D]|\z)"
PHRASES = ("all rights reserved", "licensed under", "released under the", "public license", "terms of use", "terms of service",
           "privacy policy", "cookie", "lorem ipsum", "javascript", "subscribe to", "sign up", "log in", "click here", "read more",
           "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados", "mentions légales", "impressum",
           "datenschutz", "aviso legal")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def length_without(text: Column, chars: str) -> Column:
    """Code points of a text that are none of ``chars``; replacing one by one searches bytes, which ``translate`` does not."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def symbols_in(text: Column) -> Column:
    return F.length(text).cast("long") - length_without(text, SYMBOLS)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each place once; windows are equal by their 64-bit hash.

    Where all windows differ nothing is left to do.  Otherwise they are sorted by hash, those with an equal neighbour are
    repeated, and their starts in order cover up to three words each.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        spans = lambda s: F.aggregate(
            F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(F.sort_array(bound(order, twice)), spans))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound(bound(words, hashes), covered)).cast("long")


def judged_line(line: Column, again: Column) -> Column:
    """The line with its characters in words and the first rule that it fails, null when it passes."""
    ends, lower = line.rlike(SENTENCE_END), F.lower(line)
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.contains(lower, F.lit(p))
    verdict = lambda n: (F.when(n == 0, F.lit(None).cast("string"))
                         .when((5 * count(SEPARATOR) >= n) | ((n <= MENU_WORDS) & ~ends), "navigation")
                         .when(~ends | (5 * count(SYMBOL_WORD) >= n) | (3 * count(DOUBLED) >= n), "punctuation")
                         .when(again | ((n <= NOTICE_WORDS) & phrase), "boilerplate"))
    return F.struct(line.alias("line"), length_without(line, WHITE).alias("chars"),
                    bound(count(WORD), verdict).alias("rule"))


def judged_lines(text: Column) -> Column:
    """All lines of a text in order as (line, chars, rule)."""
    def with_copies(lines: Column) -> Column:
        # in order of content and place, a line whose predecessor is equal is a later copy
        order = F.sort_array(F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i"))))
        copies = lambda s: F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"), F.coalesce(F.get(s, j - 1)["l"] == x["l"], F.lit(False)).alias("again"), x["l"].alias("l")))
        return F.transform(F.sort_array(bound(order, copies)), lambda x: judged_line(x["l"], x["again"]))

    alone = lambda lines: F.transform(lines, lambda l: judged_line(l, F.lit(False)))
    return bound(F.split(text, "\n"), lambda lines: F.when(
        F.size(F.array_distinct(lines)) == F.size(lines), alone(lines)).otherwise(with_copies(lines)))


def judged(docs: DataFrame, text: str = "text", prefix: str = "__rules_") -> DataFrame:
    """``docs`` with one more column, named ``prefix`` + ``all``: a struct of the counts, verdicts and the cleaned text."""
    name = _free(docs, prefix)
    raw = docs.withColumn(name, text_of(text))

    def counts(t: Column) -> Column:
        return bound(words_in(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))

    def of_lines(lines: Column) -> Column:
        failed = lambda rule: F.size(F.filter(lines, lambda x: x["rule"] == rule)).cast("long")
        kept = F.filter(lines, lambda x: x["rule"].isNull())
        chars = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
        solid = F.filter(lines, lambda x: x["chars"] > 0)
        return F.struct(
            chars(lines).alias("word_chars"), chars(kept).alias("kept_chars"),
            (F.size(solid) - F.size(F.array_distinct(F.transform(solid, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            failed("punctuation").alias("n_punctuation"), failed("navigation").alias("n_navigation"),
            failed("boilerplate").alias("n_boilerplate"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("clean_text"))

    parts = bound(F.col(name), lambda t: F.struct(counts(t).alias("w"), bound(judged_lines(t), of_lines).alias("l"),
                                                     symbols_in(t).alias("n_symbols")))

    def result(p: Column) -> Column:
        n, repeated = p["w"]["n_words"], p["w"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeated > 50 * n)
        lost = p["l"]["word_chars"] - p["l"]["kept_chars"]
        return F.struct(n.alias("n_words"), p["l"]["word_chars"].alias("word_chars"), p["n_symbols"].alias("n_symbols"),
                        p["l"]["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"),
                        (~failed & (lost <= MOST_LOST * p["l"]["word_chars"])).alias("kept"),
                        *[p["l"][c].alias(c) for c in ("n_punctuation", "n_navigation", "n_boilerplate")],
                        lost.alias("lost_chars"), p["l"]["clean_text"].alias("clean_text"))

    return raw.withColumn(name, bound(parts, result))


def _free(docs: DataFrame, prefix: str) -> str:
    """A column name that the frame does not have."""
    taken, name = {c.lower() for c in docs.columns}, f"{prefix}all"
    while name.lower() in taken:
        name += "_"
    return name


def rules(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, the base counts, ``base_failed``, ``kept`` and what the line rules removed.

    A null or empty text has no words, so it fails the base rules and is not kept.  Every row is judged alone: repeated rows
    and ties get equal rows, a null id stays null, extra columns are ignored whatever their names, an empty table gives
    an empty result, and a text of any length is judged whole within its row.
    """
    seen = judged(docs, text)
    last = q(seen.columns[-1])
    fields = [f.name for f in seen.schema[seen.columns[-1]].dataType.fields if f.name != "clean_text"]
    return seen.select(q(id).alias(id), *[last[f].alias(f) for f in fields])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with the columns of ``docs``; their texts hold the lines that pass, joined by newlines.

    Null and empty texts are dropped with the other failures; everything else as in ``rules``.
    """
    seen = judged(docs, text)
    last = q(seen.columns[-1])
    return seen.where(last["kept"]).select(*[last["clean_text"].alias(c) if c == text else q(c) for c in docs.columns])
