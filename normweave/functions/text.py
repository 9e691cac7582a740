"""Column expressions for words, their forms, and text clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

WORD = "[0-9A-Za-z가-힣]+"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end; `trim` takes spaces only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def blank(x: Column) -> Column:
    """The column, with null as empty text."""
    return F.coalesce(x, F.lit(""))


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def alternatives(words: list[str]) -> str:
    """A pattern for any of the words as they are."""
    return "|".join("".join("\\" + c if c in r"\.[]{}()*+-?^$|&" else c for c in w) for w in words)


def words(text: Column, without: list[str] = V.STOP_WORDS) -> Column:
    """Lower-case words of two characters or more, less the given ones; repeats stay."""
    found = F.regexp_extract_all(F.lower(blank(text)), F.lit(f"({WORD})"), 1)
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(without))


def full_forms(word: Column, particles: list[str] = V.PARTICLES) -> Column:
    """The word, and without its particle if that leaves two characters or more."""
    bare = F.regexp_extract(word, f"^(.{{2,}}?)({alternatives(particles)})$", 1)
    return F.when(bare != "", F.array(word, bare)).otherwise(F.array(word))


def grams(word: Column) -> Column:
    """Distinct `#` shingles of two and three characters of a Hangul word; none of any other."""
    some = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.concat(F.lit("#"), F.substring(word, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.when(word.rlike("^[가-힣]+$"), F.array_distinct(F.concat(some(2), some(3)))).otherwise(F.array().cast("array<string>"))


def forms(word: Column) -> Column:
    return F.concat(full_forms(word), grams(word))


def tokens(text: Column) -> Column:
    """Search terms of a text: all forms of all its words, repeats included.

    Only Hangul words have forms beside themselves, so a text without Hangul is spared the search for them.
    """
    found = words(text)
    return F.when(blank(text).rlike("[가-힣]"), F.flatten(F.transform(found, forms))).otherwise(found)


def query_words(text: Column) -> Column:
    """Distinct words of a question, in order."""
    return F.array_distinct(words(text))


def plain_words(text: Column) -> Column:
    """Distinct words for the classifier, which leaves out words of its own."""
    return F.array_distinct(words(text, V.PLAIN_GENERIC))


def normal_question(text: Column) -> Column:
    """Lower case, single spaces: equal questions are equal texts."""
    return squeeze(F.lower(blank(text)))


def iso_date(text: Column, pattern: str = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})") -> Column:
    """The first `YYYY. M. D.` of a text as YYYY-MM-DD, or null; the calendar is not checked."""
    part: Callable[[int], Column] = lambda i: F.regexp_extract(blank(text), pattern, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def occurrences(text: Column, part: str) -> Column:
    """How often part stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: a lambda that names a larger expression makes it anew for every element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
