"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: navigation (short items between separators), symbols, shouting, short
boilerplate, and paragraphs of prose without any end of a sentence. Lines that follow each other make one
paragraph, so wrapped prose is judged by the whole of it. Failing lines are removed; a document that loses
too large a share of its characters this way is rejected. All of it happens inside a row, so nothing is
shuffled and no document or source can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .runtime import attach, table

#: Share of a document's characters (of lines with words) that may be lost to failing lines, in percent.
MOST_LOST = 50
#: The six white-space characters between words, the symbols, and what ends a sentence.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Ends of sentences in Latin, Devanagari, CJK, Arabic, Ethiopic, Armenian, Khmer and Burmese writing.
ENDS = ".!?…।॥。！？｡؟۔።։។၊။"
#: What stands between the items of a navigation line.
BARS = "|»›·•"
#: Fixed value: boilerplate, in lower case.
BOILERPLATE = r"(licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|lorem ipsum|click here|sign up for|subscribe to our|powered by|back to top|skip to (main )?content)"
#: Words from which a paragraph counts as prose (which has sentences), words it then has in a line on average (a list has
#: fewer), and words from which capitals alone are shouting.
PROSE, WIDE, SHOUT = 8, 6, 3
#: Separators of a navigation line at least, words an item has at most on average, and words of a boilerplate line at most.
ITEMS, ITEM_WORDS, BOILER_WORDS = 2, 4, 12
REPEAT = 5
#: Between paragraphs: an end of line before a line without words.
PARAGRAPH = r"\n(?=[\x20\x09\x0B-\x0D]*(?:\n|\z))"


def words_of(text: Column) -> Column:
    """Words between white space; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _n_words(text: Column) -> Column:
    """Words of a text that has some, without white space at its ends."""
    return F.size(F.split(text, r"[\x20\x09-\x0D]+"))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule of its own."""

    def judge(bare: Column) -> Column:
        length, words = F.length(bare), _n_words(bare)
        symbols = length - F.length(_without(bare, SYMBOLS))
        # A bar between spaces parts items; quotation marks hug their words.
        bars = F.size(F.split(bare, rf"(?<=[\x20\x09])[{BARS}]+(?=[\x20\x09])")) - 1
        # What is cheap and mostly false comes first: words are counted and bars looked for on few lines.
        navigation = bare.rlike(f"[{BARS}]") & (bars >= ITEMS) & ~bare.rlike(f"[{ENDS}]") & (words - bars <= ITEM_WORDS * (bars + 1))
        noisy = bare.rlike(f"[{SYMBOLS}]") & (symbols >= 3) & (symbols * 20 > length)
        shouting = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (words >= SHOUT)
        boilerplate = F.lower(bare).rlike(BOILERPLATE) & (words <= BOILER_WORDS)
        return navigation | noisy | shouting | boilerplate

    return let(F.btrim(line, F.lit(SPACE)), judge)


def endless(paragraph: Column) -> Column:
    """Whether a paragraph is prose without any end of a sentence."""

    def judge(bare: Column) -> Column:
        words, lines = _n_words(bare), F.length(bare) - F.length(F.translate(bare, "\n", "")) + 1
        return ~bare.rlike(f"[{ENDS}]") & (words >= PROSE) & (words >= WIDE * lines)

    return let(F.btrim(paragraph, F.lit(SPACE)), judge)


OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with OUTPUTS: counts, base_failed, kept, and `cleaned`, the text without its failing lines.

    A null text counts as empty, but its cleaned text is null; an empty text fails the base. Lines
    without words are neither counted nor removed. Texts of any length are judged whole; repeated rows
    get equal results. An input column named like an output is replaced; the others stay.
    """
    stay = attach(docs, OUTPUTS)
    wide = docs.select(*stay, F.coalesce(docs[text_col], F.lit("")).alias("__text"), docs[text_col].isNull().alias("__null"))
    wide = wide.withColumn("__words", words_of(F.col("__text"))).withColumn("__all", F.split("__text", "\n"))
    wide = wide.withColumn("__lines", F.filter("__all", lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    bare = F.length(_without(F.col("__text"), SPACE))
    wide = wide.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", bare.cast("long"))
    wide = wide.withColumn("n_symbols", (F.length("__text") - F.length(_without(F.col("__text"), SYMBOLS))).cast("long"))
    wide = wide.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    wide = repeated_words(wide)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    wide = wide.withColumn("base_failed", failed)
    # Paragraphs are runs of lines with words; the lines of a failing one go as a whole, of others each by itself.
    wide = wide.withColumn("__paragraphs", F.split("__text", PARAGRAPH))
    blank = lambda x: F.btrim(x, F.lit(SPACE)) == ""
    passing = F.transform("__paragraphs", lambda p: let(endless(p), lambda bad: F.filter(F.split(p, "\n"), lambda x: blank(x) | (~bad & ~line_fails(x)))))
    wide = wide.withColumn("__stay", F.flatten(passing))
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.btrim(x, F.lit(SPACE))))
    wide = wide.withColumn("__lost", size(F.col("__lines")) - size(F.col("__stay"))).withColumn("__of", size(F.col("__lines")))
    kept = ~F.col("base_failed") & (100 * F.col("__lost").cast("long") <= MOST_LOST * F.col("__of").cast("long"))
    cleaned = F.when(~F.col("__null"), F.array_join("__stay", "\n"))
    return wide.withColumn("kept", kept).withColumn("cleaned", cleaned).select(*stay, *OUTPUTS)


def repeated_words(wide: DataFrame) -> DataFrame:
    """n_repeat_words from __words: words in windows of REPEAT words that occur twice or more.

    Windows are hashed; only where two hashes of a text agree are the agreeing windows compared as text.
    """
    windows = F.size("__words") - (REPEAT - 1)
    hashes = F.when(windows > 0, F.transform(F.sequence(F.lit(1), F.greatest(windows, F.lit(1))), lambda i: F.xxhash64(F.slice("__words", i, REPEAT))))
    wide = wide.withColumn("__h", F.coalesce(hashes, F.array().cast("array<bigint>")))
    wide = wide.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))

    def twins(column: str, key: str) -> Column:
        same = lambda x, i: F.get(column, i)[key].eqNullSafe(x[key])
        return F.filter(column, lambda x, i: same(x, i - 1) | same(x, i + 1))

    wide = wide.withColumn("__p", twins("__p", "h"))
    wide = wide.withColumn("__q", F.sort_array(F.transform("__p", lambda x: F.struct(F.array_join(F.slice("__words", x["i"] + 1, REPEAT), " ").alias("w"), x["i"].alias("i")))))
    wide = wide.withColumn("__at", F.sort_array(F.transform(twins("__q", "w"), lambda x: x["i"])))
    covered = F.transform("__at", lambda x, i: F.least(F.lit(REPEAT), F.coalesce(F.get("__at", i + 1) - x, F.lit(REPEAT))))
    return wide.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SQL_SPACE}) <> '') AS lines
  FROM t
), line AS (
  SELECT rid, i, trim(x, {_SQL_SPACE}) AS x FROM (SELECT rid, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT rid, string_split(text, chr(10)) AS l FROM t))
), parted AS (
  SELECT *, count(*) FILTER (x = '') OVER (PARTITION BY rid ORDER BY i) AS p FROM line
), judged AS (
  SELECT rid, p, x, length(x) AS n, len(w) AS nw, length(x) - length(translate(x, '{SYMBOLS}', '')) AS sym, length(translate(x, '{ENDS}', '')) = length(x) AS open,
    len(list_filter(w[2:len(w) - 1], lambda y: regexp_full_match(y, '[{BARS}]+'))) AS bars
  FROM (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM parted WHERE x <> '')
), prose AS (
  SELECT rid, p, sum(nw) >= {PROSE} AND sum(nw) >= {WIDE} * count(*) AND bool_and(open) AS bad FROM judged GROUP BY rid, p
), lost AS (
  SELECT rid, sum(n) AS total, coalesce(sum(n) FILTER (
    bad OR (bars >= {ITEMS} AND nw - bars <= {ITEM_WORDS} * (bars + 1) AND open) OR (sym >= 3 AND sym * 20 > n)
    OR (nw >= {SHOUT} AND upper(x) = x AND lower(x) <> x) OR (nw <= {BOILER_WORDS} AND regexp_matches(lower(x), '{BOILERPLATE}'))), 0) AS gone
  FROM judged JOIN prose USING (rid, p) GROUP BY rid
), gram AS (
  SELECT rid, unnest(range(1, len(words) - {REPEAT} + 2)) AS i, words FROM w WHERE len(words) >= {REPEAT}
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + {REPEAT} - 1]) AS c FROM gram) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + {REPEAT})) AS p FROM twice) GROUP BY rid
), base AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(text, {_SQL_SPACE}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), failed AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * coalesce(gone, 0) <= {MOST_LOST} * coalesce(total, 0) AS kept
FROM failed LEFT JOIN lost USING (rid)
"""
