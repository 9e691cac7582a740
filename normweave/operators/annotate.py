"""Annotations of accepted articles: versions, repeals and damaged characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import blank, iso_date, let, strip

#: A name with a trailing note in brackets that speaks of a version, or of a year.
_VERSION = r"(?s)^(.+?)(?U:\s*)\(([^)]*(?:제정|개정|폐지|이전)[^)]*|(?U:\s*)\d{4}[^)]*)\)(?U:\s*)$"
_PAST = r"(?U)개정\s*전|이전|폐지|(?:19|20)\d{2}"
_REPEALED = r"(?U)^\s*<?\s*삭제\s*(\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?)?"
_MARKS = "[" + "".join(V.CLAUSE_MARKS) + "]"
_GONE = r"\s*[(<]?\s*삭제\s*[)>]?\s*(?:<\s*([^>]*?)\s*>)?"

CLAUSE_KIND = "array<struct<clause:string,repealed_date:string>>"
ITEM_KIND = "array<struct<clause:string,item:string,repealed_date:string>>"


def base_name(name: Column) -> Column:
    """The name without its version note; null for a name that has none."""
    base = strip(F.regexp_extract(blank(name), _VERSION, 1))
    return F.when(F.regexp_extract(blank(name), _VERSION, 2) != "", base)


def repealed_clauses(body: Column) -> Column:
    pattern = F.lit(f"(?U)({_MARKS}){_GONE}")
    pairs = F.arrays_zip(F.regexp_extract_all(blank(body), pattern, 1).alias("a"), F.regexp_extract_all(blank(body), pattern, 2).alias("b"))
    return F.transform(pairs, lambda x: F.struct(x["a"].alias("clause"), iso_date(x["b"]).alias("repealed_date"))).cast(CLAUSE_KIND)


def repealed_items(body: Column) -> Column:
    """Repealed items with the clause mark last seen before each.

    The text is cut in front of every repealed item; the marks of the pieces before a piece are those
    before its item.
    """
    head = rf"(?mdU)^\s*(\d{{1,2}})\s*\.{_GONE}"
    pieces = F.split(F.regexp_replace(blank(body), head, "\u0001$1\u0002$2\u0003"), "\u0001")
    parted = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.regexp_extract(F.substring_index(p, "\u0003", -1), f"(?s)^.*({_MARKS})", 1).alias("mark")))

    def items(parted: Column) -> Column:
        return F.transform(F.slice(parted, F.lit(2), F.size(parted)), lambda x, i: F.struct(
            _last_mark(F.slice(parted, F.lit(1), i + 1)).alias("clause"),
            F.substring_index(x["p"], "\u0002", 1).alias("item"),
            iso_date(F.substring_index(F.substring_index(x["p"], "\u0003", 1), "\u0002", -1)).alias("repealed_date"),
        ))

    return F.when(F.size(parted) > 1, let(parted, items)).otherwise(F.array()).cast(ITEM_KIND)


def _last_mark(parted: Column) -> Column:
    return F.try_element_at(F.filter(parted, lambda x: x["mark"] != ""), F.lit(-1))["mark"]


def text_integrity(body: Column) -> Column:
    """(suspect_marks, kinds in the order found, sentence_questions, note), or null for an undamaged text.

    Each question mark is judged by what stands around it: inside a word a lost middle dot, at the head
    of a line before a space a lost clause mark, before a letter a lost quotation mark.
    """
    text = blank(body)
    pieces = F.split(text, r"\?", -1)
    letter, word = "[가-힣A-Za-z]", "[0-9A-Za-z가-힣]"

    def kind(pieces: Column, i: Column) -> Column:
        # A piece between two marks may be empty; then the neighbour is the other mark.
        piece, after = F.get(pieces, i), F.get(pieces, i + 1)
        before = F.when(piece != "", F.right(piece, F.lit(1))).when(i == 0, "\n").otherwise("?")
        nxt = F.when(after != "", F.left(after, F.lit(1))).when(i + 2 < F.size(pieces), "?").otherwise("")
        head = (before == "\n") | ((before == " ") & (F.rtrim(piece).endswith("\n") & piece.endswith(" ")))
        return (
            F.when(before.rlike(word) & nxt.rlike(word), V.DAMAGE_DOT)
            .when(head, F.when((nxt == " ") | (nxt == "\u00a0"), V.DAMAGE_MARK).otherwise(V.DAMAGE_QUOTE))
            .when(nxt.rlike(letter), V.DAMAGE_QUOTE)
        )

    def whole(found: Column) -> Column:
        told = F.struct(
            F.size(found).alias("suspect_marks"),
            F.array_distinct(found).alias("kinds"),
            F.regexp_count(text, F.lit(r"(?U)[다까요나가]\?(?:\s|$)")).alias("sentence_questions"),
            F.lit("characters damaged at the source; quote as they are").alias("note"),
        )
        return F.when(F.size(found) > 0, told)

    found = let(pieces, lambda ps: F.array_compact(F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), lambda p, i: kind(ps, i))))
    return F.when(text.contains("?"), let(found, whole))


def annotate(articles: DataFrame) -> DataFrame:
    """Accepted articles (with pos) with version, repeal and damage columns.

    A record is superseded if its base name is a current name, or if its note says so. superseded_by is
    the last record of the base name and the same article number. Names and numbers are joined as keys;
    no table is assumed small.
    """
    named = articles.withColumn("__base", base_name(F.col("rule_name"))).withColumn("__note", F.regexp_extract(blank(F.col("rule_name")), _VERSION, 2))
    current = named.where(F.col("__base").isNull())
    names = current.select(F.col("rule_name").alias("__base")).distinct().withColumn("__known", F.lit(True))
    last = current.groupBy(F.col("rule_name").alias("__base"), F.col("article_no").alias("article_no")).agg(F.max_by("record_id", "pos").alias("__by"))
    past = F.col("__base").isNotNull() & (F.coalesce("__known", F.lit(False)) | F.col("__note").rlike(_PAST))
    date = F.regexp_extract(blank(F.col("body")), _REPEALED, 1)
    return (
        named.join(names, "__base", "left")
        .join(last, ["__base", "article_no"], "left")
        .withColumn("is_current", ~past)
        .withColumn("superseded_by", F.when(past, F.col("__by")))
        .withColumn("is_repealed", blank(F.col("body")).rlike(_REPEALED))
        .withColumn("repealed_date", F.when(F.col("is_repealed"), iso_date(date)))
        .withColumn("text_integrity", text_integrity(F.col("body")))
        .withColumn("repealed_clauses", repealed_clauses(F.col("body")))
        .withColumn("repealed_items", repealed_items(F.col("body")))
        .withColumn("clause_index_undetermined", F.when(blank(F.col("body")).rlike(r"(?md)^(?U:\s*)\?(?=(?U:\s))"), True))
        .drop("__base", "__note", "__known", "__by")
    )
