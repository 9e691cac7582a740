"""Rule-based classifier of situations into a few categories, with the articles it points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import blank, literals, plain_words, tokens
from . import search as S


def category_table(categories: DataFrame, scenarios: DataFrame, aliases: dict[str, list[str]] = V.CATEGORY_ALIASES) -> DataFrame:
    """categories (place, code, name, typical_issue, selfcheck, divisions, keywords, risk) with document and phrases.

    scenarios: code, text. aliases: everyday words of a code.
    """
    texts = scenarios.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("__said"))
    known = F.coalesce(F.try_element_at(F.create_map(*[x for c, a in aliases.items() for x in (F.lit(c), literals(a))]), F.col("code")), literals([])) if aliases else literals([])
    parts = [F.col("name"), F.col("typical_issue"), F.array_join("selfcheck", " "), F.array_join("divisions", " "), F.array_join("keywords", " "), F.array_join(known, " "), F.col("__said")]
    with_text = categories.join(texts, "code", "left").withColumn("document", F.concat_ws(" ", *parts))
    return with_text.withColumn("phrases", F.concat(F.array("name"), F.col("keywords"), known)).drop("__said")


def scores(situations: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, code, place, score, exact, phrase_hits): 2 a shared word, 1/4 a shared shingle up to 8, 3 a phrase.

    The categories are a fixed handful (their number is checked to be at most 100), joined to every situation.
    """
    rows = table.select("code", "place", "phrases", plain_words(F.col("document")).alias("words"), F.filter(F.array_distinct(tokens(F.col("document"))), S.is_gram).alias("grams"))
    if rows.count() > 100:
        raise ValueError("categories are meant to be few")
    asked = situations.select("query_id", F.lower(blank(F.col("text"))).alias("low"), plain_words(F.col("text")).alias("words_q"), F.filter(F.array_distinct(tokens(F.col("text"))), S.is_gram).alias("grams_q"))
    met = asked.join(F.broadcast(rows))
    exact = F.array_sort(F.array_intersect("words_q", "words"))
    shared = F.least(F.size(F.array_intersect("grams_q", "grams")), F.lit(8))
    phrases = F.size(F.filter("phrases", lambda p: (p != "") & F.col("low").contains(F.lower(p))))
    met = met.withColumn("exact", exact).withColumn("phrase_hits", phrases)
    return met.select("query_id", "code", "place", (F.size("exact") * 2.0 + shared * 0.25 + F.col("phrase_hits") * 3.0).alias("score"), "exact", "phrase_hits")


def decide(scored: DataFrame) -> DataFrame:
    """Best category of each situation: (query_id, code, score, exact, confidence, matched)."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    best = scored.withColumn("rank", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).where("rank = 1")
    high = (F.col("score") >= 10.0) & (F.col("phrase_hits") >= 2) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= 3.0)
    matched = (F.size("exact") >= 2) | high
    return best.select("query_id", F.when(matched, F.col("code")).alias("code"), F.round("score", 2).alias("score"), "exact", F.when(matched, F.when(high, "high").otherwise("medium")).alias("confidence"), matched.alias("matched"))


def linked_articles(decided: DataFrame, table: DataFrame, index: S.Index, k: int = 3) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k of what the category's anchors find, each article by its best score.

    All anchors are searched as one batch; a category's anchors are searched once, however many situations it has.
    """
    used = table.join(decided.where("matched").select("code").distinct(), "code", "left_semi")
    asked = used.select("code", F.posexplode(F.concat("keywords", "divisions")).alias("at", "query")).withColumn("query_id", F.concat_ws("/", "code", F.col("at").cast("string"))).withColumn("k", F.lit(k))
    found = S.search(index, asked.select("query_id", "query", "k"), default_k=k).select("query_id", "doc_id", "source_key", "article_no", "score")
    found = found.withColumn("code", F.substring_index("query_id", "/", 1)).withColumn("at", F.substring_index("query_id", "/", -1).cast("int"))
    best = found.groupBy("code", "source_key", "article_no").agg(F.min_by(F.struct("doc_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("at"))).alias("r"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("r.score"), "first", "r.doc_id"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k).select("code", "rank", "r.doc_id", "r.score")
    return decided.where("matched").select("query_id", "code").join(top, "code").select("query_id", "rank", "doc_id", "score")


def render(code: Column, name: Column, risk: Column, issue: Column, questions: Column, cited: Column) -> Column:
    """The answer as text: the category, its numbered questions, and the cited articles or that there are none."""
    numbered = F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    sources = F.when(F.size(cited) > 0, F.concat(F.lit("연결된 규정 조문:\n"), F.array_join(cited, "\n"))).otherwise("연결 규정: 해당 규정 미확인")
    return F.concat_ws("\n", F.concat(code, F.lit(" "), name, F.lit(" ("), risk, F.lit(")")), issue, numbered, sources)
