"""Two-stage ranked search over a table of questions: one plan, whatever their number.

Rules that a question is routed to are joined to its terms before anything is scored, so only their
articles are; a question whose routed rows all fail is scored over all articles in a second step. Which
pairs of a question and an article share enough words is counted first, and only these are scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.frames import settled
from ..functions.text import blank, full_forms, let, occurrences, query_words, tokens


#: Rows up to which a batch's terms, or the pairs left to be scored, are sent to all tasks; more are met in a join by key.
MOST_SENT = 200_000


def sent(rows: DataFrame) -> DataFrame:
    """The rows, to be sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


@dataclass
class Index:
    """articles (doc_id and all their columns); terms (doc_id, rule_name, term, tf, in_name, in_title, in_division);
    lengths (doc_id, rule_name, length, is_current, is_repealed, is_attachment); stats (term, df);
    profiles (rule_name, term, weight); totals: one row, n_docs and avg_length."""

    articles: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    profiles: DataFrame
    totals: DataFrame

    @cached_property
    def size(self) -> tuple[int, float]:
        """Articles, and their mean length."""
        row = self.totals.first()
        return row.n_docs, row.avg_length or 1.0


def build(articles: DataFrame, only: DataFrame | None = None) -> Index:
    """Index of articles (pos, rule_name, division, article_no, article_title, body, and any flags).

    Terms are counted inside rows; only what is asked of the term table is shuffled. With `only` (term), a
    batch's terms, no other term leaves the articles; lengths and totals are those of all. Null texts are
    empty. An article without words has length 0. `pos` must tell articles apart.
    """
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in articles.columns else F.lit(other)
    docs = articles.withColumn("doc_id", F.col("pos"))
    full = F.concat_ws(" ", *[blank(F.col(c).cast("string")) for c in ("rule_name", "division", "article_no", "article_title", "body")])
    fields = {"in_name": "rule_name", "in_title": "article_title", "in_division": "division"}
    sets = {k: F.array_distinct(tokens(F.col(c).cast("string"))) for k, c in fields.items()}
    kind = F.col("record_type") if "record_type" in articles.columns else F.lit(V.MAIN)
    worded = docs.select(
        "doc_id", F.col("rule_name"), tokens(full).alias("__tokens"), *[s.alias(k) for k, s in sets.items()],
        flag("is_current", True).alias("is_current"), flag("is_repealed", False).alias("is_repealed"), F.coalesce(kind == V.ATTACHMENT, F.lit(False)).alias("is_attachment"),
    )
    lengths = worded.select("doc_id", "rule_name", F.size("__tokens").alias("length"), "is_current", "is_repealed", "is_attachment")
    # A row holds all of its document's words, so they are counted inside it and only distinct terms leave it.
    terms = worded.select("doc_id", "rule_name", *sets, F.explode(counted(F.col("__tokens"))).alias("x")).select("doc_id", "rule_name", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), *sets)
    # Flags before the join: if the batch is too large to be sent, the words of names and titles don't go with each term.
    terms = terms.select("doc_id", "rule_name", "term", "tf", *[F.array_contains(k, F.col("term")).alias(k) for k in sets])
    if only is not None:
        terms = terms.join(sent(only.select("term").distinct()), "term", "left_semi")
    if only is not None:  # a few columns of a row for each article, and the batch's terms: read more than once, made once
        terms, lengths = terms.persist(), lengths.persist()
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(docs, terms, lengths, stats, profiles(articles), totals)


def counted(words: Column) -> Column:
    """Distinct words with how often they stand in the array, as (term, tf)."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def profiles(articles: DataFrame) -> DataFrame:
    """(rule_name, term, weight): terms of name, division and titles, weighed and summed over a rule's articles."""

    def weighed(column: str, weight: int) -> Column:
        return F.transform(tokens(F.col(column).cast("string")), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    terms = [weighed("rule_name", V.PROFILE_NAME), weighed("division", V.PROFILE_DIVISION), weighed("article_title", V.PROFILE_TITLE)]
    parts = articles.select("rule_name", F.explode(F.concat(*terms)).alias("x"))
    return parts.groupBy("rule_name", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("weight"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def is_gram(term: Column) -> Column:
    return term.startswith("#")


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, qf) of questions (query_id, query)."""
    return questions.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def known_terms(index: Index, asked: DataFrame) -> DataFrame:
    """asked with idf, for terms that stand in some article."""
    wanted = index.stats.join(asked.select("term").distinct(), "term")
    return asked.join(wanted.select("term", idf(F.lit(index.size[0]), F.col("df")).alias("idf")), "term")


def route(index: Index, asked: DataFrame, top: int = V.ROUTE_TOP, ties: int = V.ROUTE_TIES) -> DataFrame:
    """(query_id, rule_name) of the rules that a question is narrowed to; none if too many tie.

    asked: from `known_terms`. A rule needs a full term that is not generic. With over `top` rules all
    that score as much as the last of them pass, unless that makes over `ties`.
    """
    met = index.profiles.join(asked, "term")
    score = F.sum(F.col("idf") * F.least(F.col("weight"), F.lit(V.PROFILE_CAP)) * F.col("qf"))
    core = F.max(~is_gram(F.col("term")) & ~F.col("term").isin(V.GENERIC_TERMS))
    scored = met.groupBy("query_id", "rule_name").agg(F.round(score, 9).alias("score"), core.alias("core")).where("core and score > 0")
    passed = scored.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") <= top)
    # All of at most `top` rules rank within it; more than that are limited by their ties.
    sizes = passed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= ties)
    return passed.join(sizes, "query_id", "left_semi").select("query_id", "rule_name")


def score(index: Index, questions: DataFrame, boosts: bool = True, routes: DataFrame | None = None, pairs: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rule_name, is_attachment, score, matched): scored articles that a question may use.

    questions: query_id, query, and flags include_superseded and include_repealed, false where missing.
    routes (query_id, rule_name): only articles of these rules are scored. pairs (query_id, doc_id): only these are.
    asked: the questions' `known_terms`, if they are there already.
    """
    asked = known_terms(index, question_terms(questions)) if asked is None else asked
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in questions.columns else F.lit(False).alias(c) for c in ("include_superseded", "include_repealed")]
    lengths = index.lengths.select("doc_id", "length", "is_current", "is_repealed", "is_attachment")
    norm = F.col("tf") + V.K1 * (1.0 - V.B + V.B * F.col("length") / F.lit(index.size[1]))
    part = F.col("idf") * (F.col("tf") * (V.K1 + 1.0) / norm) * F.col("qf")
    if boosts:
        for c, boost in (("in_name", V.BOOST_NAME), ("in_title", V.BOOST_TITLE), ("in_division", V.BOOST_DIVISION)):
            part = part + F.when(F.col(c), boost * F.col("idf")).otherwise(0.0)
    if pairs is None:
        asked, keys = (asked, ["term"]) if routes is None else (asked.join(routes, "query_id"), ["rule_name", "term"])
        met = index.terms.join(asked, keys)
    else:  # terms of an article are together from here on; only small tables come to them
        terms = index.terms.join(pairs, "doc_id")
        terms = terms if routes is None else terms.join(sent(routes), ["query_id", "rule_name"], "left_semi")
        met = terms.join(sent(asked), ["query_id", "term"])
    met = met.join(lengths, "doc_id").join(questions.select("query_id", *flags), "query_id")
    met = met.where((F.col("is_current") | F.col("include_superseded")) & (~F.col("is_repealed") | F.col("include_repealed")))
    matched = F.array_sort(F.collect_set(F.when(~is_gram(F.col("term")), F.col("term"))))
    return met.groupBy("query_id", "doc_id", "rule_name", "is_attachment").agg(F.round(F.sum(part), 9).alias("score"), matched.alias("matched"))


def core_words(questions: DataFrame) -> DataFrame:
    """(query_id, core): the forms of each word of a question that is not generic."""
    listed = F.transform(query_words(F.col("query")), lambda w: full_forms(w))
    return questions.select("query_id", F.filter(listed, lambda f: ~F.arrays_overlap(f, F.array(*map(F.lit, V.GENERIC_TERMS)))).alias("core"))


def covered(index: Index, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id) of all pairs that `relevant` can keep, and of some that it won't.

    Forms of core words that stand in an article are counted, so a word counts once for each of its forms:
    no fewer than the words that `relevant` counts. Nothing but a count is shuffled, summed up beforehand
    by the task that reads the article; scores and matched words are made for these pairs only.
    """
    least = F.greatest(F.lit(1.0), V.COVERAGE * F.size("core"))
    asked = core_words(questions).select("query_id", least.alias("least"), F.explode(F.flatten("core")).alias("term"))
    counts = index.terms.join(sent(asked), "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return counts.where(F.col("n") >= F.col("least")).select("query_id", "doc_id")


def relevant(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored rows in which enough of a question's core words stand, and one of them at least."""
    asked = core_words(questions)
    hits = F.size(F.filter("core", lambda f: F.arrays_overlap(f, F.col("matched"))))
    return scored.join(asked, "query_id").withColumn("hits", hits).where((F.col("hits") >= 1) & (F.col("hits") >= V.COVERAGE * F.size("core")) & (F.col("score") > 0)).drop("hits", "core")


def ranked(index: Index, questions: DataFrame, default_k: int = 5) -> DataFrame:
    """(query_id, doc_id, rank, score, matched_terms, routing, is_attachment): up to 2k + 10 rows a question."""
    k = F.coalesce(F.col("k"), F.lit(default_k)) if "k" in questions.columns else F.lit(default_k)
    # Each of these is small, and several branches read it.
    asked = settled(known_terms(index, question_terms(questions)))
    pairs = sent(settled(covered(index, questions)))
    first = settled(relevant(score(index, questions, routes=settled(route(index, asked)), pairs=pairs, asked=asked), questions))
    open_ones = questions.join(first.select("query_id").distinct(), "query_id", "left_anti")
    rows = first.withColumn("any", F.lit(True)).unionByName(relevant(score(index, open_ones, pairs=pairs, asked=asked), open_ones).withColumn("any", F.lit(False)))
    rows = rows.join(questions.select("query_id", k.alias("k")), "query_id").where("k > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= 2 * F.col("k") + 10)
    routing = F.when(F.col("any"), "rule-first").otherwise("full-scan")
    return settled(rows.select("query_id", "k", "doc_id", "rank", F.round("score", 4).alias("score"), F.col("matched").alias("matched_terms"), routing.alias("routing"), "is_attachment"))


def attachment_gate(rows: DataFrame, include: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, omitted) of ranked rows: the first k without attachments, and each attachment above the last of them.

    With include, the first k of all, and nothing is omitted.
    """
    if include:
        return rows.where(F.col("rank") <= F.col("k")), rows.limit(0)
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("nth", F.count_if(~F.col("is_attachment")).over(so_far))
    results = counted.where(~F.col("is_attachment") & (F.col("nth") <= F.col("k")))
    last = F.max(F.when(~F.col("is_attachment") & (F.col("nth") <= F.col("k")), F.col("rank"))).over(Window.partitionBy("query_id"))
    omitted = counted.withColumn("last", last).where(F.col("is_attachment") & (F.col("last").isNull() | (F.col("rank") < F.col("last"))))
    return results.drop("nth"), omitted.drop("nth", "last")


def summarize_attachment(rows: DataFrame) -> DataFrame:
    """Rows with sizes of attachments, whose bodies are cut to a snippet; other rows have nulls."""
    isa, body = F.col("record_type") == V.ATTACHMENT, blank(F.col("body"))
    return (
        rows.withColumn("body_length", F.when(isa, F.length(body)))
        .withColumn("n_tables", F.when(isa, occurrences(body, "<table")))
        .withColumn("n_rows", F.when(isa, occurrences(body, "<tr")))
        .withColumn("body_cut", F.when(isa, F.length(body) > V.SNIPPET))
        .withColumn("body", F.when(isa, F.substring(body, 1, V.SNIPPET)).otherwise(F.col("body")))
    )


def search(index: Index, questions: DataFrame, include_attachments: bool = False, default_k: int = 5) -> DataFrame:
    """Results with the articles' columns, fetched by id only for rows that stay."""
    results, _ = attachment_gate(ranked(index, questions, default_k), include_attachments)
    found = results.drop("is_attachment", "k").join(index.articles, "doc_id")
    return summarize_attachment(found) if include_attachments and "record_type" in index.articles.columns else found


def unmatched_words(index: Index, questions: DataFrame) -> DataFrame:
    """(query_id, place, word): words of a question none of whose full forms is in the vocabulary."""
    words = questions.select("query_id", F.posexplode(query_words(F.col("query"))).alias("place", "word"))
    formed = words.select("*", F.explode(full_forms(F.col("word"))).alias("term"))
    known = formed.join(index.stats.select("term"), "term", "left_semi").select("query_id", "word").distinct()
    return words.join(known, ["query_id", "word"], "left_anti").select("query_id", "place", "word")


def hints(results: DataFrame, questions: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(query_id, hint) for questions with at most one result: no_such_concept if a word is unknown, else cross_reference."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    gaps = unmatched.select("query_id").distinct().withColumn("gap", F.lit(True))
    rows = questions.select("query_id").join(counts, "query_id", "left").join(gaps, "query_id", "left").where(F.coalesce("n", F.lit(0)) <= 1)
    return rows.select("query_id", F.when(F.coalesce("gap", F.lit(False)), "no_such_concept").otherwise("cross_reference").alias("hint"))


def citation(name: Column, number: Column, title: Column, body: Column, url: Column) -> Column:
    """Name, number and title in brackets, the text, and the source."""
    head = F.concat(F.lit("["), name, F.lit(" "), number, F.when(blank(title) != "", F.concat(F.lit(" ("), title, F.lit(")"))).otherwise(""), F.lit("]"))
    return F.concat_ws("\n", head, body, F.concat(F.lit("출처: "), url))
