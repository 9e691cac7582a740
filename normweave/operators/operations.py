"""Operational tables: log, candidates, ledger, coverage, listings of rules, quality of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import values as V
from ..functions.text import blank, normal_question


def sequence_id(place: Column, prefix: str, base: int = 0) -> Column:
    """`prefix-0001` and on; place counts from 0."""
    number = (place + base + 1).cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def masked_log(events: DataFrame) -> DataFrame:
    """events (ts, question, response, answered, ...) with both texts masked and pii_kinds of either, in order."""
    once = pii.mask(pii.mask(events, "question", "__q"), "response", "__r")
    return once.withColumn("pii_kinds", F.array_distinct(F.concat(F.coalesce("__q", F.array().cast("array<string>")), F.coalesce("__r", F.array().cast("array<string>"))))).drop("__q", "__r")


def candidates(log: DataFrame) -> DataFrame:
    """(normalized_question, question, asked_count, created_at, updated_at, status) of unanswered questions in a masked log.

    Equal questions are one; the first asked stands for them. updated_at is null for one asked once.
    Map-side combining bears a question that everyone asks.
    """
    asked = log.where(~F.coalesce("answered", F.lit(False))).withColumn("normalized_question", normal_question(F.col("question")))
    grouped = asked.groupBy("normalized_question").agg(
        F.min_by("question", "ts").alias("question"), F.count(F.lit(1)).alias("asked_count"), F.min("ts").alias("created_at"), F.max("ts").alias("__last")
    )
    return grouped.withColumn("updated_at", F.when(F.col("asked_count") > 1, F.col("__last"))).withColumn("status", F.lit("pending")).drop("__last")


def capture(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, candidates): every question is logged, masked; unanswered ones are candidates too."""
    log = masked_log(events)
    return log, candidates(log)


def candidate_order(rows: DataFrame, status: str = "pending", limit: int | None = None) -> DataFrame:
    """Candidates of a status, most asked first, then oldest."""
    ordered = rows.where(F.col("status") == status).orderBy(F.desc("asked_count"), "created_at")
    return ordered if limit is None else ordered.limit(limit)


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows, newest first; none for n = 0."""
    return log.orderBy(F.desc("ts")).limit(max(0, n))


def trusted_sources(log: DataFrame, catalogue: DataFrame, fields: list[str]) -> DataFrame:
    """log (id, source_ids in order) with `sources`: official fields of each id that the catalogue has; others are dropped."""
    each = log.select("id", F.posexplode("source_ids").alias("at", "record_id"))
    met = each.join(catalogue.select("record_id", *fields), "record_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "record_id", *fields))).alias("s"))
    return log.join(met.select("id", F.transform("s", lambda x: F.struct(x["record_id"].alias("record_id"), *[x[f].alias(f) for f in fields])).alias("sources")), "id", "left")


def corpus_stats(gated: DataFrame) -> DataFrame:
    """One row of counts over gated articles with annotations missing or not."""
    ok = F.col("reason").isNull()
    return gated.agg(
        F.count_if(ok).alias("n_articles"), F.count_distinct(F.when(ok, F.col("rule_name"))).alias("n_rules"), F.count_if(~ok).alias("n_rejected"),
        F.min(F.when(ok, F.col("collected_at"))).alias("first_collected"), F.max(F.when(ok, F.col("collected_at"))).alias("last_collected"),
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share_of_peak), most frequent first."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    peak = counts.agg(F.max("n").alias("__peak"))
    return counts.join(F.broadcast(peak)).select("value", "n", F.round(F.col("n") / F.col("__peak"), 4).alias("share_of_peak"))


def rejects_by_reason(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def tier(division: Column) -> Column:
    return F.when(blank(division).startswith(V.REGULATION_PREFIX), "regulation").otherwise("guideline")


def rules_list(articles: DataFrame, division: str | None = None) -> DataFrame:
    """(rule_name, division, source_key, tier, n_articles) with the first record's attributes."""
    rows = articles if division is None else articles.where(F.col("division").contains(division))
    first = F.min_by(F.struct("division", "source_key"), "pos")
    return rows.groupBy("rule_name").agg(first.alias("f"), F.count(F.lit(1)).alias("n_articles")).select("rule_name", "f.division", "f.source_key", tier(F.col("f.division")).alias("tier"), "n_articles")


def coverage(posted: DataFrame, collected: DataFrame) -> DataFrame:
    """(division, posted, collected, rate, current_posted, current_collected, current_rate, missing), division null for the total.

    posted: key, name, division, is_current. collected: key. One pass gives divisions and total.
    """
    have = collected.select("key").distinct().withColumn("have", F.lit(True))
    rows = posted.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(False)))
    now = F.col("is_current")
    grouped = rows.rollup("division").agg(
        F.count(F.lit(1)).alias("posted"), F.count_if("have").alias("collected"), F.count_if(now).alias("current_posted"), F.count_if(now & F.col("have")).alias("current_collected"),
        F.array_sort(F.collect_list(F.when(~F.col("have"), F.col("name")))).alias("missing"), F.grouping("division").alias("is_total"),
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    return grouped.withColumn("rate", rate("collected", "posted")).withColumn("current_rate", rate("current_collected", "current_posted"))


def coverage_gaps(report: DataFrame) -> DataFrame:
    """Divisions whose current rules are not all collected, as text."""
    gaps = report.where("is_total = 0 and current_rate < 1")
    return gaps.select("division", F.format_string("%s: %d / %d", "division", "current_collected", "current_posted").alias("gap"))


def duplicate_titles(rows: DataFrame) -> DataFrame:
    """(rule_name, article_title, n, numbers) of titles that a rule has more than once; empty titles do not count."""
    titled = rows.where(F.trim(blank(F.col("article_title"))) != "")
    return titled.groupBy("rule_name", "article_title").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("article_no")).alias("numbers")).where("n > 1")


def upstream_checks(hits: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, target_rule, rank): other rules that the hits of a question refer to, the first `limit` by the hits' rank."""
    met = hits.join(edges.where("resolved and kind = 'cross_rule'").select(F.col("src_id").alias("record_id"), "target_rule"), "record_id")
    first = met.groupBy("query_id", "target_rule").agg(F.min("rank").alias("hit"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("hit", "target_rule"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "target_rule", "rank")


def contents(articles: DataFrame, addenda: bool = True) -> DataFrame:
    """Table of contents: rule by rule, addenda last, then by article and branch number, then as they came."""
    number = lambda i: F.when(F.regexp_extract(blank(F.col("article_no")), r"제\s*(\d+)\s*조(?:의\s*(\d+))?", 1) != "", F.coalesce(F.regexp_extract(blank(F.col("article_no")), r"제\s*(\d+)\s*조(?:의\s*(\d+))?", i).try_cast("int"), F.lit(0))).otherwise(1_000_000 if i == 1 else 0)
    late = F.col("record_type") == V.ADDENDUM
    rows = articles if addenda else articles.where(~late)
    rank = F.row_number().over(Window.partitionBy("rule_name").orderBy(late, number(1), number(2), "pos"))
    return rows.withColumn("rank", rank)


def contents_counts(articles: DataFrame) -> DataFrame:
    late = F.col("record_type") == V.ADDENDUM
    return articles.groupBy("rule_name").agg(F.count_if(~late).alias("n_main"), F.count_if(late).alias("n_addenda"))


def damage_inventory(articles: DataFrame) -> DataFrame:
    """(kind, tier, n): damaged records by kind of damage."""
    return articles.where(F.col("text_integrity").isNotNull()).select(F.explode("text_integrity.kinds").alias("kind"), tier(F.col("division")).alias("tier")).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


def failures_by_error(failures: DataFrame, width: int = 40) -> DataFrame:
    return failures.groupBy(F.substring("error", 1, width).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def append_ledger(ledger: DataFrame | None, entry: DataFrame) -> DataFrame:
    """The ledger with the entry, unless its corpus_fingerprint is there already."""
    if ledger is None:
        return entry
    return ledger.unionByName(entry.join(ledger.select("corpus_fingerprint"), "corpus_fingerprint", "left_anti"), allowMissingColumns=True)


def review_queue(rejected: DataFrame) -> DataFrame:
    """Rejected rows without their texts."""
    return rejected.select("row", "reason", "article.rule_name", "article.article_no", "article.article_title", "article.source_key", "article.source_url")


def point_lookup(articles: DataFrame, rule_name: str, article_no: str, record_id: str | None = None) -> DataFrame:
    """Records of a name and number (spaces in numbers ignored), main ones first, then by revision and id."""
    close = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    rows = articles.where((F.col("rule_name") == rule_name.strip()) & (close(F.col("article_no")) == article_no.replace(" ", "")))
    if record_id:
        rows = rows.where(F.col("record_id") == record_id)
    return rows.orderBy(F.col("record_type") != V.MAIN, "revision", "record_id")


def evidence_holds(text: Column, articles: Column, stop: list[str] = V.STOP_WORDS) -> Column:
    """Whether a generated text says nothing that the articles (array of name, number, title, body) do not.

    Its numbers and article numbers are a subset of theirs, each rule it names is one of them, it has one
    to six sentences, and of each sentence three fifths of the words stand in the evidence.
    """
    evidence = F.array_join(F.transform(articles, lambda a: F.concat_ws(" ", a["rule_name"], a["article_no"], a["article_title"], a["body"])), "\n")
    every = lambda x, p: F.regexp_extract_all(x, F.lit(f"({p})"), 1)
    subset = lambda p: F.size(F.array_except(every(text, p), every(evidence, p))) == 0
    names = F.transform(articles, lambda a: a["rule_name"])
    cited = F.transform(every(text, "[가-힣A-Za-z· ]{2,50}(?:규정|규칙|지침)"), lambda c: F.trim(c))
    known = F.forall(cited, lambda c: F.exists(names, lambda n: n.contains(c) | c.contains(n)))
    word = "[0-9A-Za-z가-힣]+"
    held = every(F.lower(evidence), word)
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?다요])(?U:\s)+|\n+"), lambda s: F.trim(s)), lambda s: s != "")

    def supported(s: Column) -> Column:
        said = F.array_distinct(F.filter(every(F.lower(s), word), lambda w: (F.length(w) >= 2) & ~w.isin(stop)))
        return (F.size(said) == 0) | (F.size(F.array_intersect(said, held)) / F.size(said) >= 0.6)

    return F.coalesce((blank(text) != "") & subset(r"\d+(?:[.,]\d+)?") & subset(r"제\s*\d+\s*조(?:의\s*\d+)?") & known & F.size(sentences).between(1, 6) & F.forall(sentences, supported), F.lit(False))
