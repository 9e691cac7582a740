"""Refresh of a stored corpus in steps: all of them succeed and the checks hold, or the store stays as it was."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import etl

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Sources:
    """What a refresh draws on; a missing table leaves its step out.

    listing (key, name), collected (new articles), documents (source_key, markdown), failures (rule_name,
    source_key, division), and collected keys (key) for the coverage report.
    """

    listing: DataFrame | None = None
    collected: DataFrame | None = None
    documents: DataFrame | None = None
    failures: DataFrame | None = None


def summary(articles: DataFrame) -> DataFrame:
    """One row: how many articles and rules there are."""
    return articles.agg(F.count(F.lit(1)).alias("n_articles"), F.count_distinct("rule_name").alias("n_rules"))


def summary_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: both summaries' counts and what was added."""
    a, b = summary(before), summary(after)
    one = lambda rows, name: rows.select(F.lit(0).alias("__k"), *[F.col(c).alias(f"{c}_{name}") for c in ("n_articles", "n_rules")])
    both = one(a, "before").join(one(b, "after"), "__k").drop("__k")
    return both.withColumn("n_articles_added", F.col("n_articles_after") - F.col("n_articles_before")).withColumn("n_rules_added", F.col("n_rules_after") - F.col("n_rules_before"))


def steps(sources: Sources) -> list[tuple[str, Step]]:
    """The steps in their order: names, new articles, record types, structure, attachments, their titles, items of failed sources."""

    def attachments(articles: DataFrame) -> DataFrame:
        found = etl.enrich_attachments(etl.extract_attachments(sources.documents), articles)
        return etl.append_missing(articles, _placed(found, articles))

    def titles(articles: DataFrame) -> DataFrame:
        sheet = F.col("record_type") == "별표"
        rows = articles.where(sheet).withColumnRenamed("article_title", "title").withColumn("label", F.col("article_no"))
        filled = etl.fill_titles(rows, etl.contents_titles(sources.documents)).withColumnRenamed("title", "article_title").drop("label", "title_source", "delegating_article")
        return articles.where(~F.coalesce(sheet, F.lit(False))).unionByName(filled)

    def items(articles: DataFrame) -> DataFrame:
        found = etl.failed_items(sources.failures, articles, sources.documents).drop("place")
        return etl.append_missing(articles, _placed(found, articles))

    wanted = [
        ("names", lambda a: etl.reconcile_names(a, sources.listing)[0], sources.listing),
        ("collection", lambda a: etl.append_missing(a, sources.collected), sources.collected),
        ("record types", etl.normalize_types, True),
        ("structure", etl.promote_structure, True),
        ("attachments", attachments, sources.documents),
        ("titles", titles, sources.documents),
        ("items", items, sources.failures),
    ]
    return [(name, step) for name, step, needed in wanted if needed is not None]


def _placed(found: DataFrame, articles: DataFrame) -> DataFrame:
    """New records behind all others; among themselves in no order that matters."""
    last = articles.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__last"))
    return found.join(F.broadcast(last)).withColumn("pos", F.col("__last") + 1 + F.monotonically_increasing_id()).drop("__last")


def refresh(spark: SparkSession, path: str, todo: list[tuple[str, Step]], checks: dict[str, Callable[[DataFrame], bool]], kind: str = "parquet") -> dict:
    """Runs the steps over the table at path and replaces it if all succeed and every check of the result holds.

    Returns a report: state (`unchanged`, `changed` or `failed`), done steps, both summaries, and the failure.
    """
    now = spark.read.format(kind).load(path)
    report: dict = {"state": "failed", "done": [], "before": summary(now).first().asDict()}
    try:
        for name, step in todo:
            now = step(now)
            now.schema  # a step that can't be planned fails here, under its own name
            report["done"].append(name)

        def hold(written: DataFrame) -> bool:
            failed = [name for name, check in checks.items() if not check(written)]
            report["failed_checks"] = failed
            return not failed

        sinks.replace_table(now, path, hold, kind)
    except Exception as e:  # whatever went wrong, the store is as it was
        return report | {"error": str(e)[:400]}
    report["after"] = summary(spark.read.format(kind).load(path)).first().asDict()
    return report | {"state": "changed" if report["after"] != report["before"] else "unchanged"}
