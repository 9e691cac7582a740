"""Versions of rules over time: validity, as-of lookup, and names in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import blank, iso_date, squeeze

DATE = r"^\d{4}-\d{2}-\d{2}$"


def revision_date(label: Column) -> Column:
    """The first `YYYY. M. D.` of a label as YYYY-MM-DD."""
    return iso_date(label, r"(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})")


def assign_validity(versions: DataFrame) -> DataFrame:
    """versions (rule_name, revised_on, place) with valid_from and valid_until, half open.

    A dated version holds from the revision before it until its own; the undated, current one from the
    last revision on. Two versions of one date leave the later of them an empty interval.
    """
    of = Window.partitionBy("rule_name")
    before = F.lag("revised_on").over(of.orderBy(F.asc_nulls_last("revised_on"), "place"))
    last = F.max("revised_on").over(of)
    dated = F.col("revised_on").isNotNull()
    return versions.withColumn("valid_from", F.when(dated, before).otherwise(last)).withColumn("valid_until", F.when(dated, F.col("revised_on")))


def as_of(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (probe_id, rule_name, date) with the first version (by place) whose interval holds the date.

    An equi-join on the rule with the interval as condition; probes without a version keep nulls. Dates
    are compared as texts, as they are written.
    """
    v = versions.select("rule_name", F.struct(*[c for c in versions.columns if c != "rule_name"]).alias("version"))
    p = probes.alias("p").join(
        v.alias("v"),
        (F.col("p.rule_name") == F.col("v.rule_name"))
        & (F.col("version.valid_from").isNull() | (F.col("version.valid_from") <= F.col("p.date")))
        & (F.col("version.valid_until").isNull() | (F.col("p.date") < F.col("version.valid_until"))),
        "left",
    )
    names = [c for c in probes.columns if c != "probe_id"]
    best = p.groupBy("probe_id").agg(*[F.first(F.col(f"p.{c}")).alias(c) for c in names], F.min_by("version", "version.place").alias("version"))
    return best


def resolve_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (query_id, text) with rule_name: the one rule a text speaks of, or null.

    The longest name that the text holds; else the only name that holds the text; else the only name with
    the most of the text's words, common words not counted. names (rule_name, place) may be many: what
    holds a string holds its first two characters, and on these texts and names are joined before they
    are compared. Empty names and texts meet nothing.
    """
    text = F.trim(blank(F.col("text")))
    kept = F.filter(F.split(text, r"(?U)\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(V.STOP_WORDS) & ~t.isin(V.GENERIC_TERMS))
    q = asked.withColumn("__text", text).withColumn("__words", kept)
    of = q.where("__text != ''").select("query_id", "__text", "__words")
    held, head = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substring(c, i, F.lit(1)), F.substring(c, i, F.lit(2)))))), lambda c: F.substring(c, 1, 2)
    named = names.where("rule_name != ''")
    inside = of.select("query_id", F.explode(held(F.col("__text"))).alias("key")).join(named.select("rule_name", head(F.col("rule_name")).alias("key")), "key")
    starts = F.array_distinct(F.concat(F.array(head(F.col("__text"))), F.transform("__words", head)))
    around = of.select("query_id", F.explode(starts).alias("key")).join(named.select("rule_name", F.explode(held(F.col("rule_name"))).alias("key")), "key")
    near = inside.select("query_id", "rule_name").unionByName(around.select("query_id", "rule_name")).distinct()
    met = near.join(of, "query_id").join(named, "rule_name").where(F.col("__text").contains(F.col("rule_name")) | F.col("rule_name").contains(F.col("__text")) | F.exists("__words", lambda w: F.col("rule_name").contains(w)))
    kind = F.when(F.col("__text").contains(F.col("rule_name")), 0).when(F.col("rule_name").contains(F.col("__text")), 1).otherwise(2)
    hits = F.size(F.filter("__words", lambda w: F.col("rule_name").contains(w)))
    points = F.when(kind == 0, F.length("rule_name")).when(kind == 1, 1).otherwise(hits)
    met = met.select("query_id", "rule_name", "place", kind.alias("kind"), points.alias("points"))
    top = Window.partitionBy("query_id").orderBy("kind", F.desc("points"))
    best = met.withColumn("rank", F.rank().over(top)).where("rank = 1").groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by("rule_name", "place").alias("rule_name"))
    return asked.join(best.where("kind = 0 or n = 1").select("query_id", "rule_name"), "query_id", "left")


def pick_articles(found: DataFrame, limit: int = 5) -> DataFrame:
    """found (version with articles, keyword) with status, the chosen articles and a notice.

    A keyword keeps articles with one of its words of two characters or more; if none has, the first three.
    """
    words = F.filter(F.split(squeeze(blank(F.col("keyword"))), " "), lambda w: F.length(w) >= 2)
    held = lambda a: F.concat(blank(a["article_title"]), blank(a["body"]))
    every = F.col("version.articles")
    some = F.filter(every, lambda a: F.exists(words, lambda w: held(a).contains(w)))
    chosen = F.when(F.size(words) == 0, every).when(F.size(some) > 0, some).otherwise(F.slice(every, 1, 3))
    first = F.col("version.valid_from").isNull() & F.col("version.valid_until").isNotNull()
    return (
        found.withColumn("status", F.when(F.col("version").isNull(), "not_found").otherwise("ok"))
        .withColumn("articles", F.slice(chosen, 1, limit))
        .withColumn("notice", F.when(F.col("version").isNull(), F.lit(None)).when(first, "earliest version known; its start is unknown").otherwise("as of this date; check the current version too"))
    )
