"""Load gate: identity, reject reasons and duplicates of article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import blank, strip

REQUIRED = ["rule_name", "division", "article_no", "article_title", "body", "source_key", "source_url"]
REASONS = ["empty_body", "oversized_body", "invalid_source_url", "duplicate_record"]


def record_type(title: Column, body: Column) -> Column:
    """Addendum by its title or the body's first word, else main."""
    starts = F.regexp_replace(blank(body), r"(?U)^\s+", "").startswith(V.ADDENDUM)
    return F.when(strip(blank(title)).isin(V.ADDENDUM_TITLES) | starts, V.ADDENDUM).otherwise(V.MAIN)


def identity(fields: list[Column]) -> Column:
    """First 16 hex digits of the SHA-256 of the stripped fields, joined by U+001F; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[strip(blank(f.cast("string"))) for f in fields]), 256), 1, 16)


def prepare(articles: DataFrame) -> DataFrame:
    """articles with record_type, revision and record_id; values that they bring along win."""
    given = lambda c: F.col(c) if c in articles.columns else F.lit(None).cast("string")
    kept = lambda c: F.when(given(c) != "", given(c))
    typed = articles.withColumn("record_type", F.coalesce(kept("record_type"), record_type(F.col("article_title"), F.col("body"))))
    digest = identity([F.col(c) for c in ("source_key", "article_no", "record_type", "article_title", "body")])
    return (
        typed.withColumn("__id", digest)
        .withColumn("revision", F.coalesce(kept("revision"), F.concat("record_type", F.lit("-"), F.substring("__id", 1, 12))))
        .withColumn("record_id", F.coalesce(kept("record_id"), F.concat(F.lit("rule-"), blank(F.col("source_key").cast("string")), F.lit("-"), F.col("__id"))))
        .drop("__id")
    )


def official_url(url: Column, key: Column, hosts: dict[str, str] = V.SOURCE_HOSTS) -> Column:
    """Whether url is https on an official host or below it, with the host's parameter equal to key, once."""
    url = strip(blank(url))
    host = F.regexp_replace(F.lower(blank(F.try_parse_url(url, F.lit("HOST")))), r"\.+$", "")
    pairs = F.split(blank(F.try_parse_url(url, F.lit("QUERY"))), "&")
    ok = F.lit(False)
    for name, parameter in hosts.items():
        given = F.filter(F.transform(F.filter(pairs, lambda p: p.startswith(parameter + "=")), lambda p: F.try_url_decode(F.substring_index(p, parameter + "=", -1))), lambda v: v != "")
        ok = ok | (((host == name) | host.endswith("." + name)) & (given == F.array(strip(blank(key.cast("string"))))))
    return F.coalesce(ok & (F.lower(blank(F.try_parse_url(url, F.lit("PROTOCOL")))) == "https"), F.lit(False))


def reject_reason(hosts: dict[str, str] | None = V.SOURCE_HOSTS) -> Column:
    """The first reason that holds for a record by itself, or null. hosts None leaves addresses unchecked."""
    body = strip(blank(F.col("body")))
    most = F.when(F.col("record_type") == V.ATTACHMENT, V.MAX_ATTACHMENT).otherwise(V.MAX_BODY)
    reason = F.when(body == "", REASONS[0]).when(F.length(body) > most, REASONS[1])
    return reason if hosts is None else reason.when(~official_url(F.col("source_url"), F.col("source_key"), hosts), REASONS[2])


def gate(articles: DataFrame, hosts: dict[str, str] | None = V.SOURCE_HOSTS) -> DataFrame:
    """Prepared articles (with pos, their order) and reason, null for accepted ones.

    A duplicate is a record whose id an earlier accepted record has: copies of a rejected one keep its
    reason. Of each id the lowest pos is found by an aggregation that combines before it shuffles, so an
    id on many rows is no burden. An empty table gives no rows.
    """
    judged = prepare(articles).withColumn("reason", reject_reason(hosts))
    first = judged.where(F.col("reason").isNull()).groupBy("record_id").agg(F.min("pos").alias("__first"))
    late = F.col("reason").isNull() & (F.col("pos") > F.col("__first"))
    return judged.join(first, "record_id", "left").withColumn("reason", F.when(late, REASONS[3]).otherwise(F.col("reason"))).drop("__first")


def accepted(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("reason").isNull()).drop("reason")


def rejected(gated: DataFrame) -> DataFrame:
    """(row, reason, article): row counts from 1 in file order."""
    bad = gated.where(F.col("reason").isNotNull())
    fields = [c for c in gated.columns if c not in ("pos", "reason")]
    return bad.select((F.col("pos") + 1).alias("row"), "reason", F.struct(*fields).alias("article"))


def require(articles: DataFrame) -> DataFrame:
    """articles, or an error if one of the required columns is missing."""
    missing = [c for c in REQUIRED if c not in articles.columns]
    if missing:
        raise ValueError(f"required fields are missing: {', '.join(missing)}")
    return articles
