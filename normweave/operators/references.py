"""Reference graph: mentions resolved to records, with a reason for each that cannot be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.mentions import NEAR_MARKS, SIGN, mentions
from ..functions.text import alternatives, blank

EDGE = ["src_id", "raw", "kind", "target_rule", "target_article", "target_clause", "resolved", "dst_id", "reason_code", "reason", "clause", "delegate"]

#: Why an edge is unresolved, by kind or code.
REASONS = {
    "image_only": "the official text gives the attachment as an image only",
    "parser_scope": "the attachment's text is outside what is collected",
    "unnamed_delegation": "delegated to a rule that is not named",
    "external_law": "law outside the corpus",
    "external_law_unmatched": "seems to be law or an outside rule, but is not known",
    "external_rule_unmatched": "seems to be an inside rule that the corpus lacks",
    "repealed_clause": "the clause referred to has been repealed",
    "no_record": "the corpus has no such record",
}


def _close(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def _bare(name: Column) -> Column:
    """The name without a particle at its end."""
    return F.regexp_replace(name, f"({alternatives(V.TRAILING_PARTICLES)})$", "")


def _known_law(name: Column) -> Column:
    return name.rlike(alternatives(V.KNOWN_LAWS))


def _ends(name: Column, tails: list[str]) -> Column:
    return name.rlike(f"({alternatives(tails)})$")


def is_external_law(name: Column) -> Column:
    """By the list of laws or by its tail; words such as the one for `method` only look like law."""
    return ~_ends(name, V.NOT_A_LAW_TAIL) & (_known_law(name) | _ends(name, V.LAW_TAIL_RULE))


def aliases(articles: DataFrame) -> DataFrame:
    """(alias, rule_name): names, names without the institution, and both without spaces; full names win, then smaller ones."""
    names = articles.select("rule_name").where("rule_name is not null").distinct()
    short = F.trim(F.replace("rule_name", F.lit(V.INSTITUTION), F.lit("")))
    ways = F.array(*[F.struct(F.lit(i).alias("way"), x.alias("alias")) for i, x in enumerate((F.col("rule_name"), short, _close(F.col("rule_name")), _close(short)))])
    spelled = names.select("rule_name", F.explode(ways).alias("x")).where("x.alias != ''")
    return spelled.groupBy(F.col("x.alias").alias("alias")).agg(F.min(F.struct("x.way", "rule_name")).alias("m")).select("alias", "m.rule_name")


def _named(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with what names of rules (of type rule) and words before articles (of type article) say.

    whole, told: the rule that a name or the word before an article is an alias of, as written, without a
    particle, and for names also without spaces; goes: own, told, nowhere, or open (the own rule's article,
    if it is not quoted); law, outside: whether a name or a word is of external law.
    Each name is looked up and judged once, not at each of its mentions.
    """
    asked = F.when(F.col("type") == "rule", F.col("name")).when(F.col("type") == "article", F.trim(blank(F.col("name"))))
    found, name = found.withColumn("asked", asked), F.col("asked")
    spellings = [name, _close(name), _bare(name), _close(_bare(name))]
    ways = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("alias")) for i, x in enumerate(spellings)])
    listed = found.select("asked").where("asked != ''").distinct().select("asked", F.explode(ways).alias("x")).select("asked", "x.*")
    each = listed.join(known, "alias", "left").groupBy("asked").agg(*[F.max(F.when(F.col("i") == i, F.col("rule_name"))).alias(f"rule_{i}") for i in range(len(spellings))])
    each = each.withColumn("bare", _bare(name))
    bare = F.col("bare")
    each = each.withColumn("other", (bare != "") & (bare != name)).withColumn("last", F.when(F.col("other"), bare).otherwise(name))
    other, last = F.col("other"), F.col("last")
    each = each.withColumn("word_law", _known_law(name)).withColumn("bare_law", other & _known_law(bare)).withColumn("tail_law", _ends(last, V.LAW_TAIL_NAMED) & ~_ends(last, V.NOT_A_LAW_TAIL))
    goes = (
        F.when(name.isin(V.VAGUE), "own")
        .when(F.col("rule_0").isNotNull(), "told")
        .when(F.col("word_law"), "nowhere")
        .when(other & bare.isin(V.VAGUE), "own")
        .when(other & F.col("rule_2").isNotNull(), "told")
        .when(F.col("bare_law") | F.col("tail_law"), "nowhere")
        .otherwise("open")
    )
    said = each.select("asked", F.coalesce(*[F.col(f"rule_{i}") for i in range(len(spellings))]).alias("whole"), F.coalesce("rule_0", "rule_2").alias("told"), goes.alias("goes"), is_external_law(name).alias("law"), F.expr("word_law or bare_law or tail_law").alias("outside"))
    return found.join(said, "asked", "left")


def records(articles: DataFrame) -> DataFrame:
    """(rule_name, article_no, dst_id, gone): the first record of each name and number, and its repealed clauses."""
    gone = F.transform("repealed_clauses", lambda c: c["clause"]) if "repealed_clauses" in articles.columns else F.array().cast("array<string>")
    return articles.groupBy("rule_name", "article_no").agg(F.min_by(F.struct(F.col("record_id").alias("dst_id"), gone.alias("gone")), "pos").alias("r")).select("rule_name", "article_no", "r.*")


def outbound(articles: DataFrame) -> DataFrame:
    """Edges (EDGE and place) of all mentions in articles (pos, record_id, rule_name, article_no, body, source_key, record_type).

    Bodies are read once, in Arrow batches; what follows are one join on names, one on numbers and one
    window for all types of mentions, so the corpus may be any size and the plan stays small: a branch for
    each type filled the driver's memory. A record without mentions has no edges; null bodies have none.
    Records that share an id share its edges.
    """
    # A body without any of these has no mention; it need not go to Python.
    base = articles.where(F.col("body").rlike(SIGN)).select(F.col("record_id").alias("src_id"), F.col("rule_name").alias("own_rule"), F.col("article_no").alias("own_no"), (F.length(blank(F.col("source_key"))) > 6).alias("regulation"), F.explode(mentions("body")).alias("m"))
    found = base.select("src_id", "own_rule", "own_no", "regulation", "m.*").dropDuplicates(["src_id", "type", "place"]).persist()
    named = _kinds(_named(found, aliases(articles)))
    return _edges(_first(_located(named, _numbers(articles))))


def _kinds(named: DataFrame) -> DataFrame:
    """named with the rule meant, and `kind` of rules and articles, without mentions of the own rule or article."""
    mine, article, goes = F.col("type") == "rule", F.col("type") == "article", F.col("goes")
    nowhere = (goes == "nowhere") | ((goes == "open") & F.col("quoted"))
    rule = F.when(mine, F.col("whole")).when(~article | nowhere, F.lit(None)).when(goes == "told", F.col("told")).otherwise(F.col("own_rule"))
    named = named.withColumn("rule", rule)
    kind = (
        F.when(mine & F.col("rule").isNotNull(), "rule_level")
        .when(mine, F.when(F.col("law"), "external_law").otherwise("external_rule_unmatched"))
        .when(article & F.col("rule").isNull(), F.when(F.col("outside"), "external_law").otherwise("external_law_unmatched"))
        .when(article, F.when(F.col("rule") == F.col("own_rule"), "same_rule").otherwise("cross_rule"))
    )
    named = named.withColumn("kind", kind).withColumn("near", article & F.col("rule").isNotNull())
    # What stood before a mention of the own rule, but named none, is not shown.
    same, word = F.col("kind") == "same_rule", F.col("asked")
    cut = same & (word != "") & ~blank(F.col("rule")).contains(F.col("name")) & (F.locate("제", F.col("raw")) > 1)
    named = named.withColumn("raw", F.when(cut, F.expr("substring(raw, locate('제', raw))")).otherwise(F.col("raw")))
    named = named.withColumn("article", F.when(same & F.col("addendum") & (word == ""), F.concat(F.lit(V.ADDENDUM + " "), "article")).otherwise(F.col("article")))
    own_article = (F.col("rule") == F.col("own_rule")) & (F.col("article") == F.col("own_no"))
    return named.where(F.when(mine, F.expr("not (rule <=> own_rule) or rule is null")).when(F.col("near"), ~own_article).otherwise(True))


def _numbers(articles: DataFrame) -> DataFrame:
    """(holder, key, dst_id, number, gone, met): records of a rule by their number as written (=), attachments also without spaces (~)."""
    written = records(articles).select(F.col("rule_name").alias("holder"), F.concat(F.lit("="), "article_no").alias("key"), "dst_id", F.col("article_no").alias("number"), "gone")
    close = articles.where(F.col("record_type") == V.ATTACHMENT).groupBy("rule_name", F.concat(F.lit("~"), _close(F.col("article_no"))).alias("key")).agg(F.min_by(F.struct("record_id", "article_no"), "pos").alias("r"))
    close = close.select(F.col("rule_name").alias("holder"), "key", F.col("r.record_id").alias("dst_id"), F.col("r.article_no").alias("number"), F.lit(None).cast("array<string>").alias("gone"))
    return written.unionByName(close).withColumn("met", F.lit(True))


def _located(named: DataFrame, numbers: DataFrame) -> DataFrame:
    """named with the record that an article is, or an attachment by the name as written, without spaces among
    attachments, or by the bare word: a row for each `way`."""
    raw, mine = F.col("raw"), F.col("type") == "attachment"
    ways = F.array(F.concat(F.lit("="), raw), F.concat(F.lit("~"), _close(raw)), F.when(raw.startswith(V.ATTACHMENT), F.lit("=" + V.ATTACHMENT)))
    keys = F.array_compact(F.when(mine, ways).when(F.col("near"), F.array(F.concat(F.lit("="), "article"))))
    # Without a key nothing is met: the record's id only spreads such rows.
    holder = F.when(mine, F.col("own_rule")).when(F.col("near"), F.col("rule")).otherwise(F.col("src_id"))
    return named.select("*", holder.alias("holder"), F.posexplode_outer(keys).alias("way", "key")).join(numbers, ["holder", "key"], "left")


def _first(located: DataFrame) -> DataFrame:
    """Of mentions of a record that are alike the first, and of its ways the first that met a record."""
    by_type = F.col("type")
    group = F.when(F.col("near"), "near").otherwise(by_type)
    alike = F.when(F.col("near"), F.col("rule")).when(by_type == "rule", F.col("name")).when(by_type == "delegation", F.col("place").cast("string")).otherwise(F.col("raw"))
    near = [F.when(F.col("near"), F.col(c)) for c in ("article", "clause")]
    at = Window.partitionBy("src_id", group, alike, *near).orderBy("place", F.asc_nulls_last("met"), "way")
    return located.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def _edges(located: DataFrame) -> DataFrame:
    """Edges of mentions; the kind of an unresolved one is its reason, but for a rule as a whole."""
    attached, delegated, near = F.col("type") == "attachment", F.col("type") == "delegation", F.col("near")
    marks = F.create_map(*[F.lit(x) for i, m in enumerate(NEAR_MARKS, 1) for x in (f"제{i}항", m)])
    circled = F.try_element_at(marks, F.substring_index(blank(F.col("clause")), " ", 1))
    there = near & F.col("dst_id").isNotNull()
    rows = located.withColumn("repealed", F.coalesce(there & F.array_contains("gone", circled), F.lit(False)))
    repealed = F.col("repealed")
    rows = rows.withColumn("hit", F.when(attached, F.col("met").isNotNull()).otherwise(there & ~repealed))
    hit = F.col("hit")
    kind = F.when(attached, F.when(hit, "attachment").otherwise("attachment_not_collected")).when(delegated, "unnamed_delegation").when(repealed, "repealed_clause").otherwise(F.col("kind"))
    code = (
        F.when(hit, F.lit(None)).when(attached, F.when(F.col("regulation"), "image_only").otherwise("parser_scope"))
        .when(delegated, "unnamed_delegation").when(repealed, "repealed_clause").when(near, "no_record").when(F.col("kind") != "rule_level", F.col("kind"))
    )
    why = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    given = {
        "src_id": F.col("src_id"), "raw": F.col("raw"), "kind": kind, "resolved": hit, "dst_id": F.when(hit, F.col("dst_id")),
        "target_rule": F.when(attached, F.when(hit, F.col("own_rule"))).when(near, F.when(hit, F.col("rule"))).when(F.col("type") == "rule", F.col("rule")),
        "target_article": F.when(hit, F.when(attached, F.col("number")).otherwise(F.col("article"))),
        "target_clause": F.when(near & hit, F.col("clause")), "reason_code": code, "reason": F.try_element_at(why, code),
        "clause": F.when(delegated, F.col("clause")), "delegate": F.when(delegated, F.col("delegate")),
    }
    return rows.select(*[given[c].alias(c) for c in EDGE], F.col("place"))


def inbound(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Resolved edges from the target's side: (record_id, raw, kind, source_rule, source_article, source_id)."""
    source = articles.select(F.col("record_id").alias("src_id"), F.col("rule_name").alias("source_rule"), F.col("article_no").alias("source_article"))
    return edges.where("resolved").join(source, "src_id").select(F.col("dst_id").alias("record_id"), "raw", "kind", "source_rule", "source_article", F.col("src_id").alias("source_id"))


def related(edges: DataFrame, articles: DataFrame, wanted: DataFrame, direction: str = "both") -> DataFrame:
    """(record_id, direction, other_id, kind, raw) of wanted (record_id); other_id is null for an unresolved edge."""
    out = edges.join(wanted.withColumnRenamed("record_id", "src_id"), "src_id", "left_semi").select(F.col("src_id").alias("record_id"), F.lit("outbound").alias("direction"), F.col("dst_id").alias("other_id"), "kind", "raw")
    back = inbound(edges, articles).join(wanted, "record_id", "left_semi").select("record_id", F.lit("inbound").alias("direction"), F.col("source_id").alias("other_id"), "kind", "raw")
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def reachable(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, record_id): hits and what they refer to, one step away."""
    step = hits.join(edges.where("resolved").select(F.col("src_id").alias("record_id"), "dst_id"), "record_id").select("query_id", F.col("dst_id").alias("record_id"))
    return hits.select("query_id", "record_id").unionByName(step).distinct()


def silence(articles: DataFrame, edges: DataFrame, names: Column) -> DataFrame:
    """One row: records with names of rules, those with a name that no edge covers, and their share."""
    raws = edges.groupBy("src_id").agg(F.collect_set("raw").alias("raws"))
    named = articles.select(F.col("record_id").alias("src_id"), names.alias("names")).where(F.size("names") > 0).join(raws, "src_id", "left")
    open_names = F.filter("names", lambda n: ~F.exists(F.coalesce("raws", F.array().cast("array<string>")), lambda r: r.contains(n)))
    return named.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(open_names) > 0).alias("silent")).withColumn("rate", F.round(F.try_divide("silent", "n_rows"), 4))
